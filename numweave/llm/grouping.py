"""Links between rows that share a bucket, without all pairs of a bucket.

1. Every bucket has a hub, another one in each bucket; members are compared
   with it alone. Links found so are joined to components.
2. Only buckets that then still hold more than one component are looked at
   again: their members are dealt into blocks, and pairs of blocks compare
   the contents of members of different components.

Where contents are long, ``marked`` compares short marks instead. Members of a
bucket of up to BLOCK meet in one place, those of a larger one in several, each
with the bucket's hub. Of the pairs that may link, a place yields as many as
join its members, to the same few nodes in every bucket, so that most buckets
yield the same pairs; each is verified once. Larger buckets that then hold more
than one component are dealt into blocks as above and yield further such pairs.
Only buckets in which a pair is no link list all their pairs that may link and
still lie between two components.

Pairs inside one component need no further test, so no connection between two
rows of a bucket is lost, however large the bucket is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ranges
from .components import components
from .scratch import lean, written
from .words import mix

BLOCK = 256                    # members of a block of a large bucket
SENT_KEYS = 1 << 19            # keys that a task holds before it sends them on
PLACE_ROWS = 1 << 13           # rows of places compared at once


def linked(buckets: DataFrame, sketches: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int,
           verify: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame],
           across: Callable[[list[str]], tuple[Callable[[int, np.ndarray], np.ndarray], Callable[[int, int], bool] | None]] | None = None,
           marked: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(links: a, b that connect every component; groups: node, root).

    buckets: bucket bigint, node bigint. sketches: node, sketch (binary of
    ``width`` bytes), one row per node. near(A, B) tells which rows of two
    sketch matrices are near; verify keeps the rows of (a, b) that are links.
    fetch(nodes) gives node, content. across(contents) prepares the members of
    a block; it returns (x, others) -> which of the others x may be linked to,
    and (x, y) -> whether it is, or None if the first is the answer already.
    marked, in place of sketches and across: (node, content, a binary mark per
    node; (marks, left, right, root) -> the pairs of rows of left and right, of
    different roots, that may link; and, if there is a faster way for many
    pairs, (marks, x, y) -> which of the pairs of rows x[i], y[i] may link).
    """
    if marked:
        return _by_marks(buckets if "n" in buckets.columns else shared_keys(
            buckets.select("node", F.array("bucket").alias("keys")), 1), verify, *marked)
    turned = F.col("node").bitwiseXOR(F.xxhash64("bucket"))           # puts another member first in every bucket
    hubs = (buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(turned).alias("r"))
            .where("n > 1").select("bucket", "n", F.col("r").bitwiseXOR(F.xxhash64("bucket")).alias("hub")))
    members = written(buckets.join(hubs, "bucket").where("node <> hub"), "bucket-members")
    pairs = members.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    close = written(_near_pairs(pairs, sketches, near, width), "near-pairs")
    links = written(verify(close), "links")
    groups = components(links)
    extra = written(_across(members, groups, fetch, across), "links")
    if extra.isEmpty():
        return links, groups
    links = links.unionByName(extra)
    return links, components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(extra))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def shared_keys(keyed: DataFrame, nodes: int) -> DataFrame:
    """bucket, n, place, node, extra: every key that several nodes have, with
    all of them, n in number. keyed: node, keys array<bigint>; nodes: about how
    many rows that are. A bucket of more than BLOCK is dealt into places; its
    hub, the first in the order of ``_order``, is an ``extra`` row of the places
    it does not belong to.

    Most keys are held by one node alone. Keys therefore travel packed, many to
    a row, dealt by their first bits.
    """
    bits = max(8, (nodes * 40 // SENT_KEYS).bit_length())

    @lean
    def send(batches):
        keys, own, held = [], [], 0

        def flush():
            k, node = np.concatenate(keys), np.concatenate(own)
            order = np.argsort(k)
            k, node = k[order], node[order]
            low = node.min()
            wide = node.max() - low >= 1 << 32
            off = node - low if wide else (node - low).astype(np.uint32)
            cut = np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([
                pa.array(some, pa.int64()), pa.array(np.full(len(some), low), pa.int64()), pa.array(np.full(len(some), wide)),
                *[pa.array([x[a:b].tobytes() for a, b in zip(cut[some].tolist(), cut[some + 1].tolist())], pa.binary()) for x in (k, off)],
            ], names=["chunk", "low", "wide", "keys", "nodes"])

        for batch in batches:
            lists = batch.column(1)
            k = mix(lists.flatten().to_numpy().view(np.uint64))
            keys.append(k)
            own.append(np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())))
            held += len(k)
            if held >= SENT_KEYS:
                yield flush()
                keys, own, held = [], [], 0
        if held:
            yield flush()

    def shared(parts):
        k = np.concatenate([np.frombuffer(x[3], np.uint64) for x in parts])
        node = np.concatenate([np.frombuffer(x[4], np.int64 if x[2] else np.uint32).astype(np.int64) + x[1] for x in parts])
        order = np.argsort(k)
        k, node = k[order], node[order]
        same = k[1:] == k[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        k, node = k[several], node[several]
        order = np.lexsort((node, _order(node), k))
        k, node = k[order], node[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (node[1:] != node[:-1])
        k, node = k[new], node[new]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else [])
        n = np.diff(np.append(begin, len(k)))
        hub = np.repeat(node[begin], n)
        n = np.repeat(n, n)
        places = -(-n // BLOCK)
        place = (mix(_order(node)) % places.astype(np.uint64)).astype(np.int64) if len(k) else n
        several = n > 1
        first = np.flatnonzero((node == hub) & (places > 1))          # the hubs of larger buckets
        more = np.repeat(first, places[first] - 1)
        other = ranges(np.zeros(len(first), np.int64), places[first] - 1)
        other += other >= place[more]
        out = [np.concatenate([x[several], x[more]]) for x in (k.view(np.int64), n)]
        out += [np.concatenate([place[several], other]), np.concatenate([node[several], node[more]])]
        return pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.arange(len(out[0])) >= several.sum())],
                                          names=["bucket", "n", "place", "node", "extra"])

    @lean
    def receive(batches):
        parts = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if parts and row[0] != parts[0][0]:
                    yield shared(parts)
                    parts = []
                parts.append(row)
        if parts:
            yield shared(parts)

    return written(keyed.select("node", "keys").mapInArrow(send, "chunk bigint, low bigint, wide boolean, keys binary, nodes binary")
                   .repartition("chunk").sortWithinPartitions("chunk")
                   .mapInArrow(receive, "bucket bigint, n bigint, place bigint, node bigint, extra boolean"), "shared-keys")


def _order(node: np.ndarray) -> np.ndarray:
    """A fixed random order of nodes, the same in all buckets."""
    return mix(node.astype(np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))


def _by_marks(buckets: DataFrame, verify, marks: DataFrame, may, allow=None) -> tuple[DataFrame, DataFrame]:
    """linked, by marks; no pair is verified twice. buckets: of ``shared_keys``."""
    rows = buckets.join(marks, "node").select("bucket", "place", "node", "content")
    first = written(rows.repartition("bucket", "place").sortWithinPartitions("bucket", "place")
                    .mapInArrow(_joining(may, allow), _FOUND), "first-pairs")
    tested = written(first.select("a", "b").distinct(), "pairs")
    links = written(verify(tested), "links")
    groups = components(links)

    def dealt(members, forest):
        return _dealt(members, groups, lambda rows: rows.join(marks, "node"), _marked(may, forest), _FOUND)

    members = buckets.where("n > 2 and not extra").select("bucket", "n", "node")
    large = written(dealt(members.where(f"n > {BLOCK}"), True).distinct(), "first-pairs")
    if not large.isEmpty():
        new = written(large.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        some = written(verify(new), "links")
        first, tested, links, groups = first.unionByName(large), tested.unionByName(new), links.unionByName(some), _merged(groups, some)

    def root_of(side):
        return groups.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))

    still = written(first.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
                    .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("bucket").distinct(), "open-buckets")
    rest = written(dealt(members.join(still, "bucket", "left_semi"), False).select("a", "b").distinct()
                   .join(tested, ["a", "b"], "left_anti"), "pairs")
    extra = written(verify(rest), "links")
    if extra.isEmpty():
        return links, groups
    return links.unionByName(extra), _merged(groups, extra)


def _joining(may, allow):
    """Of sorted rows (bucket, place, node, content): pairs that may link, as
    many as join all members of a place that such pairs connect, each member
    with the first one in the common order if possible."""
    def pairs_of(marks, begin, size):
        if allow is None:
            found = [may(marks, own := np.arange(b, b + n), own, np.arange(len(marks))) for b, n in zip(begin.tolist(), size.tolist())]
            x, y = (np.concatenate([f[k] for f in found]) for k in range(2))
            order = np.lexsort((x, y))
            x, y = x[order], y[order]
            return x[x < y], y[x < y]
        before = ranges(np.zeros(len(size), np.int64), size)           # members of the place in front of each
        y = np.repeat(np.arange(len(before)), before)
        x = ranges(np.arange(len(before)) - before, before)
        found = []
        for k in range(0, len(x), 1 << 18):
            part = slice(k, k + (1 << 18))
            found.append(k + np.flatnonzero(allow(marks, x[part], y[part])))
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return x[at], y[at]

    def compare(bucket, place, node, marks):
        order = np.lexsort((_order(node), place, bucket))
        bucket, place, node = bucket[order], place[order], node[order]
        marks = np.frombuffer(b"".join(marks[i] for i in order.tolist()), np.uint8).reshape(len(order), -1)
        begin = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1])]))
        x, y = pairs_of(marks, begin, np.diff(np.append(begin, len(bucket))))
        at, first = np.unique(y, return_index=True)
        up = np.arange(len(node))
        up[at] = x[first]
        while not np.array_equal(up, over := up[up]):
            up = over
        root, more = dict(), []

        def find(r):
            while r in root:
                r = root[r]
            return r

        for k in np.flatnonzero(up[x] != up[y]).tolist():              # members that only later ones connect
            p, q = find(int(up[x[k]])), find(int(up[y[k]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                more.append(k)
        at = np.concatenate([first, np.array(more, np.int64)])
        a, b = node[x[at]], node[y[at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), bucket[x[at]])], names=["a", "b", "bucket"])

    @lean
    def run(batches):
        held, count = [], 0

        def joined():
            return [np.concatenate([h[k] for h in held]) for k in range(3)] + [[c for h in held for c in h[3]]]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((*[batch.column(k).to_numpy() for k in range(3)], batch.column(3).to_pylist()))
            count += batch.num_rows
            if count >= PLACE_ROWS:
                rows = joined()
                last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0           # the last place may go on
                if cut:
                    yield compare(*[x[:cut] for x in rows])
                held, count = [tuple(x[cut:] for x in rows)], count - cut
        if held:
            yield compare(*joined())

    return run


def _marked(may, forest: bool):
    """Pairs of a place that may link; ``forest``: those that join its
    components one by one, fewer than it has members."""
    def compare(key, own, node, root, content):
        bucket, i, j = key
        _, root = np.unique(root, return_inverse=True)
        if root.max() == 0:
            return
        marks = np.frombuffer(b"".join(content), np.uint8).reshape(len(content), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x, y = may(marks, left, right, root)
        up = list(range(int(root.max()) + 1))

        def find(r):
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        for p, q in zip(x.tolist(), y.tolist()):
            if forest:
                r, t = find(int(root[p])), find(int(root[q]))
                if r == t:
                    continue
                up[r] = t
            elif i == j and p > q:
                continue
            yield min(node[p], node[q]), max(node[p], node[q]), bucket

    return compare


_FOUND = "a bigint, b bigint, bucket bigint"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _near_pairs(pairs: DataFrame, sketches: DataFrame, near, width: int) -> DataFrame:
    @lean
    def run(batches):
        for batch in batches:
            a, b = matrix(batch.column(2), width), matrix(batch.column(3), width)
            keep = pa.array(near(a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def of(side):
        return sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"s_{side}"))

    return (pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b")
            .mapInArrow(run, "a bigint, b bigint"))


def _across(members: DataFrame, groups: DataFrame, fetch, across) -> DataFrame:
    """Links (a, b) between different components of buckets of three or more.
    Once two components are linked, their members are not compared again.
    """
    def compare(key, own, node, root, content):
        _, i, j = key
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        _, root = np.unique(root, return_inverse=True)
        if root.max() == 0:
            return
        may, confirm = across(content)
        for x in left.tolist():
            others = right[right > x] if i == j else right
            others = others[root[others] != root[x]]
            if len(others):
                for y in others[may(x, others)].tolist():
                    if root[y] != root[x] and (confirm is None or confirm(x, y)):
                        root[root == root[y]] = root[x]
                        yield min(node[x], node[y]), max(node[x], node[y])

    def with_contents(rows):
        return rows.join(written(fetch(rows.select("node").distinct()), "contents"), "node")

    large = members.where("n > 2")
    large = large.select("bucket", "n", "node").unionByName(large.select("bucket", "n", F.col("hub").alias("node")).distinct())
    return _dealt(large, groups, with_contents, compare, "a bigint, b bigint").distinct()


def _dealt(members: DataFrame, groups: DataFrame, with_contents, compare, found: str) -> DataFrame:
    """What compare finds in the places of buckets that hold several components.
    members: bucket, n, node.

    The members outside a bucket's largest component are dealt into blocks, and
    so are those inside; two blocks meet in one place, at most about 2 * BLOCK
    contents, unless both are of the largest component, whose members need no
    test among themselves.
    """
    rows = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kinds = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = (kinds.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
             .select("bucket", F.col("most.root").alias("main"), F.col("most.c").alias("n_main")))
    rows = written(rows.join(written(mixed, "mixed"), "bucket"), "mixed-buckets")
    is_main = F.col("root") == F.col("main")
    others, mains = F.ceil((F.col("n") - F.col("n_main")) / BLOCK), F.ceil(F.col("n_main") / BLOCK)
    own = F.when(is_main, others + F.pmod(F.xxhash64("node"), mains)).otherwise(F.pmod(F.xxhash64("node"), others))
    upto = F.when(is_main, others).otherwise(others + mains).cast("bigint") - 1
    dealt = (with_contents(rows).withColumn("own", own.cast("bigint"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), upto)))
             .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "node", "root", "content"))

    @lean
    def run(batches):
        held, key, names = [], None, [c.split()[0] for c in found.split(", ")]

        def flush():
            own, node, root = (np.concatenate([h[k] for h in held]) for k in range(3))
            rows = list(compare(key, own, node, root, [c for h in held for c in h[3]]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(names))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j, own, node, root = (batch.column(k).to_numpy() for k in range(6))
            content = batch.column(6).to_pylist()
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
                this = (bucket[x], i[x], j[x])
                if held and this != key:
                    yield flush()
                    held = []
                key = this
                held.append((own[x:y], node[x:y], root[x:y], content[x:y]))
        if held:
            yield flush()

    return (dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(run, found))
