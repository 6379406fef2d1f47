"""Documents linked by shared five-word shingles: a similarity join over an
R-tree of count vectors.

A document is the set of its distinct runs of five words (A-Z lower-cased,
split at the six ASCII blanks; fewer words are one run). Two documents link if
intersection / union >= 0.8; classes are the connected components.

Hashing the shingles into groups and counting makes every set a point, with
about as many coordinates as the set has shingles (boxes have ``GROUPS``, into
which points fold). The sum of the coordinatewise minima of two points is an upper bound of
the intersection, and the sum of minima with a box's upper corner bounds every
point in the box, so an R-tree over the points tells which pairs can link. What
survives is verified on the exact sets.

* Equal sets are one point from the start, so copies cost nothing.
* A box that is spread evenly over all groups excludes nothing, and a tree over
  all points would be read as a whole for every document. The tree's first level
  is therefore by shared shingles: of two sets that link, each has another
  member among its first |set| // 5 + 1 in any fixed order (at most a fifth of
  a set is outside the intersection). Every such shingle is a subtree. The order
  puts shingles first that a sample of the documents does not repeat; the sample
  is of bounded size and decides about cost, never about results.
* Near copies share many shingles, so many subtrees have the same members; one
  of each kind is kept.
* Members of a subtree meet one of its members first, which joins groups of near
  copies. Only subtrees that then still hold several components are searched:
  boxes against boxes, down to points, and only across components. Large
  subtrees are dealt out as pairs of tiles.
* A subtree first yields only the pairs that would join its components, best
  first, as many as it has members at most; only a subtree that yielded a pair
  which then still lies between two components is listed in full: in all
  others every pair that may link is inside a component. One pair per component is verified before all others, so a group is joined by
  few tests; no pair that may link is left out unless its members are connected
  already. Each pair is verified once.

Null texts count as empty; texts without words have no shingles and are linked
with nothing. A row is known by its id and a hash of its text; null ids are
values like others and come after all ids as the smallest of a component.
Sets are compared by 64-bit hashes of their shingles. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .components import components
from .neardup import rows_of
from .scratch import fetched, written
from .words import mix, shingle_hashes, word_hashes

SHINGLE = 5
GROUPS = 128                   # coordinates of a box, and of a point at least
LEAF, BRANCH = 16, 8           # points of a leaf, children of a node
HELD = 128                     # sets of a place that a task holds at a time, twice
TILE = 2048                    # points of a subtree that one task holds at a time, twice
SAMPLE = 10_000                # documents looked at for repeated shingles, about
REPEATED = 400_000             # repeated shingles the order puts last, at most
ORDERS = 4                     # first members of a subtree, by different orders
CHUNK_CHARS = 1 << 19
_FULL = 255                    # a count this large or larger


def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all distinct shingles, ordered."""
    h, words = word_hashes([t.encode("utf-8", "replace").lower() for t in texts])       # bytes: A-Z alone change
    s, per_text = shingle_hashes(h, words, SHINGLE)
    own = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return own[new], s[new]


def points(own: np.ndarray, s: np.ndarray, n: int) -> list[bytes]:
    """Counts per group of every set, a byte each: as many groups (a power of
    two, GROUPS at least) as the set has shingles."""
    size = np.bincount(own, minlength=n)
    groups = np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.cumsum(groups) - groups
    at = (mix(s ^ np.uint64(0xA0761D6478BD642F)) & (groups[own] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.minimum(np.bincount(begin[own] + at, minlength=int(groups.sum())), _FULL).astype(np.uint8).tobytes()
    return [raw[a:b] for a, b in zip(begin.tolist(), (begin + groups).tolist())]


def folded(point: bytes, groups: int) -> np.ndarray:
    """The point in fewer groups; a full count is larger than any other."""
    x = np.frombuffer(point, np.uint8).astype(np.int32)
    x[x == _FULL] = 1 << 24
    return x.reshape(-1, groups).sum(0, dtype=np.int32)


def coarse(found: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """The points in ``groups`` groups, one row each, for boxes."""
    return np.stack([folded(x, groups) for x in found])


def bound_of(x: bytes, y: bytes) -> int:
    """Upper bound of the intersection of two sets, in the groups of the smaller."""
    groups = min(len(x), len(y))
    return int(np.minimum(folded(x, groups), folded(y, groups)).sum(dtype=np.int64))


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of rows (broadcast over leading axes)."""
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def may_link(overlap: np.ndarray, size_a, size_b) -> np.ndarray:
    """overlap / union >= 0.8, in integers: 9 * overlap >= 4 * (a + b)."""
    return 9 * overlap >= 4 * (size_a + size_b)


def prefixes(own: np.ndarray, s: np.ndarray, n: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the first |set| // 5 + 1 of every set; shingles
    in ``repeated`` (ascending) come last."""
    late = np.zeros(len(s), bool)
    if len(repeated):
        late = repeated[np.minimum(np.searchsorted(repeated, s), len(repeated) - 1)] == s
    order = np.lexsort((s, late, own))
    size = np.bincount(own, minlength=n)
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    first = order[place < np.repeat(size // 5 + 1, size)]
    return own[first], s[first]


def _lists(values: np.ndarray, own: np.ndarray, n: int, kind) -> pa.Array:
    cut = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(values, kind))


def sketch(docs: DataFrame, key: str, text: str, repeated: np.ndarray) -> DataFrame:
    """key, th, size, same (16 bytes that stand for the set), point
    (``points``, deflated: small counts take about two bits), first (its first shingles)."""
    def run(batches):
        for batch in batches:
            texts, row = batch.column(2).to_pylist(), 0
            for group in chunks(texts, CHUNK_CHARS):
                own, s = sets(group)
                n = len(group)
                cut = np.searchsorted(own, np.arange(n + 1)).tolist()
                raw = memoryview(s.tobytes())
                at, first = prefixes(own, s, n, repeated)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(cut), pa.int64()),
                    pa.array([hashlib.md5(raw[8 * a:8 * b]).digest() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([zlib.compress(x, 1) for x in points(own, s, n)], pa.binary()), _lists(first.view(np.int64), at, n, pa.int64())],
                    names=["key", "th", "size", "same", "point", "first"])
                row += n

    kind = docs.schema[key].dataType.simpleString()
    return rows_of(docs, key, text).mapInArrow(run, f"key {kind}, th bigint, size bigint, same binary, point binary, first array<bigint>")


def contents(found: DataFrame) -> DataFrame:
    """place, i, j, node, s: the set of every node of (node, at, text) once for
    every place it is wanted at; repeated rows of a task count once."""
    def run(batches):
        seen = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            fresh = [k for k, x in enumerate(nodes) if not (x in seen or seen.add(x))]
            texts, row = [batch.column(2)[k].as_py() for k in fresh], 0
            for group in chunks(texts, CHUNK_CHARS):
                own, s = sets(group)
                cut, raw = np.searchsorted(own, np.arange(len(group) + 1)).tolist(), s.tobytes()
                out = []
                for k, a, b in zip(fresh[row:row + len(group)], cut[:-1], cut[1:]):
                    out += [(x["place"], x["i"], x["j"], nodes[k], raw[8 * a:8 * b]) for x in batch.column(1)[k].as_py()]
                row += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 4, pa.binary()])],
                                                 names=["place", "i", "j", "node", "s"])

    return found.select("node", "at", "text").mapInArrow(run, "place bigint, i bigint, j bigint, node bigint, s binary")


def repeated_shingles(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Shingles that at least two of about SAMPLE documents hold, the most
    frequent REPEATED of them, ascending."""
    rows = rows_of(docs, key, text)
    n = rows.count()
    share = min(1 << 20, SAMPLE * (1 << 20) // max(n, 1) + 1)
    some = rows.where(F.pmod(F.xxhash64("key", "th", F.lit("sample")), F.lit(1 << 20)) < share).select("text")

    def run(batches):
        for batch in batches:
            for group in chunks(batch.column(0).to_pylist(), CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(sets(group)[1].view(np.int64))], names=["s"])

    often = (some.mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "s").limit(REPEATED))
    return np.sort(np.array([r["s"] for r in often.select("s").collect()], np.int64).view(np.uint64))


class Tree:
    """R-tree over points: levels[0] are leaves. A node holds the upper corner
    of its points, the least size, and the root if all its points share one."""

    def __init__(self, point: np.ndarray, size: np.ndarray, root: np.ndarray):
        self.order = self._packed(point, size)
        self.point, self.size, self.root = point[self.order], size[self.order], root[self.order]
        self.levels = [self._level(self.point, self.size, self.root, self.root, LEAF)]
        while len(self.levels[-1][1]) > BRANCH:
            self.levels.append(self._level(*self.levels[-1], BRANCH))

    @staticmethod
    def _packed(point, size):
        """Sort-tile: slices by size, inside them by the group that differs most."""
        order = np.argsort(size, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(len(order) / LEAF))) * LEAF)
        for a in range(0, len(order), slab):
            part = order[a:a + slab]
            widest = int(np.argmax(point[part].astype(np.int64).std(0)))
            order[a:a + slab] = part[np.argsort(point[part, widest], kind="stable")]
        return order

    @staticmethod
    def _level(corner, size, lo, hi, width):
        at = np.arange(0, len(size), width)
        return np.maximum.reduceat(corner, at), np.minimum.reduceat(size, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def tree_pairs(a: Tree, b: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, bound) of all pairs of points in different
    components that may link; with a is b every pair comes once."""
    def kept(x, y, i, j):
        """Of node pairs: those that may hold such a pair."""
        good = ~((x[2][i] == x[3][i]) & (y[2][j] == y[3][j]) & (x[2][i] == y[2][j]))
        i, j = i[good], j[good]
        out = [np.zeros(0, bool)]
        step = max(1, (1 << 22) // a.point.shape[1])
        for k in range(0, len(i), step):
            p, q = i[k:k + step], j[k:k + step]
            out.append(may_link(bounds(x[0][p], y[0][q]), x[1][p], y[1][q]))
        good = np.concatenate(out)
        return i[good], j[good]

    def children(i, width, n):
        at = i[:, None] * width + np.arange(width)
        return at, at < n

    depth = min(len(a.levels), len(b.levels)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[depth][1])), np.arange(len(b.levels[depth][1])), indexing="ij"))
    if a is b:
        i, j = i[i <= j], j[i <= j]
    while True:
        x, y = a.levels[depth], b.levels[depth]
        i, j = kept(x, y, i, j)
        if depth == 0:
            break
        depth -= 1
        (ci, oi), (cj, oj) = children(i, BRANCH, len(a.levels[depth][1])), children(j, BRANCH, len(b.levels[depth][1]))
        both = oi[:, :, None] & oj[:, None, :]
        i, j = (np.broadcast_to(c, both.shape)[both] for c in (ci[:, :, None], cj[:, None, :]))
        if a is b:
            i, j = i[i <= j], j[i <= j]
    step = max(1, (1 << 22) // (LEAF * LEAF * a.point.shape[1]))
    for k in range(0, len(i), step):                                 # leaves against leaves
        (p, op), (q, oq) = children(i[k:k + step], LEAF, len(a.size)), children(j[k:k + step], LEAF, len(b.size))
        both = op[:, :, None] & oq[:, None, :]
        p, q = (np.broadcast_to(c, both.shape)[both] for c in (p[:, :, None], q[:, None, :]))
        good = a.root[p] != b.root[q]
        if a is b:
            good &= p < q
        p, q = p[good], q[good]
        bound = bounds(a.point[p], b.point[q])
        good = may_link(bound, a.size[p], b.size[q])
        yield a.order[p[good]], b.order[q[good]], bound[good]


def tree_links(node: np.ndarray, fine: list[bytes], size: np.ndarray, root: np.ndarray, own: np.ndarray):
    """Candidate pairs (nodes, bound) of a subtree's members (own all 0), or of
    two of its tiles (own 0 and 1): then only between them.

    Sets that link are of like size, so their points have as many groups or
    twice as many. There is a tree for every number of groups, its boxes an
    eighth of that; what the boxes leave is held against whole points."""
    length = np.fromiter(map(len, fine), np.int64, len(fine))
    two = bool(own.any())

    def of(side, groups, box):
        at = np.flatnonzero((length == groups) & ((own == side) if two else True))
        return (at, Tree(coarse([fine[x] for x in at], box), size[at], root[at])) if len(at) else None

    for groups in np.unique(length).tolist():
        box = max(GROUPS, groups // 8)
        left, longer = of(0, groups, box), of(1 if two else 0, 2 * groups, box)
        meet = [(left, longer)]
        if two:
            right = of(1, groups, box)
            meet += [(left, right), (of(0, 2 * groups, box), right)]
        else:
            meet.append((left, left))
        for x, y in meet:
            if x is None or y is None:
                continue
            for p, q, _ in tree_pairs(x[1], y[1]):
                p, q = x[0][p], y[0][q]
                bound = np.fromiter((bound_of(fine[u], fine[v]) for u, v in zip(p.tolist(), q.tolist())), np.int64, len(p))
                good = may_link(bound, size[p], size[q])
                yield node[p[good]], node[q[good]], (bound / (size[p] + size[q]))[good]


PAIRS = "a bigint, b bigint, place bigint, score double"


def _pairs_batch(parts: list, place) -> pa.RecordBatch:
    """place: one number for all pairs, or one each."""
    a, b, score = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64)),
                                       pa.array(np.broadcast_to(np.asarray(place, np.int64), len(a))), pa.array(score.astype(np.float64))],
                                      names=["a", "b", "place", "score"])


def spanning(a: np.ndarray, b: np.ndarray, score: np.ndarray, node: np.ndarray, root: np.ndarray):
    """Of candidate pairs, those that join components one by one, best first."""
    up = dict(zip(node.tolist(), root.tolist()))
    up.update((r, r) for r in root.tolist())

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k in np.argsort(-score, kind="stable").tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            up[x] = y
            keep.append(k)
    return a[keep], b[keep], score[keep]


def subtree_pairs(members: DataFrame, nodes: DataFrame, groups: DataFrame, forest: bool = False) -> DataFrame:
    """a, b, place, score: candidates across components, from the subtrees (bucket, n,
    node) that hold several. ``forest``: of a subtree's candidates only as many
    as join its components, which never outgrow its members. A pair comes once
    for every subtree that yields it."""
    rows = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = (rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("bucket"))
    rows = written(rows.join(written(mixed, "mixed"), "bucket"), "mixed-members")
    tiles = F.ceil(F.col("n") / TILE)
    rows = (rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
            .join(nodes.select("node", "size", "point"), "node")
            .select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "size", "root", "point",
                    F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("own")))

    def run(batches):
        held, key = [], None

        def flush():
            node, size, root, own = (np.concatenate([h[k] for h in held]) for k in range(4))
            if root.min() == root.max():
                return None
            parts = [x for x in tree_links(node, [x for h in held for x in h[4]], size, root, own) if len(x[0])]
            if forest and parts:
                parts = [spanning(*(np.concatenate([p[k] for p in parts]) for k in range(3)), node, root)]
            return _pairs_batch(parts, key[0]) if parts else None

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j, node, size, root, own = (batch.column(k).to_numpy() for k in (0, 1, 2, 3, 4, 5, 7))
            point = list(map(zlib.decompress, batch.column(6).to_pylist()))
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
                this = (bucket[x], i[x], j[x])
                if held and this != key:
                    out = flush()
                    held = []
                    if out is not None:
                        yield out
                key = this
                held.append((node[x:y], size[x:y], root[x:y], own[x:y], point[x:y]))
        out = flush() if held else None
        if out is not None:
            yield out

    return (rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(run, PAIRS))


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, place) whose points may link, with their score."""
    def run(batches):
        for batch in batches:
            size_a, size_b = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sides = (map(zlib.decompress, batch.column(k).to_pylist()) for k in (3, 4))
            bound = np.fromiter(map(bound_of, *sides), np.int64, batch.num_rows)
            good = may_link(bound, size_a, size_b)
            yield _pairs_batch([(batch.column(0).to_numpy()[good], batch.column(1).to_numpy()[good], (bound / (size_a + size_b))[good])],
                               batch.column(2).to_numpy()[good])

    def of(side):
        return nodes.select(F.col("node").alias(side), F.col("point").alias(f"p_{side}"), F.col("size").alias(f"s_{side}"))

    return (pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "place", "p_a", "p_b", "s_a", "s_b")
            .mapInArrow(run, PAIRS))


def verifier(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pairs (a, b, place) of nodes whose exact sets link.

    Pairs of one place (a subtree, or the member that all are compared with)
    mostly share their nodes, so sets travel once per place and not per pair;
    the nodes of a large place are dealt into blocks of about HELD.
    """
    def run(batches):
        held, place = {}, None
        for batch in batches:
            a, b, keep = batch.column(4).to_pylist(), batch.column(5), []
            spots = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for k, (spot, x) in enumerate(zip(spots, a)):
                if spot != place:
                    held, place = {}, spot
                if not batch.column(3)[k].as_py():                   # a set; those of a place come before its pairs
                    held[x] = np.frombuffer(batch.column(6)[k].as_py(), np.uint64)
                    continue
                y = b[k].as_py()
                both = np.concatenate([held[x], held[y]])
                size = len(both)
                both.sort(kind="stable")
                if 9 * int((both[1:] == both[:-1]).sum()) >= 4 * size:
                    keep.append((x, y))
            x, y = zip(*keep) if keep else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("place", F.explode(F.array("a", "b")).alias("node")).distinct()
        parts = written(ends.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / HELD).alias("parts")), "places")
        part = [F.pmod(F.xxhash64(c), F.col("parts")) for c in ("a", "b")]
        dealt = written(pairs.join(parts, "place").select("place", F.least(*part).alias("i"), F.greatest(*part).alias("j"), "a", "b"), "dealt")
        wanted = (dealt.select(F.explode(F.array("a", "b")).alias("node"), F.struct("place", "i", "j").alias("at")).distinct()
                  .groupBy("node").agg(F.collect_list("at").alias("at")).join(nodes.select("node", "head.key", "head.th"), "node"))
        held = contents(fetched(rows_of(docs, key, text), wanted, ["key", "th"], 256))
        none = F.lit(None)
        rows = (held.select("place", "i", "j", F.lit(0).alias("pair"), F.col("node").alias("a"), none.cast("bigint").alias("b"), "s")
                .unionByName(dealt.select("place", "i", "j", F.lit(1).alias("pair"), "a", "b", none.cast("binary").alias("s"))))
        return (rows.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j", "pair")
                .mapInArrow(run, "a bigint, b bigint"))

    return verify


def settled(pairs: DataFrame, groups: DataFrame | None, verify) -> DataFrame:
    """Components (node, root) after all pairs (a, b, place, score): first the best
    pair of every component, then the pairs that still lie between two."""
    def rooted(p):
        if groups is None:
            return p.select("a", "b", "place", "score", F.col("a").alias("ra"), F.col("b").alias("rb"))

        def of(side):
            return groups.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))

        return (p.join(of("a"), "a", "left").join(of("b"), "b", "left")
                .select("a", "b", "place", "score", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")))

    def merged(links):
        if groups is not None:
            links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b"))
        return components(links)

    between = written(rooted(pairs).where("ra <> rb"), "pairs")
    best = F.max_by(F.struct("a", "b", "place"), F.struct("score", "a", "b"))
    picks = [between.groupBy(F.col(r)).agg(best.alias("p")).select("p.*") for r in ("ra", "rb")]
    first = written(picks[0].unionByName(picks[1]).distinct(), "first-pairs")
    groups = merged(written(verify(first), "links"))
    rest = written(rooted(between.select("a", "b", "place", "score").join(first, ["a", "b"], "left_anti")).where("ra <> rb").select("a", "b", "place"), "pairs")
    if rest.isEmpty():
        return groups
    links = written(verify(rest), "links")
    return groups if links.isEmpty() else merged(links)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key of the component) for
    every row of docs."""
    rows = written(sketch(docs, key, text, repeated_shingles(docs, key, text)), "overlap-rows")
    head = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "th")).alias("head")
    nodes = written(rows.where("size > 0").groupBy("same").agg(head, F.first("size").alias("size"), F.first("point").alias("point"), F.first("first").alias("first"))
                    .withColumn("node", F.monotonically_increasing_id()), "overlap-nodes")
    buckets = nodes.select(F.explode("first").alias("bucket"), "node")
    turned = F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS)))
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)]
    repeated = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")    # most shingles are one set's
    held = written(buckets.join(repeated.select("bucket"), "bucket"), "held")
    shared = (held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(turned.alias("t"), "node")).alias("h"), *same)
              .groupBy("n", "h0", "h1").agg(F.min(F.struct("bucket", F.col("h.node").alias("hub"))).alias("b")))
    shared = written(shared.select("b.bucket", "n", "b.hub"), "shared")       # subtrees of the same members: one of them
    members = written(held.join(shared, "bucket"), "members")
    verify = verifier(docs, nodes, key, text)
    pairs = (members.where("node <> hub").groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
             .agg(F.min("hub").alias("place")))
    groups = written(settled(near_pairs(pairs, nodes), None, verify), "groups")
    large = members.where("n > 2").select("bucket", "n", "node")

    def joined(found):
        once = found.groupBy("a", "b").agg(F.min("place").alias("place"), F.max("score").alias("score"))
        return written(settled(once.join(pairs, ["a", "b"], "left_anti"), groups, verify), "groups")

    def root_of(side):
        return groups.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))

    forest = written(subtree_pairs(large, nodes, groups, True), "forest")    # pairs that would join a subtree's candidates
    groups = joined(forest)
    still = written(forest.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
                    .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(F.col("place").alias("bucket")).distinct(), "open")
    if not still.isEmpty():                # all pairs that still lie between components
        groups = joined(subtree_pairs(large.join(still, "bucket", "left_semi"), nodes, groups))
    rooted = written(nodes.select("same", "node", "head").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("head").alias("least")), "least")
    named = written(rooted.join(least, "root").select("same", F.col("least.key").alias("component_id")), "named")
    return (rows.join(named, "same", "left")
            .select(F.col("key").alias(key), F.col("size").alias("n_shingles"),
                    F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")))
