"""Near-duplicate documents by BagMinHash over word shingles.

A text is the multiset of its runs of five words (lower case, split at
blanks). Its signature has M components. Every shingle carries Poisson
processes of points (time, weight, component) over a hierarchy of weight
intervals (0, 1], (1, 2], (2, 4], (4, 8] ...: a point counts if its weight
does not exceed the shingle's count, and a component keeps its earliest
point. Points depend on the shingle alone, so two texts share a component's
point with probability equal to their weighted Jaccard similarity
sum(min) / sum(max) - without bias. Points are drawn in order of time and only
until every component has one.

Bands of the signature give buckets. ``grouping`` compares a bucket's members
with a hub first, by one byte of each component, and verifies what may reach
the threshold by the exact multiset overlap of the texts; members that are
then still apart are compared by exact overlap, block by block. Texts with equal words are one node
from the start (the text without words included), so copies cost nothing.

A pair at the threshold of 0.8 shares a bucket with probability 0.9993, pairs
above it more surely. Null texts count as empty. A row is known by its id
(null is a value like any other) and a hash of its text: rows equal in both
are treated alike. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks, ranges
from .grouping import linked
from .scratch import fetched, lean, small, unused, written
from .words import mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
M = BANDS * ROWS
#: Equal components from which a pair is verified: five standard deviations below the mean at the threshold.
MIN_EQUAL = math.floor(M * THRESHOLD - 5 * math.sqrt(M * THRESHOLD * (1 - THRESHOLD)))
ROUND_POINTS = math.log(M) + 4                     # points per component drawn in the first round
CHUNK_CHARS = 1 << 18


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of all distinct shingles, ordered."""
    h, words = word_hashes([t.lower().encode("utf-8", "replace") for t in texts])
    s, per_text = shingle_hashes(h, words, SHINGLE)
    own = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    return own[at], s[at], np.diff(np.append(at, len(s)))


def signatures(own: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m identities of the earliest points; rows of texts without
    shingles are zero."""
    out = np.zeros((n, m), np.uint64)
    weight = np.bincount(own, count, minlength=n)
    todo = weight > 0
    limit = np.zeros(n)
    limit[todo] = m * ROUND_POINTS / weight[todo]
    while todo.any():
        pick = todo[own]
        time, where, ident = _points(own[pick], shingle[pick], count[pick], limit, m)
        best = np.zeros((n, m), np.uint64)
        seen = np.zeros((n, m), bool)
        order = np.argsort(-time, kind="stable")
        best.ravel()[where[order]] = ident[order]       # the last one written is the earliest
        seen.ravel()[where] = True
        full = todo & seen.all(1)
        out[full] = best[full]
        todo = todo & ~full
        limit[todo] *= 2                                # some component has no point yet: look further
    return out


def _points(own, shingle, count, limit, m):
    """All counting points up to each text's time limit: (time, text * m +
    component, identity)."""
    times, wheres, idents = [], [], []
    level, low, high = 0, 0, 1
    while True:
        inside = count > low
        if not inside.any():
            break
        o, c = own[inside], count[inside]
        base = mix(shingle[inside] + np.uint64((level * 0x632BE59BD9B4E019) & (2 ** 64 - 1)))
        t, stop, k, block = np.zeros(len(o)), limit[o], 0, 1
        while len(o):                                   # the next ``block`` points of every shingle still in time
            step = np.arange(2 * k + 1, 2 * (k + block) + 1, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            draw = mix(base[:, None] + step[None, :])
            gap = -np.log(_uniform(draw)) / (high - low)
            gap[:, 0] += t
            when = np.cumsum(gap, axis=1)
            on = when <= stop[:, None]
            place = mix(draw[on] ^ np.uint64(0xD1B54A32D192ED03))
            row = np.nonzero(on)[0]
            component = ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            cell = low + 1 + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(high - low) >> np.uint64(32)).astype(np.int64)
            hit = cell <= c[row]
            times.append(when[on][hit])
            wheres.append(o[row[hit]] * m + component[hit])
            idents.append(place[hit])
            more = on[:, -1]
            o, c, base, t, stop = o[more], c[more], base[more], when[more, -1], stop[more]
            k, block = k + block, min(64, max(1, 2 * block if k else 1))
        level, low, high = level + 1, high, 2 * high
    return np.concatenate(times), np.concatenate(wheres), np.concatenate(idents)


def bands(sig: np.ndarray) -> np.ndarray:
    """n x BANDS bucket numbers; the band's number is mixed in."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def word_key(text: str) -> bytes:
    """128 bits that stand for the text's words in order."""
    return hashlib.md5(b" ".join(text.lower().encode("utf-8", "replace").split())).digest()


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[key].alias("key"), F.xxhash64(t).alias("th"), t.alias("text"))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, th, words (16 bytes), buckets array<bigint> (empty without words),
    sketch (M bytes)."""

    @lean
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            row = 0
            for group in chunks(texts, CHUNK_CHARS):
                own, s, c = multisets(group)
                sig = signatures(own, s, c, len(group))
                has = np.bincount(own, minlength=len(group)) > 0
                b = bands(sig)
                cut = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                low = (sig & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(group)), batch.column(1).slice(row, len(group)),
                    pa.array([word_key(t) for t in group], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(b[has].ravel())),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ], names=["key", "th", "words", "buckets", "sketch"])
                row += len(group)

    kind = docs.schema[key].dataType.simpleString()
    return rows_of(docs, key, text).mapInArrow(
        run, f"key {kind}, th bigint, words binary, buckets array<bigint>, sketch binary")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(1) >= MIN_EQUAL


def similarity(a: str, b: str) -> float:
    """Exact multiset overlap of two texts' shingles; equal words are 1."""
    own, s, c = multisets([a, b])
    x, y = own == 0, own == 1
    if not x.any() or not y.any():
        return 1.0 if x.any() == y.any() else 0.0
    _, i, j = np.intersect1d(s[x], s[y], assume_unique=True, return_indices=True)
    low = int(np.minimum(c[x][i], c[y][j]).sum())
    return low / (int(c.sum()) - low)


def _fetcher(docs: DataFrame, nodes: DataFrame, key: str, text: str):
    """nodes -> node, content: the text of one document of each node."""
    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes.select("node", "first.key", "first.th"), "node")
        return (fetched(rows_of(docs, key, text), wanted, ["key", "th"])
                .groupBy("node").agg(F.first("text").alias("content")))

    return fetch


def _verifier(fetch):
    """Keeps pairs of nodes whose texts overlap enough."""
    @lean
    def run(batches):
        for batch in batches:
            keep = [similarity(x, y) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = written(fetch(wanted), "texts")

        def of(side):
            return texts.select(F.col("node").alias(side), F.col("content").alias(f"t_{side}"))

        return (pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "t_a", "t_b")
                .mapInArrow(run, "a bigint, b bigint"))

    return verify


def across(texts: list[str]):
    """Exact overlaps of one text with many of a block: counts of the one laid
    out by shingle, the others' shingles looked up in it."""
    own, s, c = multisets(texts)
    number = np.unique(s, return_inverse=True)[1]
    begin = np.searchsorted(own, np.arange(len(texts) + 1))
    total = np.bincount(own, c, minlength=len(texts)).astype(np.int64)
    counts = np.zeros(int(number.max()) + 1 if len(number) else 1, np.int64)

    def link(x: int, others: np.ndarray) -> np.ndarray:
        mine = slice(begin[x], begin[x + 1])
        counts[number[mine]] = c[mine]
        size = begin[others + 1] - begin[others]
        at = ranges(begin[others], size)
        low = np.bincount(np.repeat(np.arange(len(others)), size), np.minimum(counts[number[at]], c[at]), minlength=len(others))
        counts[number[mine]] = 0
        return low >= THRESHOLD * (total[x] + total[others] - low) - 1e-9

    return link, None


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: key, th, class_id, first_key, first_th;
    verified links a, b that connect the distinct texts of every class).

    class_id is the smallest id of the class; (first_key, first_th) is the
    row that stands for it: the smallest id, nulls last, then the smallest
    hash.
    """
    rows = written(sketch(docs, key, text), "sketches")
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "th")
    nodes = written(rows.groupBy("words").agg(F.min(place).alias("first"), F.first("buckets").alias("buckets"),
                                              F.first("sketch").alias("sketch"))
                    .withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select(F.explode("buckets").alias("bucket"), "node")
    fetch = _fetcher(docs, nodes, key, text)
    links, groups = linked(buckets, nodes.select("node", "sketch"), near, M, _verifier(fetch), fetch, across)
    rooted = (nodes.select("words", "node", "first").join(groups, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    first = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.join(first, "root").select("words", F.col("head.key").alias("first_key"), F.col("head.th").alias("first_th"))
    return (rows.select("key", "th", "words").join(named, "words")
            .select(F.col("key").alias(key), "th", F.col("first_key").alias("class_id"), "first_key", "first_th")), links


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each class: the one that stands for it."""
    of, _ = classes(docs, key, text)
    gone = of.where(~(F.col(key).eqNullSafe(F.col("first_key")) & (F.col("th") == F.col("first_th")))) \
        .select(F.col(key).alias("_key"), F.col("th").alias("_th")).distinct()
    th = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    name = unused(docs, "text_hash")
    left = docs.withColumn(name, th)
    gone = written(gone, "gone")
    gone = F.broadcast(gone) if small(gone, 24) else gone
    kept = left.join(gone, left[key].eqNullSafe(gone["_key"]) & (left[name] == gone["_th"]), "left_anti")
    return kept.dropDuplicates([key, name]).drop(name)
