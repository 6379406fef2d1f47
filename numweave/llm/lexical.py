"""Ranked lexical search: the best documents of every item by summed impacts.

The impact of a term in a document grows with its occurrences and falls with
the document's length; the score of a document is the sum of weight * impact
over the item's distinct terms, in integers (see ``impact``).

1. One pass over all texts notes each document's length and the impacts of the
   terms that any item holds; counts over all documents give the weights.
2. A first bound per item: some documents that hold its rarest terms are scored
   in full. The k-th best of those scores is a bound no result lies below.
   Terms that all together stay below it need no posting list for that item;
   the others are its essential terms.
3. Per-term geometric blocking: the postings of an essential term are laid out
   by document similarity (the heaviest other coordinates of the document, in
   order) and cut into blocks of ``BLOCK``. A block stores its documents with
   the coordinates that can matter where its term is asked for, and a summary:
   the maximum of every coordinate.
4. An item skips a block of its term only if the weighted summary is below the
   item's bound. What is left is scored exactly; a document that stands in
   several of an item's lists is scored in the first one only.

Items are worked on in blocks of bounded size, so their terms can go to every
task. A hot term's list is dealt out by those coordinates, and its
blocks are made by many tasks.

Null or empty texts have no terms and do not count as documents. Rows with
equal ids are documents (items) of their own; null ids come last among equal
scores. Items without terms, and empty tables, give no rows. Terms are compared
by 64-bit hashes of their bytes. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import top_k_per_group
from .bpe import chunks, ranges
from .scratch import fetched, written
from .words import word_hashes

BLOCK = 128                    # postings of a block
CLUSTER_KEYS = 3               # heaviest coordinates that order the postings of a list
PART = 4096                    # a list of more documents is dealt out by them, about so many together
DOCS = 512                     # documents whose postings are made at a time
SEEDS = 32                     # times k: documents scored for the first bound, about
ITEM_CHARS = 8 << 20           # characters of the items worked on at a time
CHUNK_CHARS = 1 << 19
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, occurrences) of all distinct terms, and the
    number of terms of every text."""
    h, n = word_hashes([t.encode("utf-8", "replace").translate(_TERM_BYTES) for t in texts])
    own = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return own[at], h[at], np.diff(np.append(at, len(h))), n


def length_share(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """100 - 50 + (50 * n * docs) div terms."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // terms for x in n], np.int64)
    return 50 + 50 * n.astype(np.int64) * docs // max(terms, 1)


def impact(tf: np.ndarray, share: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * share)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Items:
    """Items of one block: their distinct terms as numbers into ``vocabulary``."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        own, h, _, _ = term_counts(texts)
        vocabulary, number = np.unique(h, return_inverse=True)
        cut = np.searchsorted(own, np.arange(len(texts) + 1))
        return cls(ids, [number[a:b] for a, b in zip(cut[:-1], cut[1:])], vocabulary)


def forward(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """node, key, n (terms of the text), terms (numbers into the vocabulary,
    ascending), tf."""
    def run(batches):
        for batch in batches:
            texts, row = batch.column(1).to_pylist(), 0
            for group in chunks(texts, CHUNK_CHARS):
                own, h, tf, n = term_counts(group)
                at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                cut = np.concatenate([[0], np.cumsum(np.bincount(own[hit], minlength=len(group)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(group)), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(at[hit].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(tf[hit].astype(np.int64)))], names=["key", "n", "terms", "tf"])
                row += len(group)

    kind = docs.schema[key].dataType.simpleString()
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return (docs.select(docs[key].alias("key"), t.alias("text"))
            .mapInArrow(run, f"key {kind}, n bigint, terms array<int>, tf array<bigint>")
            .withColumn("node", F.monotonically_increasing_id()))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, borders of the lists, from 0) of a list column without nulls."""
    cut = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), cut - cut[0]


def packed(coords: np.ndarray, impacts: np.ndarray, width: int) -> np.ndarray:
    """(coordinate, impact) pairs as ``width`` bytes each; impacts are below 2^20."""
    whole = coords.astype(np.uint64) << np.uint64(20) | impacts.astype(np.uint64)
    return np.ascontiguousarray(whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpacked(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    cells = np.zeros((len(raw) // width, 8), np.uint8)
    cells[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    whole = cells.view("<u8").ravel()
    return (whole >> np.uint64(20)).astype(np.int64), (whole & np.uint64((1 << 20) - 1)).astype(np.int64)


class Plan:
    """What every task knows of a block of items: weights, the size of the
    collection, bounds and, per item, its terms from the heaviest down."""

    def __init__(self, items: Items, docs: int, terms: int, df: np.ndarray):
        self.docs, self.total, self.size = docs, terms, len(items.vocabulary)
        self.width = 5 if self.size <= 1 << 20 else 6
        self.weight = np.array([weight(docs, int(x)) if x else 0 for x in df], np.int64)
        self.df = df
        self.terms = [t[np.lexsort((t, -self.weight[t]))] for t in items.terms]
        self.bound = np.ones(len(self.terms), np.int64)             # results score at least 1

    def seeds(self, k: int) -> dict[int, list[tuple[int, float]]]:
        """term -> (item, share of its documents): the rarest terms of every
        item, down to where they name about SEEDS * k documents."""
        out: dict[int, list[tuple[int, float]]] = {}
        for q, terms in enumerate(self.terms):
            left = SEEDS * k
            for t in terms[self.weight[terms] > 0].tolist():
                if self.df[t] and left > 0:
                    out.setdefault(t, []).append((q, min(1.0, left / self.df[t])))
                    left -= int(self.df[t])
        return out

    def essential(self, most: np.ndarray) -> None:
        """Per item how many terms, from the heaviest upper bound down, need
        lists: the rest together stays below the item's bound."""
        self.order, self.lists = [], {}
        for q, terms in enumerate(self.terms):
            upper = self.weight[terms] * most[terms]
            by = np.lexsort((terms, -upper))
            terms, upper = terms[by], upper[by]
            rest = np.cumsum(upper[::-1])[::-1]                      # of this term and all after it
            need = int((rest >= self.bound[q]).sum())
            self.order.append(terms[:need])
            for place, t in enumerate(terms[:need].tolist()):
                self.lists.setdefault(t, []).append((q, place))
        #: the coordinates that matter in a list: terms of the items that ask for it
        self.beside = {t: np.unique(np.concatenate([self.terms[q] for q, _ in asked])) for t, asked in self.lists.items()}

    def places(self, q: int) -> np.ndarray:
        """Term -> place among the item's essential terms, large for others."""
        out = np.full(self.size, 1 << 30, np.int64)
        out[self.order[q]] = np.arange(len(self.order[q]))
        return out

    def weights(self, q: int) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        out[self.terms[q]] = self.weight[self.terms[q]]
        return out


def first_scores(fwd: DataFrame, plan: Plan, k: int) -> DataFrame:
    """item, score of about SEEDS * k documents per item."""
    seeds = plan.seeds(k)

    def run(batches):
        for batch in batches:
            n, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (terms, cut), (tf, _) = flat(batch.column(2)), flat(batch.column(3))
            own = np.repeat(np.arange(len(n)), np.diff(cut))
            value = impact(tf, length_share(n, plan.docs, plan.total)[own])
            asked: dict[int, set] = {}
            luck = (node * np.int64(0x9E3779B97F4A7C1) >> np.int64(11) & np.int64((1 << 40) - 1)) / float(1 << 40)
            for i in np.flatnonzero(np.isin(terms, np.fromiter(seeds, np.int64, len(seeds)))).tolist():
                for q, share in seeds[int(terms[i])]:
                    if share >= 1 or luck[own[i]] < share:
                        asked.setdefault(q, set()).add(int(own[i]))
            item, score = [], []
            for q, rows in asked.items():
                w = plan.weights(q)
                for r in rows:
                    a, b = cut[r], cut[r + 1]
                    item.append(q)
                    score.append(int((w[terms[a:b]] * value[a:b]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64())], names=["item", "score"])

    return fwd.select("n", "node", "terms", "tf").mapInArrow(run, "item int, score bigint")


class Beside:
    """Which coordinates matter in which list: a hashed set of (list, term)
    pairs. It may hold a pair too many, which costs a little room and changes
    no result."""

    def __init__(self, pairs: dict[int, np.ndarray]):
        total = sum(map(len, pairs.values()))
        self.bits = min(28, max(10, (16 * total).bit_length()))
        self.held = np.zeros(1 << self.bits, bool)
        for t, c in pairs.items():
            self.held[self._at(np.full(len(c), t), c)] = True

    def _at(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def holds(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.held[self._at(t, c)]


def postings(fwd: DataFrame, plan: Plan) -> DataFrame:
    """place (term and part of its list), heavy (number made of the heaviest
    other coordinates), node, cells (coordinates and impacts): a document stands
    in the list of the first of its essential terms for every item."""
    def run(batches):
        known = np.zeros(plan.size, bool)
        known[list(plan.lists)] = True
        upto = np.zeros(plan.size + 1, np.int64)
        for t, x in plan.lists.items():
            upto[t + 1] = len(x)
        upto = np.cumsum(upto)
        asked = np.zeros(int(upto[-1]), np.int64)                    # of every list: item << 20 | place of the term
        for t, x in plan.lists.items():
            asked[upto[t]:upto[t + 1]] = [q << 20 | place for q, place in x]
        start = np.cumsum([0, *map(len, plan.order)])
        orders = np.concatenate([*plan.order, np.zeros(0, np.int64)]).astype(np.int64)
        beside = Beside(plan.beside)
        parts = np.maximum(plan.df // PART, 0) + 1
        for whole in batches:
            for row in range(0, whole.num_rows, DOCS):
                batch = whole.slice(row, DOCS)
                n = batch.column(0).to_numpy()
                (terms, cut), (tf, _) = flat(batch.column(2)), flat(batch.column(3))
                own = np.repeat(np.arange(len(n)), np.diff(cut))
                value = impact(tf, length_share(n, plan.docs, plan.total)[own])
                held = np.flatnonzero(known[terms])
                count = upto[terms[held] + 1] - upto[terms[held]]
                wants = np.sort(np.repeat(own[held], count) << 46 | asked[ranges(upto[terms[held]], count)])
                pair = wants >> 20                                   # document, item
                new = np.ones(len(pair), bool)
                new[1:] = pair[1:] != pair[:-1]
                wants = wants[new]                                   # the first of its terms for every item
                found = np.unique((wants >> 46) << 32 | orders[start[wants >> 20 & ((1 << 26) - 1)] + (wants & ((1 << 20) - 1))])
                doc, term = found >> 32, found & 0xFFFFFFFF
                size = np.diff(cut)[doc]
                at, of = ranges(cut[doc], size), np.repeat(np.arange(len(doc)), size)
                pick = beside.holds(term[of], terms[at])
                at, of = at[pick], of[pick]
                coords, worth = terms[at].astype(np.int64), value[at]
                size = np.bincount(of, minlength=len(doc))
                begin = np.cumsum(size) - size
                rank = ((plan.weight[coords] * worth >> 8) << 24 | coords & 0xFFFFFF) * (coords != term[of])
                heavy = np.zeros(len(doc), np.int64)
                for _ in range(CLUSTER_KEYS if len(doc) else 0):
                    top = np.maximum.reduceat(rank, begin)
                    heavy = heavy << 20 | top & 0xFFFFF
                    rank[rank == top[of]] = 0
                spread = batch.column(1).to_numpy()[doc]
                part = np.abs(heavy * 31 + (spread & 7) * (parts[term] > 8)) % parts[term]
                cells = packed(coords, worth, plan.width).reshape(-1)
                ends = np.append(begin, len(of)) * plan.width
                yield pa.RecordBatch.from_arrays([
                    pa.array(term << 32 | part), pa.array(heavy), pa.array(spread),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])],
                    names=["place", "heavy", "node", "cells"])

    return (fwd.select("n", "node", "terms", "tf").mapInArrow(run, "place bigint, heavy bigint, node bigint, cells binary"))


def blocks(rows: DataFrame, width: int, size: int | None = None) -> DataFrame:
    """The index: block, term, nodes, ends (of each document's cells), cells,
    top_coords, top (largest impact of each)."""
    size = size or BLOCK

    def made(term, held):
        cells = b"".join(h[2] for h in held)
        coords, value = unpacked(cells, width)
        top_coords, number = np.unique(coords, return_inverse=True)
        top = np.zeros(len(top_coords), np.int64)
        np.maximum.at(top, number, value)
        return (term, np.concatenate([h[0] for h in held]), np.cumsum(np.concatenate([h[1] for h in held])) // width, cells, top_coords, top)

    def rows_out(out):
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)],
                                          names=["term", "nodes", "ends", "cells", "top_coords", "top"])

    def run(batches):
        held, count, term = [], 0, None
        for batch in batches:
            out, terms, node = [], batch.column(0).to_numpy() >> 32, batch.column(1).to_numpy()
            cells = batch.column(2)
            cut = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1].astype(np.int64)
            raw, a = memoryview(cells.buffers()[2] or b""), 0
            while a < len(terms):
                if held and terms[a] != term:
                    out.append(made(term, held))
                    held, count = [], 0
                term = int(terms[a])
                b = min(a + size - count, int(np.searchsorted(terms, term, "right")))
                held.append((node[a:b].copy(), np.diff(cut[a:b + 1]), bytes(raw[cut[a]:cut[b]])))
                count, a = count + b - a, b
                if count == size:
                    out.append(made(term, held))
                    held, count = [], 0
            if out:
                yield rows_out(out)
        if held:
            yield rows_out([made(term, held)])

    return (rows.repartition("place").sortWithinPartitions("place", "heavy", "node").select("place", "node", "cells")
            .mapInArrow(run, "term int, nodes array<bigint>, ends array<int>, cells binary, top_coords array<int>, top array<int>")
            .withColumn("block", F.monotonically_increasing_id()))


def surviving(index: DataFrame, plan: Plan) -> DataFrame:
    """block, items (those whose bound the block's summary reaches)."""
    def run(batches):
        weights: dict[int, tuple] = {}
        for q, t in enumerate(plan.terms):
            by = np.argsort(t)
            weights[q] = (t[by], plan.weight[t[by]])
        for batch in batches:
            term = batch.column(1).to_numpy()
            (coords, cut), (top, _) = flat(batch.column(2)), flat(batch.column(3))
            block, items = [], []
            for r in range(len(term)):
                c, v = coords[cut[r]:cut[r + 1]], top[cut[r]:cut[r + 1]].astype(np.int64)
                reach = []
                for q, _ in plan.lists.get(int(term[r]), ()):
                    t, w = weights[q]
                    at = np.minimum(np.searchsorted(c, t), len(c) - 1)
                    if int((w * v[at] * (c[at] == t)).sum()) >= plan.bound[q]:
                        reach.append(q)
                if reach:
                    block.append(batch.column(0)[r].as_py())
                    items.append(reach)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(items, pa.list_(pa.int32()))], names=["block", "items"])

    return index.select("block", "term", "top_coords", "top").mapInArrow(run, "block bigint, items array<int>")


def scored(index: DataFrame, plan: Plan, k: int) -> DataFrame:
    """item, score, node of the documents in the blocks that each item reads,
    the k best of a batch of blocks per item and what equals the last of them."""
    def run(batches):
        weights, places = {}, {}
        for batch in batches:
            found: dict[int, list] = {}
            term = batch.column(0).to_numpy()
            for r in range(len(term)):
                nodes, ends = (batch.column(i)[r].values.to_numpy() for i in (1, 2))
                coords, value = unpacked(batch.column(3)[r].as_py(), plan.width)
                begin = np.concatenate([[0], ends[:-1]])
                for q in batch.column(4)[r].as_py():
                    if q not in weights:
                        weights[q], places[q] = plan.weights(q), plan.places(q)
                    score = np.add.reduceat(weights[q][coords] * value, begin)
                    first = np.minimum.reduceat(places[q][coords], begin)
                    good = (score >= plan.bound[q]) & (first == places[q][term[r]])
                    if good.any():
                        found.setdefault(q, []).append((score[good], nodes[good]))
            out = []
            for q, parts in found.items():
                score, node = (np.concatenate([p[i] for p in parts]) for i in range(2))
                last = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0
                keep = score >= last                                 # ties stay: the ids decide later
                out.append((np.full(int(keep.sum()), q, np.int32), score[keep], node[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["item", "score", "node"])

    return (index.select("term", "nodes", "ends", "cells", "items").mapInArrow(run, "item int, score bigint, node bigint"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of every item: item, rank, key, score."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    asked = items.select(items[item].alias("id"), F.coalesce(items[item_text].cast("string"), F.lit("")).alias("text"))
    parts = math.ceil((asked.agg(F.sum(F.length("text") + 64)).first()[0] or 0) / ITEM_CHARS)
    out = []
    for p in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()    # about ITEM_CHARS characters
        block = Items.of([r["id"] for r in rows], [r["text"] for r in rows])
        fwd = written(forward(docs, block.vocabulary, key, text), "forward", "zstd")
        best = top_k_per_group(_block(fwd, block, k), ["item"], [-F.col("score"), F.col("key").isNull(), F.col("key"), F.col("node")], k, rank_col="rank")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, id {items.schema[item].dataType.simpleString()}")
        out.append(best.join(names, "item").select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"))
    if not out:
        return items.sparkSession.createDataFrame([], f"{item} {items.schema[item].dataType.simpleString()}, rank int, {key} {kind}, score bigint")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _block(fwd: DataFrame, items: Items, k: int) -> DataFrame:
    n, total = fwd.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = fwd.select("n", F.explode(F.arrays_zip("terms", "tf")).alias("p"))
    share = F.lit(50) + F.call_function("div", F.lit(50) * F.col("n") * F.lit(n), F.lit(max(total, 1)))
    tf = F.col("p.tf")
    worth = F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(20) * share)
    df, most = np.zeros(len(items.vocabulary), np.int64), np.zeros(len(items.vocabulary), np.int64)
    for r in each.groupBy("p.terms").agg(F.count(F.lit(1)).alias("df"), F.max(worth).alias("most")).collect():   # terms of these items
        df[r["terms"]], most[r["terms"]] = r["df"], r["most"]
    plan = Plan(items, n, total, df)
    ranked = first_scores(fwd, plan, k).groupBy("item").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    for r in ranked.select("item", F.get("s", F.lit(k - 1)).alias("b")).where("b is not null").collect():
        plan.bound[r["item"]] = max(1, r["b"])
    plan.essential(most)
    index = written(blocks(postings(fwd, plan), plan.width), "term-blocks", "zstd")
    wanted = surviving(index, plan)
    found = written(scored(fetched(index, wanted, ["block"], 64), plan, k), "scored")
    return found.join(fwd.select("node", "key"), "node")
