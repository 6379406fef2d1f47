"""Toxicity by class-conditional Kneser-Ney models.

Two letter n-gram models of words, one per class, share their lower orders:
interpolated Kneser-Ney, whose continuation counts are pooled over the
classes. A sequence neither class has seen thus backs off to the same
estimate, and only the classes' back-off weights differ. A word's evidence is
the difference of its two log-likelihoods; a document's features are its
length-normalised evidence (mean per word, share and number of words with
strong evidence, strongest word). A logistic curve over these gives a score
from 0 to 1. It is fitted on labelled documents that the counts leave out at
first, as many as it needs; then their counts are added.

Counts come from all labelled documents of the training side and are joined
and summed by Spark. What every executor gets is a table of all sequences, 12
bytes each, and of all contexts; nothing is left out of it, so it grows with
the number of distinct sequences (not with the texts).

Null and empty texts have no words: all features are 0. Rows are scored one by
one, so repeated rows get equal scores. Of several labels of a document the
largest counts. Documents with a null id are never trained on and not held
out. Without labels of both classes every score is 0. Nothing but id and text
is read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, filtered, lean, written
from .words import mix

ORDER = 6                      # letters per sequence
DISCOUNT = 0.75                # taken off every count
STRONG = 4.0                   # evidence from which a word counts as strong
FIT_PARTS = 5                  # at most one of so many training documents fits the curve
MAX_CALIBRATION_ROWS = 20_000  # bound of the sample the curve is fitted on
THRESHOLD = 0.7                # a score from here on means toxic
BEFORE, AFTER = "\x02", "\x03" # stand before and after every word
WORD_CACHE = 200_000
FEATURES = 5


def held_out(key):
    """crc32 of the id as text, remainder 1 of 3; false for null."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))


def _fits_curve(key, labelled: int):
    """The documents the curve is fitted on: a share of the ``labelled`` ones
    that is about MAX_CALIBRATION_ROWS on large tables, by a hash threshold."""
    share = min(1 / FIT_PARTS, MAX_CALIBRATION_ROWS / max(labelled, 1))
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))


def _labelled(docs: DataFrame, labels: DataFrame, chosen, key: str, text: str) -> DataFrame:
    """text, toxic of the chosen documents. The choice is made on both sides
    before the join, so other texts are not shuffled."""
    mark = labels.where(labels["toxic"].isNotNull()).groupBy(labels[key].alias("k")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text"))
    return (rows.where(chosen(F.col("k"))).join(mark.where(chosen(F.col("k"))), "k")
            .select("text", (F.col("toxic") > 0).alias("toxic")))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, ordinary, toxic: occurrences per class; summed inside tasks first."""

    @lean
    def run(batches):
        from collections import Counter

        counts = (Counter(), Counter())

        def emit():
            for c in (0, 1):
                if counts[c]:
                    n = np.fromiter(counts[c].values(), np.int64, len(counts[c]))
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counts[c])), pa.array(zero if c else n), pa.array(n if c else zero)],
                        names=["word", "ordinary", "toxic"])
                    counts[c].clear()

        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(words_of(t or ""))
            if len(counts[0]) + len(counts[1]) > WORD_CACHE:
                yield from emit()
        yield from emit()

    return (rows.mapInArrow(run, "word string, ordinary bigint, toxic bigint")
            .groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))


def sequences(words: DataFrame, order: int = ORDER) -> DataFrame:
    """g (order letters), ordinary, toxic: counts per class over padded words."""
    padded = F.concat(F.lit(BEFORE * (order - 1)), "word", F.lit(AFTER))
    return (words.withColumn("p", padded)
            .select(F.explode(F.expr(f"transform(sequence(1, length(p) - {order - 1}), i -> substring(p, i, {order}))"))
                    .alias("g"), "ordinary", "toxic")
            .groupBy("g").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))


def pooled_backoff(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """s (order - 1 letters), p: Kneser-Ney estimate of its last letter, from
    continuation counts pooled over the classes, all orders down to one letter.

    A context has at most one row per letter, so the windows are small.
    """
    levels = []
    cur = grams.select(F.col("g").alias("s"))
    for n in range(order - 1, 0, -1):
        cur = cur.groupBy(F.expr("substring(s, 2)").alias("s")).agg(F.count(F.lit(1)).alias("c"))
        levels.append((n, cur))
    below = None
    for n, level in reversed(levels):
        context = F.expr(f"substring(s, 1, {n - 1})")
        if n == 1:
            total = level.agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
            level = level.join(F.broadcast(total))                    # one row
            lower = F.lit(1.0) / (F.col("k") + 1)
        else:
            w = Window.partitionBy(context)
            level = (level.withColumn("t", F.sum("c").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
                     .withColumn("tail", F.expr("substring(s, 2)"))
                     .join(below.select(F.col("s").alias("tail"), F.col("p").alias("q")), "tail"))
            lower = F.col("q")
        below = level.select("s", ((F.col("c") - DISCOUNT) / F.col("t")
                                   + DISCOUNT * F.col("k") / F.col("t") * lower).alias("p"))
    return below


def evidence(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """g, h (context), n, value: log p(last letter | context, toxic) - the same
    for ordinary; rest: the value of letters the context never had."""
    w = Window.partitionBy("h")
    g = grams.withColumn("h", F.expr(f"substring(g, 1, {order - 1})"))
    for c in ("ordinary", "toxic"):
        g = (g.withColumn(f"t_{c}", F.sum(c).over(w))
             .withColumn(f"k_{c}", F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(w)))
    g = g.withColumn("s", F.expr("substring(g, 2)")).join(pooled_backoff(grams, order), "s")

    def weight(c):                                    # mass left for the shared lower orders
        return F.when(F.col(f"t_{c}") > 0, DISCOUNT * F.col(f"k_{c}") / F.col(f"t_{c}")).otherwise(F.lit(1.0))

    def prob(c):
        own = F.when(F.col(c) > 0, (F.col(c) - DISCOUNT) / F.col(f"t_{c}")).otherwise(F.lit(0.0))
        return own + weight(c) * F.col("p")

    return g.select("g", "h", (F.col("ordinary") + F.col("toxic")).alias("n"),
                    F.log(prob("toxic") / prob("ordinary")).alias("value"),
                    F.log(weight("toxic") / weight("ordinary")).alias("rest"))


class Cells:
    """Value of every 64-bit key, none left out: entries in order of their keys,
    and the first entry of every cell, which a key's upper bits name."""

    def __init__(self, key: np.ndarray, value: np.ndarray, cells: int):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(np.float32)
        if len(key) > 1 and (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two letter sequences have the same 64-bit key")
        self.bits = max(cells - 1, 1).bit_length()
        self._index()

    def _index(self):
        cell = (self.key >> np.uint64(64 - self.bits)).astype(np.int64)
        count = np.bincount(cell, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.uint32)
        self.most = int(count.max())

    def __getstate__(self):
        """The first entries are counted again where the table arrives."""
        return {"key": self.key, "value": self.value, "bits": self.bits}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def __array__(self, dtype=None, copy=None):
        return np.column_stack([self.key, self.value.view(np.uint32)]).astype(dtype or np.uint64)


class Model:
    """The model tables and the curve, sent to every executor."""

    def __init__(self, cells: Cells, rests: Cells, order: int, curve: np.ndarray | None = None):
        self.cells, self.rests, self.order, self.curve = cells, rests, order, curve
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def _values(self, words: list[str]) -> np.ndarray:
        """Evidence of words: the sum over their sequences."""
        n = self.order
        points = letters("".join(BEFORE * (n - 1) + w + AFTER for w in words))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1          # sequences per word
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat((n - 1) * np.arange(len(words)), size)
        window = np.lib.stride_tricks.sliding_window_view(points, n)[at]
        found, value = probe(self.cells, letter_keys(window))
        missing = np.flatnonzero(~found)
        value[missing] = probe(self.rests, letter_keys(window[missing, :-1]))[1]
        return np.add.reduceat(value, ends - size)

    def evidence(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if len(cache) + len(new) > WORD_CACHE:
                cache.clear()
                new = list(dict.fromkeys(words))
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                cache.update(zip(part, self._values(part).tolist()))
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def features(self, text: str | None) -> list[float]:
        words = words_of(text or "")
        if not words:
            return [0.0] * FEATURES
        e = self.evidence(words)
        strong = int((e > STRONG).sum())
        return [float(e.mean()), float(e.max()), float(np.log1p(strong)), 20.0 * strong / len(words),
                float(np.log(len(words)))]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(features))
        z = np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letter_keys(rows: np.ndarray) -> np.ndarray:
    """64 bits for every row of letters."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for j in range(rows.shape[1]):
        h = (h + rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def probe(cells: Cells, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of every key."""
    found, value = np.zeros(len(key), bool), np.zeros(len(key))
    cell = (key >> np.uint64(64 - cells.bits)).astype(np.int64)
    at, stop = cells.first[cell].astype(np.int64), cells.first[cell + 1].astype(np.int64)
    left = np.flatnonzero(at < stop)
    for _ in range(cells.most):
        if not len(left):
            break
        hit = cells.key[at[left]] == key[left]
        there = left[hit]
        found[there], value[there] = True, cells.value[at[there]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < stop[left]]
    return found, value


def _table(rows: DataFrame, text: str, weight: str, value: str, cells: int | None = None) -> Cells:
    """All sequences with their values; by default as many cells as there are
    sequences. ``weight`` names the occurrences and decides nothing."""
    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).to_pylist()
                k = letter_keys(letters("".join(texts)).reshape(len(texts), -1))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column(1)], names=["k", "v"])

    got = rows.select(text, F.col(value).cast("float")).mapInArrow(run, "k bigint, v float").toArrow()
    return Cells(got["k"].to_numpy().view(np.uint64), got["v"].to_numpy(), cells or max(got.num_rows, 2))


def train(docs: DataFrame, labels: DataFrame, chosen=None, key: str = "doc_id", text: str = "text",
          order: int = ORDER, cells: int | None = None, context_cells: int | None = None) -> Model:
    """Counts, table and curve from the labelled documents ``chosen`` (a
    condition on the id) allows; default: those that are not held out."""
    chosen = chosen or (lambda k: ~held_out(k))
    rows = labels.where(labels["toxic"].isNotNull() & chosen(labels[key])).select(F.count_distinct(labels[key])).first()[0]
    fit = _labelled(docs, labels, lambda k: chosen(k) & ~_fits_curve(k, rows), key, text)
    check = written(_labelled(docs, labels, lambda k: chosen(k) & _fits_curve(k, rows), key, text), "toxicity-curve")
    grams = written(sequences(_word_counts(fit), order), "toxicity-counts")
    both = written(grams.unionByName(sequences(_word_counts(check), order))
                   .groupBy("g").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    per_class = both.agg(F.sum("ordinary"), F.sum("toxic")).first()
    if not per_class[0] or not per_class[1]:
        none = Cells(np.zeros(0, np.uint64), np.zeros(0), 2)
        return Model(none, none, order)
    model = _model(grams, order, cells, context_cells)
    discard(grams)
    sample = (_features(check, model).orderBy(F.xxhash64("f"), "f").limit(MAX_CALIBRATION_ROWS).toArrow())
    discard(check)
    f = np.array(sample["f"].to_pylist(), np.float64).reshape(-1, FEATURES)
    curve = fit_curve(f, sample["toxic"].to_numpy(zero_copy_only=False).astype(float))
    model = _model(both, order, cells, context_cells)
    discard(both)
    model.curve = curve
    return model


def _model(grams: DataFrame, order: int, cells: int | None, context_cells: int | None) -> Model:
    table = written(evidence(grams, order), "toxicity-evidence")
    rests = table.groupBy("h").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    model = Model(_table(table, "g", "n", "value", cells), _table(rests, "h", "n", "rest", context_cells), order)
    discard(table)
    return model


def _features(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)          # 12 bytes for every sequence and context

    @lean
    def run(batches):
        m = shared.value
        for batch in batches:
            f = [m.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    return rows.mapInArrow(run, "f array<double>, toxic boolean")


def fit_curve(f: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Intercept and weights of a ridge logistic curve over the features, moved
    so that the cut with the best F1 on these rows lies at THRESHOLD."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, spread = f.mean(0), f.std(0) + 1e-9
    x = np.column_stack([np.ones(len(f)), (f - mean) / spread])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    order = np.argsort(-(x @ w), kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    z = (x @ w)[order]
    cut = (z[best] + z[min(best + 1, len(z) - 1)]) / 2
    slope = w[1:] / spread
    return np.concatenate([[w[0] - slope @ mean - cut + np.log(THRESHOLD / (1 - THRESHOLD))], slope])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score double, predicted int: one pass over the texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        m = shared.value
        for batch in batches:
            f = np.array([m.features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, FEATURES)
            s = m.score(f)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key))


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts):
        m = shared.value
        return m.score(np.array([m.features(t) for t in texts], np.float64).reshape(-1, FEATURES)) < THRESHOLD

    return filtered(docs, judge, text)
