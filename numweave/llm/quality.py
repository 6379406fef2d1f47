"""Quality rules: fixed base rules and a learned decision list.

``measures`` counts properties of every whole text. ``learn`` grows a list of
rules, each a conjunction of thresholds on shares of those counts, by
sequential covering: grow a rule condition by condition for the largest
information gain, prune its tail on rows set apart, remove the rows it covers,
go on. ``verdict`` writes the list as one ordered Spark conditional expression.

Null and empty texts have no words: all counts are 0 and the base rules reject
them. Each row is measured alone, so repeated rows get equal results. Rows of
labels with a null id or mark are left out; of several labels of a document
the smallest counts. Without labels of both kinds the list is empty and keeps
everything that passes the base rules. Only id and text are read.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import lean, unused

SYMBOLS = "#*$%&|<>"           # fixed by the definition of n_symbols
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SAMPLE_ROWS = 50_000       # bound of the labelled rows the list is learned from
CANDIDATE_CUTS = 128           # thresholds tried per property and condition
MAX_RULES, MAX_CONDITIONS = 16, 4
MIN_PRECISION = 0.9            # of a rule on the pruning rows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks")


@lru_cache(1)
def _letter_kinds() -> np.ndarray:
    """1 upper case, 2 digit, 3 other mark than SYMBOLS, 0 anything else."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        kind[c] = 1 if k == "Lu" else 2 if k[0] == "N" else 3 if k[0] in "PS" and chr(c) not in SYMBOLS else 0
    return kind


def repeated_words(codes: np.ndarray, size: int = WINDOW_WORDS) -> int:
    """Words in windows of ``size`` that occur at least twice, given a number
    per distinct word. Window numbers double their width, so equal numbers are
    equal windows; size is a power of two."""
    n = len(codes)
    if n <= size:
        return 0
    rank, width = codes.astype(np.int64), 1
    while width < size:
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    hit = np.bincount(rank)[rank] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()                                # on the six ASCII blanks only
    n = len(words)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_letter_kinds()[points], minlength=4)
    blanks = int((points == 0x20).sum() + ((points >= 0x09) & (points <= 0x0D)).sum())
    return (n, len(points) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(codes), len(lines), len(number), int(kinds[1]), int(kinds[2]), int(kinds[3]))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the COUNTS of every text."""

    @lean
    def run(batches):
        for batch in batches:
            got = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, i]) for i in range(len(COUNTS)))],
                                             names=["key", *COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
            .withColumnRenamed("key", key))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def properties() -> dict[str, Column]:
    """The shares that rules may test."""
    def share(a, b):
        return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "upper_case": share("n_upper", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool                # value > cut, else value <= cut
    cut: float

    def of(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.cut if self.above else table[self.name] <= self.cut

    def column(self) -> Column:
        c = properties()[self.name]
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.4g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.of(table) for c in rule))


def _best_condition(table, bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain for the rows a rule covers so far:
    bad rows that stay times the growth of log precision."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    best = (1e-9, None)
    for name in sorted(table):
        v = table[name][inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[inside][order]
        ends = np.flatnonzero(v[1:] > v[:-1])          # places between different values
        if len(ends) > CANDIDATE_CUTS:
            ends = ends[np.linspace(0, len(ends) - 1, CANDIDATE_CUTS).astype(int)]
        if not len(ends):
            continue
        p_low = np.cumsum(b)[ends]
        n_low = ends + 1 - p_low
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
    return best


def grow(table, bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
        _, c = _best_condition(table, bad, inside)
        if c is None:
            break
        rule.append(c)
        inside &= c.of(table)
    return tuple(rule)


def prune(rule: Rule, table, bad: np.ndarray) -> tuple[Rule, float]:
    """The head of the rule with the best (bad - good) / covered on other
    rows, the shorter on ties, and its precision there."""
    best: tuple[float, Rule, float] = (-2.0, rule, 0.0)
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], table)
        n = int(hit.sum())
        precision = float(bad[hit].mean()) if n else 0.0
        if n and 2 * precision - 1 > best[0] + 1e-12:
            best = (2 * precision - 1, rule[:k], precision)
    return best[1], best[2]


def learn(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Sequential covering; every third row prunes, the others grow."""
    rules: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    left = np.ones(len(bad), bool)
    pruning = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        g, h = left & ~pruning, left & pruning
        if not bad[g].any():
            break
        sub = {k: v[g] for k, v in table.items()}
        rule = grow(sub, bad[g])
        if not rule:
            break
        rule, precision = prune(rule, {k: v[h] for k, v in table.items()}, bad[h])
        if precision < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, table)
    return rules


def train(measured: DataFrame, labels: DataFrame, chosen=None, key: str = "doc_id") -> list[Rule]:
    """The list from labelled rows (quality 0 is bad). At most MAX_SAMPLE_ROWS
    rows, chosen by a hash of the id, reach the driver."""
    mark = labels.where(labels["quality"].isNotNull()).groupBy(labels[key].alias("k")).agg(F.min("quality").alias("quality"))
    rows = measured.select(F.col(key).alias("k"), *COUNTS)
    if chosen is not None:
        rows, mark = rows.where(chosen(F.col("k"))), mark.where(chosen(F.col("k")))
    props = properties()
    sample = (rows.join(mark, "k").where(~base_failed())
              .select("k", (F.col("quality") <= 0).alias("bad"), *(c.alias(n) for n, c in props.items()))
              .orderBy(F.xxhash64("k"), "k").limit(MAX_SAMPLE_ROWS).toArrow())
    return learn({n: sample[n].to_numpy() for n in props}, sample["bad"].to_numpy(zero_copy_only=False))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that applies, from 1; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(i)).otherwise(out)
    return out


def describe(rules: list[Rule]) -> str:
    return "\n".join(f"{i}. reject if " + " and ".join(map(str, r)) for i, r in enumerate(rules, 1)) + "\nelse keep"


def judged(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the rejecting rule or 0), kept."""
    return (measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def kept(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and the list, all columns.

    Rows are measured where they are; the same conditional expression decides.
    """
    at = docs.columns.index(text)
    own = {c: unused(docs, c) for c in COUNTS}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(own[c], T.LongType()) for c in COUNTS)])

    @lean
    def run(batches):
        for batch in batches:
            got = np.array([measure(t) for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, i]) for i in range(len(COUNTS)))],
                                             names=schema.names)

    rows = docs.mapInArrow(run, schema)
    inner = rows.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), *(F.col(own[c]).alias(c) for c in COUNTS))
    return judged(inner, rules).where("kept").select("__row.*")
