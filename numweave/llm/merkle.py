"""Merkle manifest of a table: digests of all rows, trees over them, proofs.

A leaf is the digest of a row's fields. The leaves of one group (a language)
ascend by id; every ``FAN`` consecutive nodes become one node of the next level
(the last run may be shorter, even one node) until one is left, the group's
subroot. The subroots, ordered by group, make the root in the same way.

The manifest is content-addressed: a record maps a node's digest to the
digests ``PAGE`` levels below it, so a record has at most FAN ** PAGE children
and the levels between follow by hashing. A request for a leaf descends from
the root: the digits of its rank (base FAN) choose the child, the children that
are not chosen are collected, and the next record is looked up by the chosen
digest. Requests that share the beginning of their rank share the descent, so a
record is read once however many leaves below it are asked for. The collected
segments, reversed, are the proof from the leaf up. A record whose children do
not hash to its digest stops the run.

Ranks come from a range sort and prefix sums over (partition, group) counts;
rows equal in everything are interchangeable, and a hot group is many ranges
and many records. Everything is built from Spark's own expressions.

Null fields count as ``-``; the null group comes first; null ids come first
in their group; ids that repeat are ordered by their leaf. An empty table gives
no rows and no root. Columns besides the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

FAN = 2
PAGE = 10                       # levels below a record's digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: every field with its length in bytes."""
    return digest(F.concat(*[field(f) for f in fields]))


def group_key(value: Column) -> Column:
    """Never null, in the order of the values' bytes, null first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with g) and rank: the place in g by ``order``, from 0.

    Two passes: range-sorted rows are written with their partition and place;
    prefix sums over the counts per (g, partition) give the places in g.
    """
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
                     .withColumn("part", F.spark_partition_id()).withColumn("at", low), "ranked")
    counts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offset = counts.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return (placed.join(written(offset, "offsets"), ["g", "part"])
            .withColumn("rank", F.col("at") + F.col("offset")).drop("part", "at", "offset"))


def height(n: Column, fan: int) -> Column:
    """Levels above n leaves: the least h with fan ** h >= n."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fan
    return sum(((n > F.lit(p)).cast("int") for p in powers), F.lit(0))


def levels_of(children: Column, levels: Column, fan: int) -> Column:
    """[children, the level above, ..., the record's own digest] as arrays."""
    def up(c):
        runs = F.ceil(F.size(c) / F.lit(fan)).cast("int")
        return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(F.array_join(F.slice(c, i * fan + 1, fan), "")))

    return F.aggregate(F.sequence(F.lit(1), levels), F.array(children),
                       lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


@dataclass
class Tree:
    """Trees over the groups of ranked nodes. records[p]: digest -> children,
    for nodes (p + 1) * page levels above the leaves or, in the last record of
    a group, fewer; roots: g, n, h, digest."""

    records: list[DataFrame]
    roots: DataFrame
    fan: int
    page: int


def build(nodes: DataFrame, fan: int = FAN, page: int = PAGE) -> Tree:
    """nodes: g, rank, digest."""
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.withColumn("h", height(F.col("n"), fan)), "tree-sizes")
    top = sizes.agg(F.max("h")).first()[0] or 0
    nodes = nodes.select("g", "rank", "digest").join(sizes.select("g", "h"), "g")
    done, records = [nodes.where("h = 0").select("g", "digest")], []
    for p in range(-(-top // page)):
        depth = F.least(F.lit(page), F.col("h") - p * page)
        run = (nodes.where(F.col("h") > p * page)
               .groupBy("g", F.call_function("div", F.col("rank"), F.lit(fan ** page)).alias("rank"), "h")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("c")))           # at most fan ** page
        run = run.select("g", "rank", "h", depth.cast("int").alias("levels"), F.col("c.digest").alias("children"))
        run = written(run.withColumn("digest", F.get(F.element_at(levels_of(F.col("children"), F.col("levels"), fan), -1), F.lit(0))),
                      "tree-records")
        records.append(run.groupBy("digest").agg(F.first("levels").alias("levels"), F.first("children").alias("children")))
        done.append(run.where(F.col("h") <= (p + 1) * page).select("g", "digest"))
        nodes = run.select("g", "rank", "digest", "h")
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return Tree(records, written(sizes.join(roots, "g"), "tree-roots"), fan, page)


def descend(tree: Tree, start: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (g, rank, other columns) with node, the digest found at that
    rank, and path, what was not chosen on the way down: start's path (g, path)
    and then, level by level, (digit, siblings)."""
    fan, page = tree.fan, tree.page
    powers = F.array(*[F.lit(fan ** i).cast("bigint") for i in range(page + 1)])
    roots = tree.roots.join(start, "g").withColumn("pages", F.ceil(F.col("h") / F.lit(page)))
    found = requests.join(roots.where("h = 0").select("g", F.col("digest").alias("node"), "path"), "g")
    frontier = None
    for p in reversed(range(len(tree.records))):
        entry = roots.where(F.col("pages") == p + 1).select("g", F.lit(0).cast("bigint").alias("at"), "digest", "path")
        frontier = entry if frontier is None else frontier.unionByName(entry)
        child = F.call_function("div", F.col("rank"), F.lit(fan ** (page * p)))
        at = F.call_function("div", F.col("child"), F.lit(fan ** page))
        if p:
            wanted = requests.select("g", child.alias("child")).distinct().select("g", "child", F.struct("child").alias("ask"))
        else:
            wanted = requests.select("g", F.col("rank").alias("child"),
                                     F.struct(F.col("rank").alias("child"), *[c for c in requests.columns if c not in ("g", "rank")]).alias("ask"))
        wanted = wanted.groupBy("g", at.alias("at")).agg(F.collect_list("ask").alias("asked"))       # leaves of one record

        def segment(lv, levels, local):
            def one(i):
                step = levels - 1 - i                                                                # from the top down
                place = F.call_function("div", local, F.get(powers, step))
                digit = F.pmod(place, F.lit(fan)).cast("int")
                run = F.slice(F.get(lv, step), (place - digit).cast("int") + 1, F.lit(fan))
                return F.struct(digit.alias("digit"), F.concat(F.slice(run, F.lit(1), digit), F.slice(run, digit + 2, F.lit(fan))).alias("siblings"))

            return F.transform(F.sequence(F.lit(0), levels - 1), one)

        def answers(lv):
            sound = F.get(F.element_at(lv, -1), F.lit(0)) == F.col("digest")
            lv = F.when(sound, lv).otherwise(F.raise_error(F.lit("a record does not match its digest")).cast("array<array<string>>"))

            def answer(ask):
                local = ask["child"] - F.col("at") * F.lit(fan ** page)
                return F.struct(ask.alias("ask"), F.get(F.get(lv, F.lit(0)), local.cast("int")).alias("node"),
                                F.concat(F.col("path"), segment(lv, F.col("levels"), local)).alias("path"))

            return F.transform(F.col("asked"), answer)

        below = (frontier.join(wanted, ["g", "at"]).join(tree.records[p], "digest")
                 .select("g", F.explode(F.get(F.transform(F.array(levels_of(F.col("children"), F.col("levels"), fan)), answers), F.lit(0))).alias("a")))
        if p:
            frontier = written(below.select("g", F.col("a.ask.child").alias("at"), F.col("a.node").alias("digest"), "a.path"), "descent")
        else:
            found = found.unionByName(below.select(
                "g", F.col("a.ask.child").alias("rank"), *[F.col(f"a.ask.{c}").alias(c) for c in requests.columns if c not in ("g", "rank")],
                "a.node", "a.path"))
    return found


PATH = "array<struct<digit:int,siblings:array<string>>>"


@dataclass
class Manifest:
    """leaves: g, rank, key, leaf and further columns; groups and top: their
    trees; places: g, its rank among the groups; root: the digest of all (None
    without rows)."""

    leaves: DataFrame
    groups: Tree
    top: Tree
    places: DataFrame
    root: str | None


def manifest(leaves: DataFrame, key: str, group: str, fan: int = FAN, page: int = PAGE) -> Manifest:
    """leaves: a row per leaf with its key, group, ``leaf`` and more."""
    rows = written(leaves.withColumn("g", group_key(F.col(group))), "leaves")
    names = [c for c in rows.columns if c not in ("g", key, "leaf")]
    rows = written(ranked(rows, [key, "leaf", *names]), "leaves")
    groups = build(rows.select("g", "rank", F.col("leaf").alias("digest")), fan, page)
    places = ranked(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    places = written(places, "places")
    top = build(places.select("g", "rank", "digest"), fan, page)
    root = top.roots.first()
    return Manifest(rows, groups, top, places.select(F.col("name").alias("g"), F.col("rank").alias("place")), root and root["digest"])


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Proof of every requested leaf (rows of ``m.leaves``; all by default):
    the request's columns, node (the digest the manifest holds), subroot, and
    proof: (digit, siblings) from the leaf up to the root."""
    requests = m.leaves if requests is None else requests
    asked = m.places.join(requests.select("g").distinct(), "g").select(F.lit("").alias("g"), F.col("place").alias("rank"), F.col("g").alias("name"))
    none = m.top.roots.select("g").withColumn("path", F.array().cast(PATH))
    over = written(descend(m.top, none, asked).select(F.col("name").alias("g"), "path"), "descent")
    found = descend(m.groups, over, requests)
    subroots = m.groups.roots.select("g", F.col("digest").alias("subroot"))
    return found.join(subroots, "g").withColumn("proof", F.reverse("path")).drop("path")


def siblings(proof: Column) -> Column:
    """Digest of all siblings of a proof, leaf to root, left to right."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""))


def folded(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def step(cur, s):
        rest = F.size(s["siblings"]) - s["digit"]
        return digest(F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), s["digit"]), ""), cur,
                               F.array_join(F.slice(s["siblings"], s["digit"] + 1, F.greatest(rest, F.lit(0))), "")))

    return F.aggregate(proof, leaf_digest, step)


def audit(docs: DataFrame, tampered: Column, changed: dict[str, Column], key: str = "doc_id", group: str = "lang",
          fields=FIELDS, fan: int = FAN, page: int = PAGE) -> DataFrame:
    """Manifest of docs, and a check of every row against it after a change:
    rows where ``tampered`` holds are hashed again with the ``changed`` fields.

    key, leaf, subroot, root, proof_sha256, n_siblings, folded_root, verified.
    """
    own = {f: docs[f] for f in fields}
    again = F.when(tampered, leaf([changed.get(f, own[f]) for f in fields])).otherwise(leaf(list(own.values())))
    leaves = docs.select(docs[key].alias("key"), docs[group].alias("group"), leaf(list(own.values())).alias("leaf"), again.alias("again"))
    m = manifest(leaves, "key", "group", fan, page)
    root = F.lit(m.root).cast("string")
    out = proofs(m)
    return out.select(F.col("key").alias(key), "leaf", "subroot", root.alias("root"), siblings(F.col("proof")).alias("proof_sha256"),
                      F.size(F.flatten(F.transform("proof", lambda s: s["siblings"]))).alias("n_siblings"),
                      folded(F.col("again"), F.col("proof")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
