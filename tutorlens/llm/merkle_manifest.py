"""Merkle manifest of a dataset with nested-interval labels. DataFrame functions only.

Leaves are ranked inside their group (source); every node is labelled with the interval [lo, hi) of leaf ranks that it
covers, so that a node's ancestors are the nodes whose intervals contain its own, and the siblings of a node are the
nodes of its level inside its parent's interval less its own interval. Nodes are held by bucket: one row of `build` is a
bucket of up to FAN ** BAND consecutive nodes of one level with BAND levels above them. Upward, each band shuffles one
digest a bucket. Downward, a bucket is joined to the bucket of the next band that contains it (equal group and bucket
number, interval inside interval) and takes over the path from there to the root; leaves then fold their own path, so
paths are never shuffled a leaf. The roots of the groups are the leaves of one more tree, built by the same function.

Odd rows: null fields are `-`; a null source is a group of its own and comes first, a null doc_id comes before others;
rows equal in source and doc_id are ordered by their digest, and repeated rows are leaves of their own; an empty table
has no leaf and gives no row; other columns are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

FAN, BAND = 3, 3
BUCKET = FAN**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: monotonically_increasing_id() keeps the place inside a partition in this many bits.
PLACE_BITS = 33


def field(value: Column) -> Column:
    """A field of a leaf: its UTF-8 bytes after their number, `-` for null."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `rank` (from 0, in the given order inside `grp`) and `total` (rows of the group). Rows are range-partitioned,
    the row number breaking ties, so neither a group nor a run of equal rows is one task; ranks come from the rows of a
    group in each partition, a table of partitions and groups."""
    keys = ["grp", *order, "row_no"]
    tagged = rows.withColumn("row_no", F.monotonically_increasing_id())
    dealt = staged(tagged, "merkle-rows").repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row_no").withColumn("at", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("slice", F.shiftright("at", PLACE_BITS)), "merkle-sorted")
    whole = Window.partitionBy("grp")
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("grp", "slice").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    held = held.select("grp", "slice", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total"))
    return dealt.join(held, ["grp", "slice"]).withColumn("rank", F.col("at") - F.col("first_at") + F.col("start")).drop("at", "first_at", "start", "slice")


def _text(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x.digest), "")


def _parents(nodes: Column, alone: Column) -> Column:
    """The next level of a bucket: every FAN nodes become one. A tree that is down to one node has no further level."""

    def one(i: Column) -> Column:
        run = F.slice(nodes, i * FAN + 1, FAN)
        return F.struct(F.element_at(run, 1).lo.alias("lo"), F.element_at(run, -1).hi.alias("hi"), F.sha2(_text(run), 256).alias("digest"))

    level = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(nodes), F.lit(1)) - 1) / FAN).cast("int")), one)
    return F.when((F.size(nodes) > 0) & ~(alone & (F.size(nodes) == 1)), level).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string>>"))


def _buckets(nodes: DataFrame, band: int, extra: list[str]) -> DataFrame:
    """One row a bucket: grp, bucket, total, lo, hi, its nodes level by level (level0 to levelBAND) and node, the one that
    stands for it above. nodes (grp, total, lo, hi, digest, *extra); extra columns stay with level0's nodes."""
    of = F.floor(F.col("lo") / F.lit(BUCKET ** (band + 1))).alias("bucket")
    rows = nodes.groupBy("grp", of).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *extra))).alias("level0"))
    rows = rows.withColumns({"lo": F.element_at("level0", 1).lo, "hi": F.element_at("level0", -1).hi})
    alone = F.col("hi") - F.col("lo") == F.col("total")
    for k in range(BAND):
        rows = rows.withColumn(f"level{k + 1}", _parents(F.col(f"level{k}"), alone))
    top = F.element_at("level0", 1).digest
    for k in range(1, BAND + 1):
        top = F.coalesce(F.try_element_at(f"level{k}", F.lit(1)).digest, top)
    return rows.withColumns({"node": top, "whole": alone})


def build(leaves: DataFrame, most: int, extra: list[str]) -> list[DataFrame]:
    """The bands of the trees of all groups, lowest first, each a staged table of _buckets. leaves (grp, total, lo, hi,
    digest, *extra), most: leaves of the largest group."""
    bands, width = [], most
    while not bands or width > 1:
        nodes = leaves if not bands else bands[-1].filter("not whole").select("grp", "total", "lo", "hi", F.col("node").alias("digest"))
        bands.append(staged(_buckets(nodes, len(bands), extra if not bands else []), f"merkle-band{len(bands)}"))
        width = -(-width // BUCKET)
    return bands


def roots(bands: list[DataFrame]) -> DataFrame:
    """(grp, total, digest): the one node that is left of each group."""
    found = [b.filter("whole").select("grp", "total", F.col("node").alias("digest")) for b in bands]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


NO_STEPS = "array<struct<before:string,after:string>>"


def _step(nodes: Column, above: Column, lo: Column, hi: Column) -> Column:
    """The siblings of the node of a level that covers [lo, hi): nodes inside its parent's interval and outside its own. One
    pair in an array (both intervals are found once, and bound by the transform)."""
    covers = lambda x: (x.lo <= lo) & (x.hi >= hi)
    found = F.struct(F.try_element_at(F.filter(above, covers), F.lit(1)).alias("parent"), F.try_element_at(F.filter(nodes, covers), F.lit(1)).alias("own"))

    def pair(b: Column) -> Column:
        before = F.filter(nodes, lambda x: (x.lo >= b.parent.lo) & (x.hi <= b.own.lo))
        after = F.filter(nodes, lambda x: (x.lo >= b.own.hi) & (x.hi <= b.parent.hi))
        return F.struct(_text(before).alias("before"), _text(after).alias("after"))

    return F.transform(F.array(found), pair)


def own_path(levels: list[Column], lo: Column, hi: Column) -> Column:
    """Siblings on either side of [lo, hi) and its ancestors inside one bucket, from the node up. A level without siblings is
    a pair of empty texts (its digest is hashed alone); a level that a tree lacks is no pair."""
    steps = [F.when(F.size(above) > 0, _step(nodes, above, lo, hi)).otherwise(F.array().cast(NO_STEPS)) for nodes, above in zip(levels, levels[1:], strict=False)]
    return F.concat(*steps)


def leaf_paths(bands: list[DataFrame], upper: DataFrame | None, extra: list[str]) -> DataFrame:
    """(grp, digest, *extra, path, and what upper carries) of every leaf. upper (grp, path, ...) goes on from the root of each
    group; None: nothing is above. Containment joins run from the highest band down, bucket by bucket."""
    carried = [c for c in upper.columns if c not in ("grp", "path")] if upper is not None else []
    levels = [f"level{k}" for k in range(BAND + 1)]
    above = None
    for band in range(len(bands) - 1, -1, -1):
        rows = bands[band]
        here = rows.filter("whole")
        here = here.join(upper, "grp") if upper is not None else here.withColumn("path", F.array().cast(NO_STEPS))
        if above is not None:
            held = above.select(F.col("grp").alias("p_grp"), F.col("bucket").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("path").alias("p_path"), *carried, *[F.col(x).alias(f"p_{x}") for x in levels])
            bucket = F.floor(F.col("lo") / F.lit(BUCKET ** (band + 2)))
            met = rows.filter("not whole").join(held, (F.col("grp") == F.col("p_grp")) & (bucket == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            path = F.concat(own_path([F.col(f"p_{x}") for x in levels], F.col("lo"), F.col("hi")), F.col("p_path"))
            here = here.select(*rows.columns, "path", *carried).unionByName(met.select(*rows.columns, path.alias("path"), *carried))
        above = here
    leaves = above.select("grp", *levels, "path", *carried, F.explode("level0").alias("leaf"))
    path = F.concat(own_path([F.col(x) for x in levels], F.col("leaf.lo"), F.col("leaf.hi")), F.col("path"))
    return leaves.select("grp", "leaf.digest", *[f"leaf.{c}" for c in extra], path.alias("path"), *carried)


def nodes(bands: list[DataFrame]) -> DataFrame:
    """The manifest: (grp, level, lo, hi, digest) of every node of every tree, its interval being that of its leaves' ranks."""
    out = None
    for band, rows in enumerate(bands):
        for k in range(1 if band else 0, BAND + 1):
            level = rows.select("grp", F.lit(BAND * band + k).alias("level"), F.explode(f"level{k}").alias("x")).select("grp", "level", "x.lo", "x.hi", "x.digest")
            out = level if out is None else out.unionByName(level)
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x.before, acc, x.after), 256))


def proofs(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, changed_leaf, subroot, root, path) of every row; changed: a text to be checked in place of the row's own
    (null: the row as it is), its leaf is changed_leaf, else null."""
    told = lambda text: F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)
    other = F.when(changed.isNotNull(), told(changed)) if changed is not None else F.lit(None).cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("grp"), "doc_id", told(F.col("text")).alias("digest"), other.alias("changed_leaf"))
    leaves = ranked(leaves, ["doc_id", "digest"])
    extra = ["doc_id", "changed_leaf"]
    most = leaves.agg(F.max("total")).first()[0] or 0
    bands = build(leaves.select("grp", "total", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *extra), most, extra)
    tops = ranked(roots(bands).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    n_groups = tops.agg(F.max("total")).first()[0] or 0
    top_bands = build(tops.select("grp", "total", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "name"), n_groups, ["name"])
    root = roots(top_bands).first()
    upper = leaf_paths(top_bands, None, ["name"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.lit(root.digest if root else None).alias("root"), "path")
    return leaf_paths(bands, upper, extra).withColumnRenamed("digest", "leaf")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and digest of the proof of every document; documents whose decimal id has an even crc32 are checked
    with their line ends deleted."""
    docs = table(spark, sf_dir, "documents")
    bare = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    out = proofs(docs, bare)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x.before, x.after)), "")
    found = out.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: DuckDB form: levels, paths and folds by recursion. crc32 of the short decimal id by one fold over its bits.
_TREE = """{name}(level, g, r, d, n) AS (SELECT 0, g, r, d, n FROM {leaves} UNION ALL SELECT level + 1, g, r // 3, sha256(string_agg(d, '' ORDER BY r)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, g, r // 3)"""
_STEPS = """{name} AS (SELECT a.g, a.level, a.r, coalesce(string_agg(b.d, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS after
  FROM {tree} a JOIN {tree} b ON a.g = b.g AND a.level = b.level AND a.r // 3 = b.r // 3 WHERE a.n > 1 GROUP BY ALL)"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {text})"
ORACLE = f"""WITH RECURSIVE told AS (SELECT coalesce('=' || source, '-') AS g, doc_id, {_LEAF.format(text=_FIELD.format("text"))} AS leaf,
  list_reduce(list_prepend(4294967295, list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) AS crc, {_LEAF.format(text=_FIELD.format("replace(text, chr(10), '')"))} AS bare FROM documents),
placed AS (SELECT g, doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN bare ELSE leaf END AS shown, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM told),
leaves AS (SELECT g, r, leaf AS d, n FROM placed), {_TREE.format(name="tree", leaves="leaves")},
subroots AS (SELECT g AS name, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS r FROM tree WHERE n = 1),
tops AS (SELECT 'top' AS g, r, subroot AS d, (SELECT count(*) FROM subroots) AS n FROM subroots), {_TREE.format(name="high", leaves="tops")},
{_STEPS.format(name="low_steps", tree="tree")}, {_STEPS.format(name="high_steps", tree="high")},
heights AS (SELECT g, max(level) AS height FROM tree GROUP BY g),
steps AS (SELECT p.g, p.r AS leaf_r, s.level, before, after FROM placed p JOIN low_steps s ON s.g = p.g AND s.r = p.r // CAST(3 ** s.level AS BIGINT) UNION ALL
  SELECT p.g, p.r, h.height + s.level, before, after FROM placed p JOIN heights h ON h.g = p.g JOIN subroots u ON u.name = p.g JOIN high_steps s ON s.r = u.r // CAST(3 ** s.level AS BIGINT)),
fold(g, leaf_r, level, h) AS (SELECT g, r, 0, shown FROM placed UNION ALL SELECT f.g, f.leaf_r, f.level + 1, sha256(before || h || after) FROM fold f JOIN steps s ON s.g = f.g AND s.leaf_r = f.leaf_r AND s.level = f.level),
ends AS (SELECT g, leaf_r, arg_max(h, level) AS folded_root FROM fold GROUP BY ALL),
told_proofs AS (SELECT g, leaf_r, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY ALL)
SELECT doc_id, leaf, subroot, d AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = d AS verified
FROM placed p JOIN subroots u ON u.name = p.g JOIN ends e ON e.g = p.g AND e.leaf_r = p.r LEFT JOIN told_proofs t ON t.g = p.g AND t.leaf_r = p.r CROSS JOIN (SELECT d FROM high WHERE n = 1) top"""
