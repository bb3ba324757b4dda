"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is its share of the budget by weight, held to MOST_COPIES times its size, the excess being reshared
(water filling in closed form over the table of sources). The whole part of target / source size is the copies of each
document that are certain; the words still missing are drawn. A document's inclusion probability grows with its size (of
w words as w / (w + HALF), so that fragments come seldom and long documents do not crowd out others), scaled so that the
expected words are those missing. Documents of a source are ranked by the odds of a random number over the odds of that
probability, and taken in that order up to the words still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import coin, staged, table

BUDGET, MOST_COPIES, SEED = 1.5, 2, 7
WEIGHTS = (3, 1, 2)
#: Words at which a document is half as likely to be drawn as the longest ones, and the largest inclusion probability.
HALF, MOST_LIKELY = 100, 0.99
#: Slices of the ranking of a source: sums go slice by slice first, so only one slice is ever ordered in a task.
SLICES = 4096


def weight_in_turn(weights: tuple = WEIGHTS) -> Column:
    """Weights dealt to sources in the order of their code points, null last, from the first again and again."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, weight, source_size and any others) with target. The level is the words a unit of weight gets: sources are held
    to most * size in the order of most * size / weight for as long as the level exceeds that. One row a source, so the
    windows run over the table of sources only."""
    ratio = most * F.col("source_size") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (budget * F.sum("source_size").over(everything) - held) / weight_left
    leveled = sizes.withColumn("mx_ratio", ratio).withColumn("mx_level", level)
    # the first source in order that the level before it does not exceed fixes the level for it and all after it
    first = F.min(F.when(F.col("mx_level") <= F.col("mx_ratio"), F.struct("mx_ratio", "mx_level"))).over(everything)["mx_level"]
    capped = (most * F.col("source_size")).cast("double")
    return leveled.withColumn("mx_first", first).select(
        *sizes.columns,
        F.when(F.col("mx_first").isNull(), capped).otherwise(F.least(capped, F.col("weight") * F.col("mx_first"))).alias("target"),
    )


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), a row a row of docs, written once: words are counted in one pass over the texts, and all
    that follows reads these narrow rows."""
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "op7-sizes")


def goals(sized: DataFrame, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """(mx_source, source_size, mx_lean, target) of sized (source, size), one row a source."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(_lean() * F.col("size")).alias("mx_lean")).withColumn("weight", weight_in_turn())
    return targets(per_source, budget, most).withColumnRenamed("source", "mx_source").drop("weight")


def _lean() -> Column:
    return F.expr(f"size * 1000 div (size + {HALF})")  # whole numbers, so that sums do not depend on their order


def ranked(sized: DataFrame, goal: DataFrame, seed: int = SEED) -> DataFrame:
    """sized (doc_id, source, size and any others but mx_...) with its goal, the certain copies, the inclusion probability
    mx_part of one more and mx_rank, the place in its source's order. One row a source is joined: Spark broadcasts it
    where it is small and joins by shuffle otherwise."""
    drawn = sized.join(goal, F.col("source").eqNullSafe(F.col("mx_source"))).drop("mx_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = F.when(F.col("mx_lean") > 0, F.least(F.lit(MOST_LIKELY), (rate - F.floor(rate)) * (_lean() * F.col("source_size") / F.col("mx_lean")))).otherwise(F.lit(0.0))
    odds = (F.col("mx_u") / (1 - F.col("mx_u"))) / (F.col("mx_part") / (1 - F.col("mx_part")))
    return (
        drawn.withColumn("mx_sure", F.floor(rate)).withColumn("mx_part", part).withColumn("mx_u", coin(seed, F.col("doc_id")))
        .withColumn("mx_odds", F.when(F.col("mx_part") > 0, odds))
        .withColumn("mx_rank", F.struct("mx_odds", "mx_u", "doc_id", "size"))
    )


def _decided(places: DataFrame, slices: int) -> DataFrame:
    """ranked() rows with mx_more: whether a document is taken once more than the certain copies. Rows that cannot be drawn
    (a source held to whole copies, documents without words) have no place and take no part in any shuffle."""
    drawn = F.coalesce(F.col("mx_part") > 0, F.lit(False))
    sliced = places.filter(drawn).withColumn("mx_slice", F.floor(F.col("mx_odds") / (1 + F.col("mx_odds")) * slices)).withColumn("mx_left", F.col("target") - F.col("mx_sure") * F.col("source_size"))  # slices rise with the odds
    per_slice = sliced.groupBy("source", "mx_slice").agg(F.sum("size").alias("mx_words"))
    upto = Window.partitionBy("source").orderBy("mx_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.select(F.col("source").alias("s_source"), F.col("mx_slice").alias("s_slice"), F.coalesce(F.sum("mx_words").over(upto), F.lit(0)).alias("mx_before"), "mx_words")
    placed = sliced.join(before, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("mx_slice") == F.col("s_slice"))).drop("s_source", "s_slice")
    within = Window.partitionBy("source", "mx_slice").orderBy("mx_rank").rowsBetween(Window.unboundedPreceding, -1)
    # only the slice in which the missing words run out needs its documents in order
    at = F.col("mx_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    full = F.col("mx_before") + F.col("mx_words") <= F.col("mx_left")
    open_ = (F.col("mx_before") <= F.col("mx_left")) & ~full
    split = placed.filter(open_).withColumn("mx_more", at + F.col("size") / 2.0 <= F.col("mx_left"))
    whole = placed.filter(~open_).withColumn("mx_more", full)
    rest = places.filter(~drawn).withColumn("mx_more", F.lit(False))
    columns = [*places.columns, "mx_more"]
    return split.select(columns).unionByName(whole.select(columns)).unionByName(rest.select(columns))


def mix(docs: DataFrame, budget: float = BUDGET, most: int = MOST_COPIES, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row a row of docs (doc_id, source, text). A null
    text has size 0; null sources are one source, last; a source without words has target 0. A document is taken whole,
    `copies` times (at most `most`), so a source ends within half a document of its target. Repeated rows draw the same
    random number and stand side by side in the ranking, so of equal rows only the first may have one copy more."""
    sized = counted(docs)
    decided = _decided(ranked(sized, goals(sized, budget, most), seed), slices)
    copies = F.col("mx_sure") + F.col("mx_more").cast("long")
    return decided.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, budget: float = BUDGET, most: int = MOST_COPIES, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """docs in the mix: every row as many times as mix() takes it; its columns are those of docs. Of rows that share id,
    source and size, of which mix() takes some once more, any are taken once more, as many. The documents taken once more
    are those up to one place in their source's order, so each row is decided by the table of sources and no text moves."""
    sized = counted(docs)
    goal = staged(goals(sized, budget, most), "op7-goals")
    decided = _decided(ranked(sized, goal, seed), slices)
    rest = (F.col("mx_part") > 0) & ~F.col("mx_more")
    ends = decided.groupBy("source").agg(F.max(F.when(F.col("mx_more"), F.col("mx_rank"))).alias("mx_last"), F.min(F.when(rest, F.col("mx_rank"))).alias("mx_next")).withColumnRenamed("source", "e_source")
    cuts = staged(goal.join(ends, F.col("mx_source").eqNullSafe(F.col("e_source"))).drop("e_source"), "op7-cuts")
    # a generator of one row keeps Spark from copying the count into every use of size
    own = docs.select(F.struct("*").alias("mx_doc"), "doc_id", "source", F.explode(F.array(word_count(F.col("text")))).alias("size"))
    rows = ranked(own, cuts, seed)
    more = F.coalesce((F.col("mx_part") > 0) & (F.col("mx_rank") <= F.col("mx_last")), F.lit(False))
    divided = F.coalesce((F.col("mx_last") == F.col("mx_next")) & (F.col("mx_rank") == F.col("mx_last")), F.lit(False))
    out = rows.filter(~divided).select("mx_doc", (F.col("mx_sure") + more.cast("long")).alias("mx_copies"))
    if not cuts.filter("mx_last = mx_next").isEmpty():
        # one group a source at most: equal rows that the end of the ranking falls between
        tied = cuts.filter("mx_last = mx_next").select(F.col("mx_source").alias("t_source"), F.col("mx_last").alias("t_last"))
        end = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("mx_rank") == F.col("t_last"))
        once_more = decided.filter("mx_more").join(tied, end).groupBy("t_source").agg(F.count("*").alias("mx_once_more"))
        place = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("mx_doc.text")))
        group = rows.filter(divided).withColumn("mx_place", place).join(once_more, F.col("source").eqNullSafe(F.col("t_source")))
        out = out.unionByName(group.select("mx_doc", (F.col("mx_sure") + (F.col("mx_place") <= F.col("mx_once_more")).cast("long")).alias("mx_copies")))
    return out.filter("mx_copies > 0").withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies").cast("int")))).select("mx_doc.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies), a row a row of documents; odd rows as in mix(). An
    empty table gives no rows."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * 1000 // (size + {HALF}) * size) AS BIGINT) AS lean,
         CAST([{", ".join(map(str, WEIGHTS))}][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT)] AS BIGINT) AS weight
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, {MOST_COPIES} * source_size / CAST(weight AS DOUBLE) AS ratio,
         ({BUDGET} * CAST(sum(source_size) OVER () AS BIGINT)
          - CAST(coalesce(sum({MOST_COPIES} * source_size) OVER (ORDER BY {MOST_COPIES} * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY {MOST_COPIES} * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM per_source
), goal AS (
  SELECT source, source_size, lean, least(CAST({MOST_COPIES} * source_size AS DOUBLE), weight * (SELECT level FROM leveled WHERE level <= ratio ORDER BY ratio, level LIMIT 1)) AS target FROM leveled
), drawn AS (
  SELECT s.*, g.source_size, g.target, g.lean,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         (CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / {float(2**48)} AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), likely AS (
  SELECT *, CASE WHEN lean > 0 THEN least({MOST_LIKELY}, (rate - floor(rate)) * (CAST(size * 1000 // (size + {HALF}) * source_size AS DOUBLE) / lean)) ELSE 0.0 END AS part FROM drawn
), ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source, part > 0 ORDER BY (u / (1 - u)) / nullif(part / (1 - part), 0), u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM likely
)
SELECT doc_id, size, source_size, target, source, copies, CAST(copies * size AS BIGINT) AS taken FROM (
  SELECT *, CAST(floor(rate) + CASE WHEN part > 0 AND coalesce(upto, 0) + size / 2.0 <= target - floor(rate) * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ranked)
"""
