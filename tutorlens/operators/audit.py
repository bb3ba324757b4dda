"""Dataset statistics, log audits and catalog checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_sizes(frame: DataFrame, key: str) -> DataFrame:
    """mean, median, min and max of rows a key."""
    n = frame.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_n"), F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def dataset_stats(interactions: DataFrame, relevance: float = 0.5) -> DataFrame:
    pos = F.col("score") >= relevance
    n_users, n_items = F.countDistinct("user_id"), F.countDistinct("content_id")
    return interactions.agg(
        F.count("*").alias("n_rows"), n_users.alias("n_users"), n_items.alias("n_contents"), F.count_if(pos).alias("n_positive"), F.round(F.count_if(pos) / F.count("*"), 6).alias("positive_share"),
        F.round(F.count_if(pos) / F.countDistinct(F.when(pos, F.col("user_id"))), 6).alias("positives_per_positive_user"),
        F.round(1 - F.count("*") / (n_users * n_items), 6).alias("sparsity"), (F.count("*") - F.countDistinct("user_id", "content_id")).alias("repeated_pairs"),
    )


def distributions(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n, share) of several columns in one pass; null is a value of its own."""
    long = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    n = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("column_name")), 6))


def set_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, both) distinct keys."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.count_if(F.expr("l = 1 and r = 0")).alias("only_left"), F.count_if(F.expr("l = 0 and r = 1")).alias("only_right"), F.count_if(F.expr("l = 1 and r = 1")).alias("both"))


def kl_divergence(frame: DataFrame, group: Column, value: str) -> DataFrame:
    """KL divergence (nats) of the value distribution where group holds from that where it does not; values absent from
    the second are left out."""
    n = frame.groupBy(value).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    shares = n.select((F.col("a") / F.sum("a").over(Window.partitionBy())).alias("p"), (F.col("b") / F.sum("b").over(Window.partitionBy())).alias("q"))
    return shares.filter("p > 0 and q > 0").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("kl"))


def referential(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent."""
    return child.select(key).distinct().join(parent.select(key), key, "left_anti")


def concept_coverage(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    return concepts.join(mapping, "concept_id", "left").groupBy("concept_id").agg(F.count("content_id").alias("n_contents"))


def concept_map(contents: DataFrame, explicit: DataFrame, defaults: DataFrame) -> DataFrame:
    """(content_id, concept_id, evidence_note): explicit rows, else the topic's default; contents with neither go."""
    named = explicit.select("content_id", F.col("concept_id").alias("given"))
    joined = contents.join(named, "content_id", "left").join(defaults.select("topic", F.col("concept_id").alias("usual")), "topic", "left")
    note = F.when(F.col("given").isNotNull(), "explicit").otherwise("topic default")
    return joined.select("content_id", F.coalesce("given", "usual").alias("concept_id"), note.alias("evidence_note")).filter("concept_id is not null").distinct()


def catalog_checks(contents: DataFrame, mapping: DataFrame, concepts: DataFrame, n_contents: int, columns: list[str] | None = None) -> DataFrame:
    """(check_name, ok, observed), one row a check. columns: the exact ones that contents must have."""
    odd = len(set(columns or contents.columns) ^ set(contents.columns))
    one = [
        contents.agg(F.count("*").alias("observed")).select(F.lit("content count").alias("check_name"), (F.col("observed") == n_contents).alias("ok"), "observed"),
        contents.agg((F.count("*") - F.countDistinct("content_id")).alias("observed")).select(F.lit("repeated content ids").alias("check_name"), (F.col("observed") == 0).alias("ok"), "observed"),
        referential(mapping, concepts, "concept_id").agg(F.count("*").alias("observed")).select(F.lit("unknown concepts").alias("check_name"), (F.col("observed") == 0).alias("ok"), "observed"),
        referential(contents, mapping, "content_id").agg(F.count("*").alias("observed")).select(F.lit("unmapped contents").alias("check_name"), (F.col("observed") == 0).alias("ok"), "observed"),
        mapping.agg(F.count_if(F.expr("coverage_type <> 'directa'")).alias("observed")).select(F.lit("other coverage types").alias("check_name"), (F.col("observed") == 0).alias("ok"), "observed"),
        contents.sparkSession.range(1).select(F.lit("missing or other columns").alias("check_name"), F.lit(odd == 0).alias("ok"), F.lit(odd).cast("long").alias("observed")),
    ]
    return reduce(DataFrame.unionByName, one)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def append_new(catalog: DataFrame, new: DataFrame, key: str = "content_id") -> DataFrame:
    """catalog and new rows; an id that both have fails the job when rows are read."""
    guard = F.when(F.col("clash").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("id already in catalog: "), F.col(key).cast("string"))))
    checked = new.join(catalog.select(F.col(key).alias("k"), F.lit(1).alias("clash")), F.col(key) == F.col("k"), "left").withColumn(key, guard.cast(new.schema[key].dataType))
    return catalog.unionByName(checked.select(catalog.columns))


def last_wins(frame: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """One row a key: the value at the last place, and the first place."""
    return frame.groupBy(key).agg(F.max_by(value, place).alias(value), F.min(place).alias("first_place"))


def first_seen(events: DataFrame, concepts_of: DataFrame) -> DataFrame:
    """(user_id, concept_id, first_ts) over engaged events (not disliked); concepts_of (content_id, concept_id)."""
    return events.filter("event <> 'disliked'").join(concepts_of, "content_id").groupBy("user_id", "concept_id").agg(F.min("ts").alias("first_ts"))


def content_needs(contents: DataFrame, topic_concepts: DataFrame, investment: list[int], base: int = 2) -> DataFrame:
    """(content_id, rule, concept_id): concepts that r3 (investment contents) and r4 (the first ones of the topic) ask for;
    basic contents ask for none."""
    asking = contents.filter("difficulty <> 'básico'")
    r3 = asking.filter("is_investment_related").select("content_id", F.lit("r3").alias("rule"), F.explode(F.array(*[F.lit(c) for c in investment])).alias("concept_id"))
    r4 = asking.join(topic_concepts.filter(F.col("place") < base), "topic").select("content_id", F.lit("r4").alias("rule"), "concept_id")
    return r3.unionByName(r4)


def levels() -> tuple[Column, Column]:
    """r1: advanced content for low (or unknown) knowledge without investing experience; r2: advanced investment content
    for beginners. An unknown experience is none of these."""
    advanced = F.col("difficulty") == "avanzado"
    r1 = advanced & F.coalesce(F.col("level") == "bajo", F.lit(True)) & F.coalesce(F.col("experience") == "ninguna", F.lit(False))
    return r1, advanced & F.col("is_investment_related") & F.coalesce(F.col("experience").isin("ninguna", "básica"), F.lit(False))


def eligibility(events: DataFrame, users: DataFrame, contents: DataFrame, seen: DataFrame, needs: DataFrame) -> DataFrame:
    """Events with the rules that they break: r1 and r2 by level and experience, r3 and r4 where a needed concept (needs:
    content_id, rule, concept_id) was not seen earlier (seen: user_id, concept_id, first_ts)."""
    first = seen.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("concept_id", "first_ts"))).alias("first"))  # a user's concepts are few
    asked = needs.groupBy("content_id").agg(*[F.collect_list(F.when(F.col("rule") == r, F.col("concept_id"))).alias(r) for r in ("r3", "r4")])
    known = contents.select("content_id", "difficulty", "is_investment_related").join(asked, "content_id", "left")
    facts = events.join(users.select("user_id", "level", "experience"), "user_id", "left").join(known, "content_id").join(first, "user_id", "left")
    met = lambda c: F.try_element_at("first", c)
    lacks = lambda rule: F.coalesce(F.exists(rule, lambda c: met(c).isNull() | F.coalesce(met(c) >= F.col("ts"), F.lit(False))), F.lit(False)).alias(rule)
    r1, r2 = levels()
    return facts.select("event_id", "user_id", "content_id", r1.alias("r1"), r2.alias("r2"), lacks("r3"), lacks("r4"))


def qualifying(pairs: DataFrame, users: DataFrame, contents: DataFrame, seen: DataFrame, needs: DataFrame) -> DataFrame:
    """Those of pairs (user_id, content_id) that break none of the four rules, given all concepts seen so far."""
    facts = pairs.join(users.select("user_id", "level", "experience"), "user_id").join(contents.select("content_id", "difficulty", "is_investment_related"), "content_id")
    r1, r2 = levels()
    missing = pairs.join(needs.select("content_id", "concept_id").distinct(), "content_id").join(seen.select("user_id", "concept_id"), ["user_id", "concept_id"], "left_anti").select("user_id", "content_id").distinct()
    return facts.filter(~r1 & ~r2).select("user_id", "content_id").join(missing, ["user_id", "content_id"], "left_anti")


def difficulty_pool(qualified: DataFrame, pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(user_id, target, tier, n_contents): what a user may get for each target difficulty: 1 qualified contents of that
    difficulty, else 2 qualified basic ones, else 3 all basic ones."""
    levels = contents.select("content_id", "difficulty")
    own = qualified.join(levels, "content_id")
    targets = F.explode(F.array(*[F.lit(x) for x in ("básico", "intermedio", "avanzado")])).alias("target")
    first = own.select("user_id", F.col("difficulty").alias("target"), F.lit(1).alias("tier"), "content_id")
    second = own.filter("difficulty = 'básico'").select("user_id", targets, F.lit(2).alias("tier"), "content_id")
    third = pairs.join(levels.filter("difficulty = 'básico'"), "content_id").select("user_id", targets, F.lit(3).alias("tier"), "content_id")
    n = first.unionByName(second).unionByName(third).groupBy("user_id", "target", "tier").agg(F.count("*").alias("n_contents"))
    return n.groupBy("user_id", "target").agg(F.min("tier").alias("tier"), F.min_by("n_contents", "tier").alias("n_contents"))


def sparsities(interactions: DataFrame, users: DataFrame, contents: DataFrame) -> DataFrame:
    """One row: share of empty cells over active contents counting rows, and over the whole grid counting scored pairs."""
    seen = interactions.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.countDistinct("content_id").alias("c"))
    cells = interactions.groupBy("user_id", "content_id").agg(F.avg("score").alias("s")).filter("s <> 0").agg(F.count("*").alias("filled"))
    size = users.agg(F.count("*").alias("nu")).crossJoin(contents.agg(F.count("*").alias("nc")))  # one row on either side
    both = seen.crossJoin(cells).crossJoin(size)
    return both.select(F.round(1 - F.col("n") / (F.col("u") * F.col("c")), 6).alias("active_sparsity"), F.round(1 - F.col("filled") / (F.col("nu") * F.col("nc")), 6).alias("grid_sparsity"))


def most_common(frame: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n_rows): the n most frequent values, ties to the smaller value."""
    return frame.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), column).limit(n)


def weighted_mode(frame: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value, weight): the value with the largest sum of weights for each key, ties to the larger value."""
    total = frame.groupBy(key, value).agg(F.sum(weight).alias("w"))
    best = F.max(F.struct("w", value)).alias("best")
    return total.groupBy(key).agg(best).select(key, F.col(f"best.{value}").alias(value), F.col("best.w").alias("weight"))


def quartiles(frame: DataFrame, by: str, value: str) -> DataFrame:
    """(quartile, n, mean_value): rows by the exact quartile cuts of a column, and the mean of another in each."""
    cuts = frame.agg(*[F.percentile(by, q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))])  # one row
    at = 1 + sum(((F.col(by) > F.col(f"q{i}")).cast("int") for i in range(3)), F.lit(0))
    return frame.crossJoin(cuts).groupBy(at.alias("quartile")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"))


def histogram(frame: DataFrame, column: str, width: float) -> DataFrame:
    return frame.groupBy(F.floor(F.col(column) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): values that one side only has."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def bounds_per_user(interactions: DataFrame, least: int, most: int) -> DataFrame:
    """One row: smallest and largest number of rows a user, and the users outside the bounds."""
    n = interactions.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") < least).alias("too_few"), F.count_if(F.col("n") > most).alias("too_many"))


def numbered(frame: DataFrame, key: str, name: str = "number", width: int = 65_536) -> DataFrame:
    """frame with numbers from 1 in the order of an integer key, ties in any order: ranges of the key are counted, then
    numbered each in a task of its own."""
    ranged = frame.withColumn("nb_range", F.floor(F.col(key) / width))
    upto = Window.orderBy("nb_range").rowsBetween(Window.unboundedPreceding, -1)  # over the table of ranges
    offsets = ranged.groupBy("nb_range").agg(F.count("*").alias("nb_n")).select("nb_range", F.coalesce(F.sum("nb_n").over(upto), F.lit(0)).alias("nb_before"))
    place = F.row_number().over(Window.partitionBy("nb_range").orderBy(key))
    return ranged.withColumn("nb_place", place).join(offsets, "nb_range").withColumn(name, (F.col("nb_place") + F.col("nb_before")).cast("long")).drop("nb_range", "nb_place", "nb_before")


def zipped(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of both frames side by side by their place in the order of their keys."""
    return numbered(left, left_key).join(numbered(right, right_key), "number")
