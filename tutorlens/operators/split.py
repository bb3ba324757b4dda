"""Leak-free warm and cold splits and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def warm_split(interactions: DataFrame, ratio: float = 0.2, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first row of each (user, content) with `side`: the latest max(1, round(n * ratio)) pairs of a user are test,
    the others and users with one pair are train. Later repeats of a pair are on neither side."""
    pair = Window.partitionBy("user_id", "content_id").orderBy(*order)
    first = interactions.withColumn("rn", F.row_number().over(pair)).filter("rn = 1").drop("rn")
    user = Window.partitionBy("user_id")
    n = F.count("*").over(user)
    late = F.row_number().over(user.orderBy(*[F.desc(c) for c in order]))
    test = (n > 1) & (late <= F.greatest(F.lit(1), F.bround(n * F.lit(ratio))))
    return first.withColumn("side", F.when(test, "test").otherwise("train"))


def user_order(seed: int = 42) -> Column:
    """A fixed shuffle of integer user ids that any SQL engine repeats: a number below 1000003, evenly spread."""
    return F.pmod(F.col("user_id") * 618034 + seed * 104729, F.lit(1000003))


def cold_split(interactions: DataFrame, n: int | None = None, share: float = 0.1, seed: int = 42) -> DataFrame:
    """All rows with `side`: test for cold users, pool for the others. Cold are the first n users by user_order, or
    without n those whose place is below the share, which needs neither a sort nor a join."""
    if n is None:
        return interactions.withColumn("side", F.when(user_order(seed) < int(share * 1000003), "test").otherwise("pool"))
    cold = interactions.select("user_id").distinct().orderBy(user_order(seed), "user_id").limit(n).withColumn("cold", F.lit(True))
    return interactions.join(cold, "user_id", "left").withColumn("side", F.when(F.col("cold"), "test").otherwise("pool")).drop("cold")


def split_diagnostics(split: DataFrame) -> DataFrame:
    """One row: users on each side, on both, only in train, and mean rows a user."""
    per_user = split.groupBy("user_id").agg(F.count_if(F.col("side") == "train").alias("tr"), F.count_if(F.col("side") == "test").alias("te"))
    return per_user.agg(
        F.count_if(F.expr("tr > 0")).alias("train_users"), F.count_if(F.expr("te > 0")).alias("test_users"), F.count_if(F.expr("tr > 0 and te > 0")).alias("both_users"),
        F.count_if(F.expr("tr > 0 and te = 0")).alias("only_train_users"), F.round(F.sum("tr") / F.count_if(F.expr("tr > 0")), 6).alias("train_rows_per_user"),
        F.round(F.sum("te") / F.count_if(F.expr("te > 0")), 6).alias("test_rows_per_user"),
    )


def leaked_pairs(split: DataFrame) -> DataFrame:
    """Pairs that stand on both sides; a sound split has none."""
    sides = split.select("user_id", "content_id", "side").distinct()
    return sides.groupBy("user_id", "content_id").agg(F.count("*").alias("n_sides")).filter("n_sides > 1")


def split_distributions(split: DataFrame, columns: list[str]) -> DataFrame:
    """(side, column_name, value, n, share) of the columns within each side, null being a value of its own."""
    long = split.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("side", "x.*")
    n = long.groupBy("side", "column_name", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("side", "column_name")), 6))


def users_without_test(split: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, n_rows) of the first n users that have train rows only."""
    per_user = split.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("side") == "test").alias("te"))
    return per_user.filter("te = 0").select("user_id", "n_rows").orderBy("user_id").limit(n)
