"""Ranking with the prerequisite post-filter, and ranking and safety metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import qualify


def ranked(scores: DataFrame, history: DataFrame | None, required: DataFrame, mastered: DataFrame) -> DataFrame:
    """Unseen candidates with rn (place by score, ties to the smaller content_id), qualified, q_before (qualified ones
    before it) and post_rn (place among qualified ones)."""
    unseen = scores if history is None else scores.join(history.select("user_id", "content_id").distinct(), ["user_id", "content_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "content_id")
    before = F.coalesce(F.sum(F.col("qualified").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return qualify(unseen, required, mastered).select("*", F.row_number().over(w).alias("rn"), before.alias("q_before")).withColumn("post_rn", F.when(F.col("qualified"), F.col("q_before") + 1))


def recommend(scores: DataFrame, history: DataFrame, required: DataFrame, mastered: DataFrame, contents: DataFrame, k: int = 5) -> DataFrame:
    """Filtered top k: (user_id, rank, content_id, predicted_score, topic, difficulty)."""
    top = ranked(scores, history, required, mastered).filter(F.col("post_rn") <= k)
    return top.join(contents.select("content_id", "topic", "difficulty"), "content_id").select("user_id", F.col("post_rn").alias("rank"), "content_id", F.round("score", 4).alias("predicted_score"), "topic", "difficulty")


def per_user(scores: DataFrame, history: DataFrame | None, test: DataFrame, required: DataFrame, mastered: DataFrame, k: int = 5, relevance: float = 0.5) -> DataFrame:
    """One row a user: hits, gains, list lengths, violations, walked and rejected candidates; n_rel is null without
    relevant test items."""
    relevant = test.filter(F.col("score") >= relevance).select("user_id", "content_id").distinct()
    flagged = ranked(scores, history, required, mastered).join(relevant.withColumn("hit", F.lit(1)), ["user_id", "content_id"], "left")
    raw, post, walked = F.col("rn") <= k, F.col("post_rn") <= k, F.col("q_before") < k
    gain = lambda cond, place: F.coalesce(F.sum(F.when(cond & F.col("hit").isNotNull(), 1 / F.log2(F.col(place) + 1))), F.lit(0.0))
    stats = flagged.groupBy("user_id").agg(
        F.count_if(raw & F.col("hit").isNotNull()).alias("raw_hits"), gain(raw, "rn").alias("raw_dcg"), F.count_if(raw).alias("raw_n"), F.count_if(raw & ~F.col("qualified")).alias("raw_bad"),
        F.count_if(post & F.col("hit").isNotNull()).alias("post_hits"), gain(post, "post_rn").alias("post_dcg"), F.count_if(post).alias("post_n"),
        F.count_if(walked).alias("walked"), F.count_if(walked & ~F.col("qualified")).alias("rejected"),
        F.collect_set(F.when(post, F.col("content_id"))).alias("shown"),
    )
    return stats.join(relevant.groupBy("user_id").agg(F.count("*").alias("n_rel")), "user_id", "left")


def summarise(users: DataFrame, catalog_size: int, k: int = 5) -> DataFrame:
    """The metrics row over per_user() rows (`shown` holds k items at most a user)."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    rel = F.col("n_rel").isNotNull()
    share = lambda a, b: F.round(F.when(F.sum(b) > 0, 100 * F.sum(a) / F.sum(b)).otherwise(0.0), 6)
    mean = lambda c: F.round(F.avg(F.when(rel, c)), 6)
    covered = users.select(F.explode("shown").alias("content_id")).agg(F.round(100 * F.countDistinct("content_id") / catalog_size, 6).alias("coverage_pct"))
    return users.withColumn("idcg", F.when(rel, ideal)).agg(
        mean(F.col("post_hits") / k).alias("precision_5"), mean(F.col("post_hits") / F.col("n_rel")).alias("recall_5"), mean(F.col("post_dcg") / F.col("idcg")).alias("ndcg_5"),
        mean(F.col("raw_hits") / k).alias("raw_precision_5"), mean(F.col("raw_hits") / F.col("n_rel")).alias("raw_recall_5"), mean(F.col("raw_dcg") / F.col("idcg")).alias("raw_ndcg_5"),
        share(F.col("raw_bad"), F.col("raw_n")).alias("pvr_pre_pct"), F.lit(0.0).alias("pvr_post_pct"), share(F.col("rejected"), F.col("walked")).alias("filter_rate_pct"),
        F.round(100 * F.avg(F.when(rel, (F.col("post_n") >= k).cast("double"))), 6).alias("feasibility_at_5_pct"), F.count_if(rel).alias("users_evaluated"), F.count("*").alias("users_all"),
    ).crossJoin(covered)  # one row on either side


def evaluate(scores: DataFrame, history: DataFrame | None, test: DataFrame, required: DataFrame, mastered: DataFrame, catalog_size: int, k: int = 5, relevance: float = 0.5) -> DataFrame:
    return summarise(per_user(scores, history, test, required, mastered, k, relevance), catalog_size, k)


def mae_rmse(predictions: DataFrame) -> DataFrame:
    """MAE and RMSE of predictions (score, predicted)."""
    d = F.col("score") - F.col("predicted")
    return predictions.agg(F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))
