"""Lists of recommendations without a table of users x contents: each user is one row with the contents seen, the concepts
mastered and the relevant contents of the test as arrays; a ranking is walked only as far as the k-th qualified content.

A ranking that all users share (popularity) is read in stretches from its top, each twice as long as the one before; only
users whose list is not full go on to the next. A ranking of a user's own is an array made by the scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import staged

#: Contents of the first stretch.
STRETCH = 256
ITEM = "struct<score:double,content_id:int,needs:array<int>>"


def catalog(contents: DataFrame, required: DataFrame) -> DataFrame:
    """(content_id, needs): every content with the concepts it asks for."""
    needs = required.groupBy("content_id").agg(F.collect_set("required_concept_id").alias("needs"))
    return contents.select("content_id").distinct().join(needs, "content_id", "left").select(F.col("content_id").cast("int").alias("content_id"), F.coalesce("needs", F.array().cast("array<int>")).alias("needs"))


def states(users: DataFrame, history: DataFrame | None, mastered: DataFrame | None, test: DataFrame, relevance: float = 0.5) -> DataFrame:
    """One row a user: seen, have and relevant (null without relevant test contents). Sets of a user are no larger than the
    catalog or the concepts, whatever the number of events."""
    out = users.select("user_id").distinct()
    sets = [("seen", history, "content_id"), ("have", mastered, "concept_id"), ("relevant", test.filter(F.col("score") >= relevance), "content_id")]
    for name, frame, column in sets:
        if frame is None:
            out = out.withColumn(name, F.array().cast("array<int>"))
            continue
        held = frame.groupBy("user_id").agg(F.collect_set(F.col(column).cast("int")).alias(name))
        out = out.join(held, "user_id", "left")
        out = out if name == "relevant" else out.withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    return out


def _judged(ranking: Column) -> Column:
    """Contents of a ranking that are not seen, in order, with `q`: no needed concept is missing."""
    unseen = F.filter(ranking, lambda x: ~F.array_contains("seen", x.content_id))
    return F.transform(unseen, lambda x: F.struct(x.score.alias("score"), x.content_id.alias("content_id"), (F.size(F.array_except(x.needs, F.col("have"))) == 0).alias("q")))


def _cut(walked: Column, k: int) -> Column:
    """The walk up to the k-th qualified content, that one included."""
    places = F.filter(F.transform(walked, lambda x, i: F.when(x.q, i + 1)), lambda i: i.isNotNull())
    return F.slice(walked, F.lit(1), F.coalesce(F.get(places, F.lit(k - 1)), F.size(walked)))


def walk_own(users: DataFrame, k: int = 5) -> DataFrame:
    """users (states() and `ranking`, array<ITEM> in order of rank) with `walked`."""
    return users.withColumn("judged", _judged(F.col("ranking"))).withColumn("walked", _cut(F.col("judged"), k)).drop("judged", "ranking")


def walk_shared(users: DataFrame, items: DataFrame, k: int = 5, stretch: int = STRETCH) -> DataFrame:
    """users (states()) with `walked` along items (content_id, needs, score), best score first, ties to the smaller id."""
    order, kind = [F.desc("score"), F.asc("content_id")], f"array<{ITEM}>"
    spark = users.sparkSession
    waiting, done, at = users.withColumn("walked", F.array().cast("array<struct<score:double,content_id:int,q:boolean>>")), None, 0
    while True:
        held = [(float(x.score), x.content_id, x.needs) for x in items.orderBy(*order).offset(at).limit(stretch).collect()]  # `stretch` rows at most
        row = spark.createDataFrame([(held,)], f"ranking {kind}")
        more = waiting.crossJoin(F.broadcast(row))  # one row
        more = more.withColumn("judged", F.concat("walked", _judged(F.col("ranking")))).withColumn("walked", _cut(F.col("judged"), k)).drop("judged", "ranking")
        if len(held) < stretch:
            return more if done is None else done.unionByName(more)
        more = staged(more, "walk")
        full = F.size(F.filter("walked", lambda x: x.q)) >= k
        done = more.filter(full) if done is None else done.unionByName(more.filter(full))
        waiting, at, stretch = more.filter(~full), at + stretch, 2 * stretch
        if waiting.isEmpty():
            return done


def qualified(walked: Column) -> Column:
    return F.filter(walked, lambda x: x.q)


def per_user(users: DataFrame, k: int = 5) -> DataFrame:
    """What metrics.summarise() takes, from walked lists: metrics.per_user() without a row a candidate."""
    hit = lambda x: F.array_contains(F.coalesce("relevant", F.array().cast("array<int>")), x.content_id)
    hits = lambda xs: F.size(F.filter(xs, hit)).cast("long")
    gain = lambda xs: F.aggregate(F.transform(xs, lambda x, i: F.when(hit(x), 1 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    lists = users.select("user_id", "relevant", "walked", F.slice("walked", 1, k).alias("raw"), qualified(F.col("walked")).alias("post"))
    bad = lambda xs: F.size(F.filter(xs, lambda x: ~x.q)).cast("long")
    return lists.select(
        "user_id", hits(F.col("raw")).alias("raw_hits"), gain(F.col("raw")).alias("raw_dcg"), F.size("raw").cast("long").alias("raw_n"), bad(F.col("raw")).alias("raw_bad"),
        hits(F.col("post")).alias("post_hits"), gain(F.col("post")).alias("post_dcg"), F.size("post").cast("long").alias("post_n"), F.size("walked").cast("long").alias("walked"),
        bad(F.col("walked")).alias("rejected"), F.transform("post", lambda x: x.content_id).alias("shown"), F.when(F.size("relevant") > 0, F.size("relevant").cast("long")).alias("n_rel"),
    )


def recommended(users: DataFrame, contents: DataFrame) -> DataFrame:
    """(user_id, rank, content_id, predicted_score, topic, difficulty) of the qualified contents of walked lists."""
    each = users.select("user_id", F.posexplode(qualified(F.col("walked"))).alias("pos", "x"))
    top = each.select("user_id", (F.col("pos") + 1).alias("rank"), "x.content_id", F.round("x.score", 4).alias("predicted_score"))
    return top.join(contents.select("content_id", "topic", "difficulty"), "content_id").select("user_id", "rank", "content_id", "predicted_score", "topic", "difficulty")
