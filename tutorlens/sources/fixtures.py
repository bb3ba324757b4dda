"""Logical tables (interactions, users, contents, map, prerequisites, survey) derived from the given star schema, as
DataFrames, and the same derivations as SQL common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_interactions(events: DataFrame) -> DataFrame:
    """Rows of the event log, a table or a stream, as interactions."""
    event = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "quiz_passed").when(F.col("event_type") == "error", "disliked").otherwise("viewed")
    return events.select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("content_id"), "ts",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), event.alias("event"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_interactions(table(spark, sf_dir, "events"))


def interaction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of files. The path is a pattern, so it may be one file or a folder of them."""
    return as_interactions(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "events").select("user_id").distinct()
    level = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") < 3000, "bajo").when(F.col("c_acctbal") < 7000, "medio").otherwise("alto")
    return table(spark, sf_dir, "customer").join(active, F.col("c_custkey") == F.col("user_id"), "left_semi").select(
        F.col("c_custkey").cast("long").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"), level.alias("level"),
        F.when(F.col("c_nationkey") % 3 == 0, "básica").when(F.col("c_nationkey") % 3 == 1, "ninguna").alias("experience"),
    )


#: Contents of the catalog (the log names them 0 to 99); every document belongs to the content of its remainder.
CATALOG = 100


def content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, text): the whole texts of a content, one row a document."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % CATALOG).cast("int").alias("content_id"), F.coalesce("text", F.lit("")).alias("text"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("content_id")
    difficulty = F.when(k % 10 < 6, "básico").when(k % 10 < 9, "intermedio").otherwise("avanzado")
    return content_texts(spark, sf_dir).select("content_id").distinct().select(k, (k % 14).alias("topic"), difficulty.alias("difficulty"), (k % 7 == 0).alias("is_investment_related"))


#: Words of the descriptions, in the order of the remainders of content_id.
SEGMENT_WORDS, LEVEL_WORDS = ["automobile", "building", "furniture", "household", "machinery"], ["bajo", "medio", "alto"]


def described_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_texts() and, as one more row a content, its description: for whom it is, at what level, how hard."""
    word = lambda words: F.array(*[F.lit(w) for w in words])[F.col("content_id") % len(words)]
    told = contents(spark, sf_dir).select("content_id", F.concat_ws(" ", F.lit("para"), word(SEGMENT_WORDS), F.lit("nivel"), word(LEVEL_WORDS), F.col("difficulty")).alias("text"))
    return content_texts(spark, sf_dir).unionByName(told)


def content_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("content_id")
    both = content_texts(spark, sf_dir).select("content_id").distinct().select(k, F.explode(F.when(k % 5 == 0, F.array(k % 30, (k * 7) % 30)).otherwise(F.array(k % 30))).alias("concept_id"))
    direct = both.distinct().withColumn("coverage_type", F.lit("directa"))
    # indirect coverage, which the graph leaves out
    return direct.unionByName(direct.filter("content_id % 4 = 0").select("content_id", ((F.col("concept_id") + 11) % 30).alias("concept_id"), F.lit("indirecta").alias("coverage_type")))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id): 40, of which the last ten have no content."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).cast("int").alias("concept_id")).distinct()


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("concept_id")
    known = concepts(spark, sf_dir).filter("concept_id between 1 and 29")
    half = known.filter("concept_id % 3 <> 1").select(c, F.floor(c / 2).cast("int").alias("prerequisite_concept_id"))
    last = known.filter("concept_id % 6 = 0").select(c, (c - 1).alias("prerequisite_concept_id"))
    return half.unionByName(last).distinct()


# Concepts of each topic, first those that its contents ask for; and those that investment contents ask for.
TOPIC_CONCEPTS = [
    [1, 16, 2], [2, 1], [3, 1], [4, 3], [5, 6], [7], [8, 18], [9, 1, 3], [10, 1, 3, 19], [11, 10, 19, 5], [12, 2, 7, 6, 13, 14], [13, 22], [14, 12, 13], [15, 29],
]
INVESTMENT_CONCEPTS = [2, 7, 6, 13]


def topic_concepts(spark: SparkSession) -> DataFrame:
    """(topic, place, concept_id), a few dozen rows."""
    return spark.createDataFrame([(t, i, c) for t, cs in enumerate(TOPIC_CONCEPTS) for i, c in enumerate(cs)], "topic int, place int, concept_id int")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey codes from customer keys, with missing codes by the remainder of 17."""
    k = F.col("c_custkey").cast("int")

    def code(value, at: int):
        return F.when(k % 17 == at, -97).when(k % 17 == at + 1, -98).otherwise(value).cast("int")

    return table(spark, sf_dir, "customer").select(
        k.alias("respondent"), (1970 + (k * 7) % 40).cast("int").alias("a0400"), code(k % 2, 0).alias("a0100"), code(k % 5 + 1, 1).alias("e0100"),
        code(k % 10 + 1, 2).alias("a1500"), code((k * 3) % 4 + 1, 3).alias("k0600"), code((k * 5) % 3 + 1, 4).alias("k0100"), code(k % 4, 5).alias("k1003"),
        code((k + F.floor(k / 3)) % 2, 6).alias("b0130a"), code(F.floor(k / 2) % 2, 7).alias("b0130b"), code(F.floor(k / 5) % 2, 8).alias("b0130c"),
        code(F.floor(k / 4) % 2, 9).alias("b1000b"), code(F.floor(k / 7) % 2, 10).alias("b1000c"), code(F.floor(k / 6) % 2, 11).alias("a0320"),
    )


def _code(value: str, at: int) -> str:
    return f"CAST(CASE WHEN c_custkey % 17 = {at} THEN -97 WHEN c_custkey % 17 = {at + 1} THEN -98 ELSE {value} END AS INT)"


#: The same tables for DuckDB, to follow WITH.
CTES = f"""
interactions AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS content_id, ts, least(value / 100, 1.0) AS score,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'quiz_passed' WHEN 'error' THEN 'disliked' ELSE 'viewed' END AS event FROM events),
users AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, c_mktsegment AS segment, CAST(c_nationkey AS INT) AS nation,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'bajo' WHEN c_acctbal < 7000 THEN 'medio' ELSE 'alto' END AS level,
  CASE c_nationkey % 3 WHEN 0 THEN 'básica' WHEN 1 THEN 'ninguna' END AS experience
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
texts AS (SELECT CAST(doc_id % 100 AS INT) AS content_id, coalesce(text, '') AS text FROM documents),
contents AS (SELECT content_id, CAST(content_id % 14 AS INT) AS topic, CASE WHEN content_id % 10 < 6 THEN 'básico' WHEN content_id % 10 < 9 THEN 'intermedio' ELSE 'avanzado' END AS difficulty,
  content_id % 7 = 0 AS is_investment_related FROM (SELECT DISTINCT content_id FROM texts)),
described AS (SELECT * FROM texts UNION ALL SELECT content_id, 'para ' || (['automobile', 'building', 'furniture', 'household', 'machinery'])[content_id % 5 + 1] || ' nivel ' || (['bajo', 'medio', 'alto'])[content_id % 3 + 1] || ' ' || difficulty FROM contents),
ccm AS (SELECT content_id, CAST(content_id % 30 AS INT) AS concept_id FROM contents UNION SELECT content_id, CAST((content_id * 7) % 30 AS INT) FROM contents WHERE content_id % 5 = 0),
concepts AS (SELECT DISTINCT CAST(doc_id % 40 AS INT) AS concept_id FROM documents),
prerequisites AS (SELECT concept_id, CAST(concept_id // 2 AS INT) AS prerequisite_concept_id FROM concepts WHERE concept_id BETWEEN 1 AND 29 AND concept_id % 3 <> 1
  UNION SELECT concept_id, CAST(concept_id - 1 AS INT) FROM concepts WHERE concept_id BETWEEN 1 AND 29 AND concept_id % 6 = 0),
topic_concepts(topic, place, concept_id) AS (VALUES (0, 0, 1), (0, 1, 16), (0, 2, 2), (1, 0, 2), (1, 1, 1), (2, 0, 3), (2, 1, 1), (3, 0, 4), (3, 1, 3), (4, 0, 5), (4, 1, 6), (5, 0, 7), (6, 0, 8), (6, 1, 18), (7, 0, 9), (7, 1, 1), (7, 2, 3),
  (8, 0, 10), (8, 1, 1), (8, 2, 3), (8, 3, 19), (9, 0, 11), (9, 1, 10), (9, 2, 19), (9, 3, 5), (10, 0, 12), (10, 1, 2), (10, 2, 7), (10, 3, 6), (10, 4, 13), (10, 5, 14), (11, 0, 13), (11, 1, 22), (12, 0, 14), (12, 1, 12), (12, 2, 13), (13, 0, 15), (13, 1, 29)),
survey AS (SELECT CAST(c_custkey AS INT) AS respondent, CAST(1970 + (c_custkey * 7) % 40 AS INT) AS a0400, {_code("c_custkey % 2", 0)} AS a0100, {_code("c_custkey % 5 + 1", 1)} AS e0100,
  {_code("c_custkey % 10 + 1", 2)} AS a1500, {_code("(c_custkey * 3) % 4 + 1", 3)} AS k0600, {_code("(c_custkey * 5) % 3 + 1", 4)} AS k0100, {_code("c_custkey % 4", 5)} AS k1003,
  {_code("(c_custkey + c_custkey // 3) % 2", 6)} AS b0130a, {_code("(c_custkey // 2) % 2", 7)} AS b0130b, {_code("(c_custkey // 5) % 2", 8)} AS b0130c,
  {_code("(c_custkey // 4) % 2", 9)} AS b1000b, {_code("(c_custkey // 7) % 2", 10)} AS b1000c, {_code("(c_custkey // 6) % 2", 11)} AS a0320 FROM customer)
"""
