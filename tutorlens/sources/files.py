"""Scans and sinks of the logical tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of all executors that the session names; a session on one machine without one makes its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tutorlens-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back, for what is used more than once."""
    path = f"{shared_dir(frame.sparkSession)}/tutorlens-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def read_ragged_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a plain comma file with a header, brought to the columns: short rows get '', surplus fields are folded into
    the last one."""
    n = len(columns)
    head = ",".join(columns)
    parts = F.split("value", ",", -1)
    folded = F.concat(F.slice(parts, 1, n - 1), F.array(F.array_join(F.slice(parts, n, F.greatest(F.size(parts) - n + 1, F.lit(1))), ",")))
    whole = F.when(F.size(parts) >= n, folded).otherwise(F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n))
    return spark.read.text(path).filter((F.col("value") != head) & (F.length("value") > 0)).select(*[whole[i].alias(c) for i, c in enumerate(columns)])


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide matrix (first column user_id, one column a content) as long rows."""
    wide = spark.read.option("header", True).csv(path)
    return wide.unpivot(["user_id"], None, "content_id", "score").select("user_id", "content_id", F.col("score").cast("double").alias("score"))


def read_catalog(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a catalog file that have a content_id."""
    return read_csv(spark, path, schema).filter(F.length("content_id") > 0)


def read_records(spark: SparkSession, path: str, schema: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of JSON files, of the given ids if there are any; with a limit the first ones by content_id."""
    out = spark.read.schema(schema).option("multiLine", True).json(path)
    out = out.filter(F.col("content_id").isin(ids)) if ids else out
    return out.orderBy("content_id").limit(limit) if limit else out


def read_bodies(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """pages (url, ...) with the cached body whose file name is the md5 of the url: a hit has status 200 and took no time, a
    miss has status 0 and neither body nor time."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([0-9a-f]{32})", 1).alias("key"), F.col("content").alias("body"))
    met = pages.withColumn("key", F.md5("url")).join(files, "key", "left").drop("key")
    hit = F.col("body").isNotNull()
    return met.withColumn("status", F.when(hit, 200).otherwise(0)).withColumn("elapsed_ms", F.when(hit, 0))


def write_csv(frame: DataFrame, path: str, quote_all: bool = False) -> None:
    frame.write.option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_records(frame: DataFrame, path: str) -> None:
    frame.write.json(path)


def score_matrix(scores: DataFrame) -> DataFrame:
    """The wide matrix, for a sink that asks for it; the catalog must be small."""
    return scores.groupBy("user_id").pivot("content_id").agg(F.first("score"))
