"""What the training-data operators share: words, table reads, staged tables, hash coins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0.0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where a session on one machine names none (tests), one is made and set; on a
    cluster its absence is an error, for a folder of the driver's machine would be no other's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tutorlens-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there, and a lost executor costs only
    the tasks it ran. Column names must be plain."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tutorlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def coin(seed: int, *cols: Column) -> Column:
    """A uniform double in (0, 1) that depends on the values alone (md5, so SQL engines agree)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels no model sees; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of rows open to training: one row a document (repeated rows: the larger label), 0 or 1."""
    return (
        labels.select("doc_id", F.col(name).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
