"""Sharding by jump consistent hashing: a stable key and the number of shards decide the shard, without a table of shards.

The key of a document is its id alone (md5 of its decimal form, null: of `null`). Appending shards moves rows to the new
shards only, in the share that they should hold. Slots number the rows of a shard without gaps. The order inside a shard
is one hash of (doc_id, size, crc, span of copies), so it can be cut into slices of about equal rows: a shard is never ordered in one
task, and equal rows are counted before they are placed and handed out in spans, so copies of one row do not meet in one task.

Odd rows: null ids share one key and thus, as the law asks, one shard; null and empty texts have no bytes and crc 0;
repeated rows each get a slot of their own; other columns are neither read nor in the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

N_SHARDS = 24
#: 2 ** SLICE_BITS slices cut the order of a shard; AT_ONCE slots are handed out by one row at a time.
SLICE_BITS, AT_ONCE = 10, 4096
#: Fixed values of the published generator.
MULTIPLIER, KEY_BITS = 2862933555777941757, 60


def stable_key(*cols: Column) -> Column:
    """60 bits of md5 over the decimal or text forms, the same in any engine and session."""
    told = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(told), 1, KEY_BITS // 4), 16, 10).cast("long")


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards of keys: each key jumps ahead to the next number of shards at which it would move, while that is within
    n_shards; about ln(n_shards) rounds over ever fewer keys."""
    state, shard = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        reach = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        ahead = reach < n_shards
        live = live[ahead]
        shard[live] = reach[ahead]
    return shard


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard (0 to n_shards - 1) of a key that is never null."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), n_shards).astype(np.int32))

    return place(key)


def moves(docs: DataFrame, n_shards: int, grown: int) -> DataFrame:
    """(doc_id, shard, grown_shard) of the rows that change shard when n_shards become grown: all go to new shards."""
    key = stable_key(F.col("doc_id"))
    placed = docs.select("doc_id", shard_of(key, n_shards).alias("shard"), shard_of(key, grown).alias("grown_shard"))
    return placed.filter(F.col("shard") != F.col("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, files_a_shard: int = 1) -> None:
    """Writes whole rows as Parquet below path/shard=N. Rows of a shard are spread over files_a_shard tasks by their
    content, so neither a shard nor one hot id is one task. A column named `shard` of the input is left out."""
    kept = [c for c in docs.columns if c != "shard"]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in kept]), F.lit(files_a_shard))
    placed = docs.select(*kept, shard_of(stable_key(F.col("doc_id")), n_shards).alias("shard"))
    placed.repartition(n_shards * files_a_shard, F.col("shard"), salt).write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; one pass over texts, narrow rows after it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    spans = counted.withColumn("span", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {AT_ONCE}"))))
    key = stable_key(F.col("doc_id"))
    placed = spans.select(
        "doc_id", "size", "text_crc32", "span", F.least(F.col("n") - F.col("span") * AT_ONCE, F.lit(AT_ONCE)).alias("n"), shard_of(key, n_shards).alias("shard"),
        shard_of(key, n_shards + 1).alias("grown_shard"), stable_key(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("span")).alias("place"),
    )
    placed = staged(placed.withColumn("slice", F.shiftright("place", KEY_BITS - SLICE_BITS).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "slice").agg(F.sum("n").alias("held")).select("shard", "slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("place", "doc_id", "size", "text_crc32", "span").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "slice"])
    slots = F.sequence(F.col("start") + F.col("inside"), F.col("start") + F.col("inside") + F.col("n") - 1)
    return first.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def op11_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard among one more, of every document."""
    return assign(table(spark, sf_dir, "documents"), N_SHARDS)


#: DuckDB form. A crc is linear in the bits of a text: what a byte adds depends on its value and its distance from the end,
#: looked up in a table that doubling makes (zeros: the effect of 2 ** k zero bytes on each bit of the register).
_APPLY = "list_reduce(list_prepend(0::BIGINT, range(32)), lambda a, i: xor(a, (({x} >> i) & 1) * m[i + 1]))"
_STEP = "lambda a, i: xor(a >> 1, (a & 1) * 3988292384)"
ORACLE = f"""WITH RECURSIVE coded AS (SELECT row_number() OVER () AS row_id, doc_id, strlen(coalesce(text, '')) AS bytes, hex(encode(coalesce(text, ''))) AS digits FROM documents),
zeros(k, m) AS (SELECT 0, list_transform(range(32), lambda b: list_reduce(list_prepend(1::BIGINT << b, range(8)), {_STEP}))
  UNION ALL SELECT k + 1, list_transform(m, lambda x: {_APPLY.format(x="x")}) FROM zeros WHERE (1 << k) < (SELECT max(bytes) + 4 FROM coded)),
bits(k, behind, b, v) AS (SELECT 0, 1::BIGINT, b, list_reduce(list_prepend(1::BIGINT, range(8 - b)), {_STEP}) FROM range(8) t(b)
  UNION ALL SELECT k + 1, behind + s * (1 << k), b, CASE s WHEN 0 THEN v ELSE {_APPLY.format(x="v")} END FROM bits JOIN zeros USING (k), range(2) t(s)),
of_byte AS (SELECT behind, byte, bit_xor(v) AS v FROM bits, range(256) t(byte) WHERE k = (SELECT max(k) FROM bits) AND (byte >> b) & 1 = 1 GROUP BY ALL),
body AS (SELECT row_id, bit_xor(v) AS v FROM (SELECT row_id, bytes - unnest(range(bytes)) AS behind, CAST('0x' || unnest(regexp_extract_all(digits, '..')) AS INT) AS byte FROM coded) JOIN of_byte USING (behind, byte) GROUP BY row_id),
head AS (SELECT row_id, bit_xor(v) AS v FROM (SELECT row_id, unnest(range(greatest(bytes - 3, 1), bytes + 1)) AS behind, 255 AS byte FROM coded) JOIN of_byte USING (behind, byte) GROUP BY row_id),
sized AS (SELECT row_id, doc_id, bytes + 8 AS size, xor(xor(xor(coalesce(body.v, 0), coalesce(head.v, 0)), CASE WHEN bytes < 4 THEN 4294967295 >> CAST(8 * bytes AS INT) ELSE 0 END), 4294967295) AS text_crc32
  FROM coded LEFT JOIN body USING (row_id) LEFT JOIN head USING (row_id)),
keyed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS HUGEINT) AS key FROM sized),
jumps(key, n, b, state) AS (SELECT DISTINCT key, n, 0::BIGINT, (key * 2862933555777941757 + 1) % 18446744073709551616 FROM keyed, (VALUES ({N_SHARDS}), ({N_SHARDS + 1})) t(n) UNION ALL
  SELECT key, n, j, (state * 2862933555777941757 + 1) % 18446744073709551616 FROM (SELECT *, CAST(floor((b + 1) * (2147483648::DOUBLE / (state // 8589934592 + 1)::DOUBLE)) AS BIGINT) AS j FROM jumps) WHERE j < n),
ends AS (SELECT key, n, max(b) AS b FROM jumps GROUP BY ALL),
spans AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {AT_ONCE} AS span FROM keyed),
placed AS (SELECT *, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size || '|' || text_crc32 || '|' || span), 1, 15) AS place FROM spans)
SELECT p.doc_id, p.size, p.text_crc32, 'key' AS law, CAST(e.b AS INT) AS shard, row_number() OVER (PARTITION BY e.b ORDER BY place, p.doc_id NULLS FIRST, p.size, p.text_crc32, span) - 1 AS slot, CAST(g.b AS INT) AS grown_shard
FROM placed p JOIN ends e ON e.key = p.key AND e.n = {N_SHARDS} JOIN ends g ON g.key = p.key AND g.n = {N_SHARDS + 1}"""
