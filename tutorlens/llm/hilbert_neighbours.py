"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the unit vectors on DIMENSIONS orthogonal random directions, shifts and quantises them, and orders all
vectors by their Hilbert key. The orderings are range-partitioned by Spark; a query looks at the window around its own
place in every ordering, and the candidates of all windows are merged and ranked by the exact cosine of the original
vectors. The window is a share of the ordering, picked on a bounded sample of queries against brute force. Vectors of one
direction are one point, as data and as query, so a vector that a third of the rows share is compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import staged, table

CURVES, DIMENSIONS, BITS, NEAREST = 16, 8, 4, 5
#: Rows of an ordering, and queries, that are compared at once.
BLOCK, QUERIES = 1024, 512
#: Windows to choose from, as shares of the ordering on each side.
SHARES = (0.002, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5)
#: Queries (at most) on which the window is picked, and the share of their neighbours that it must find.
PROBES, TARGET_RECALL = 48, 0.95


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points (rows of cells, values below 2**bits) on a Hilbert curve, by Skilling's transpose."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _places(width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, width])
    d = min(width, DIMENSIONS)
    directions = [np.linalg.qr(rng.normal(size=(width, d)))[0] * np.sqrt(width) for _ in range(CURVES)]
    return np.stack(directions), rng.random((CURVES, d))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(hn_id, hn_vec) of vectors that take part: not null, not zero, all components finite. Floats stay floats (half the
    bytes to move); all arithmetic on them is in double."""
    vec = F.col(vector_col)
    if embeddings.schema[vector_col].dataType != ArrayType(FloatType()):
        vec = vec.cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select(F.col(id_col).cast("long").alias("hn_id"), vec.alias("hn_vec")).filter(
        "hn_id is not null and hn_vec is not null"
    ).filter(F.coalesce(finite, F.lit(False)) & F.exists("hn_vec", lambda x: x != 0))


def keyed(vectors: DataFrame) -> DataFrame:
    """vectors with hn_key, the hash of the direction: the vector over its largest component (zeros without a sign)."""
    largest = F.array_max(F.transform("hn_vec", lambda x: F.abs(x)))
    return vectors.withColumn("hn_most", largest).withColumn("hn_key", F.xxhash64(F.transform("hn_vec", lambda x: x / F.col("hn_most") + F.lit(0.0)))).drop("hn_most")


def directions(vectors: DataFrame, most: int) -> DataFrame:
    """(hn_key, hn_vec, hn_ids): one row a direction (vectors that are positive multiples of each other) with its `most`
    smallest ids and the vector of the smallest, picked in two steps so that a vector that a third of the rows share is
    never gathered in one task."""
    scaled = keyed(vectors)
    some = scaled.withColumn("hn_rn", F.row_number().over(Window.partitionBy("hn_key", F.pmod(F.xxhash64("hn_id"), F.lit(64))).orderBy("hn_id"))).filter(F.col("hn_rn") <= most)
    few = some.withColumn("hn_rn", F.row_number().over(Window.partitionBy("hn_key").orderBy("hn_id"))).filter(F.col("hn_rn") <= most)
    return few.groupBy("hn_key").agg(F.min_by("hn_vec", "hn_id").alias("hn_vec"), F.sort_array(F.collect_list("hn_id")).alias("hn_ids"))


def orderings(points: DataFrame, seed: int) -> DataFrame:
    """(curve, place, hn_key): the place (from 0) of every point in each curve's ordering, ties by hn_key."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            width = frame["hn_vec"].map(len)
            for w, part in frame.groupby(width):
                unit, (directions, shifts) = _unit(_matrix(part["hn_vec"])), _places(int(w), seed)
                for c in range(CURVES):
                    spread = unit @ directions[c] + shifts[c]  # about normal with deviation 1
                    cells = np.clip((spread + 3) / 7 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    yield pd.DataFrame({"curve": np.int32(c), "code": hilbert_key(cells), "hn_key": part["hn_key"].to_numpy()})

    ordered = staged(
        points.select("hn_key", "hn_vec").mapInPandas(keys, "curve int, code long, hn_key long")
        .repartitionByRange("curve", "code", "hn_key").sortWithinPartitions("curve", "code", "hn_key")
        .select("curve", "code", "hn_key", F.spark_partition_id().alias("part")),
        "op5-order",
    )
    within = ordered.withColumn("rank", F.row_number().over(Window.partitionBy("curve", "part").orderBy("code", "hn_key")) - 1)
    sizes = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"))  # one row a curve and partition
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    return within.join(before, ["curve", "part"]).select("curve", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("place"), "hn_key")


def _rank_blocks(nearest: int):
    """(rows of a block) + (queries that look at it) -> the nearest rows for each query, equal scores by smallest id."""

    def rank(key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        widths, wanted = points["hn_vec"].map(len), asked["q_vec"].map(len)
        for w in set(widths) & set(wanted):
            part, queries = points[widths == w], asked[wanted == w]
            m, q = _matrix(part["hn_vec"]), _matrix(queries["q_vec"])
            scores = _unit(q) @ _unit(m).T
            place, keys, least = (part[c].to_numpy() for c in ("place", "hn_key", "least_id"))
            scores[(place < queries["lo"].to_numpy()[:, None]) | (place > queries["hi"].to_numpy()[:, None])] = -9
            k = min(nearest + 1, len(place))
            floor = np.partition(scores, len(place) - k, axis=1)[:, len(place) - k]
            # everything about as near as the last of them, so that ties are all there before they are cut by id
            i, j = np.nonzero((scores >= floor[:, None] - 1e-12) & (scores > -9))
            exact = np.einsum("ij,ij->i", q[i], m[j]) / np.sqrt(np.einsum("ij,ij->i", q[i], q[i])) / np.sqrt(np.einsum("ij,ij->i", m[j], m[j]))
            order = np.lexsort((least[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) <= nearest
            for at, x in enumerate((queries["q_key"].to_numpy()[i[kept]], keys[j[kept]], least[j[kept]], exact[kept])):
                found[at] = np.concatenate([found[at], x])
        return pd.DataFrame(dict(zip(("q_key", "hn_key", "least_id", "score"), found, strict=True)))

    return rank


def window_candidates(points: DataFrame, places: DataFrame, queries: DataFrame, reach: int, total: int, nearest: int) -> DataFrame:
    """(q_key, hn_key, least_id, score) of the nearest points of every block that a query's windows reach, without
    repeats. queries (q_key, q_vec), one row a direction. A group is a block and QUERIES queries or so."""
    blocks = places.join(points.select("hn_key", "hn_vec", F.col("hn_ids")[0].alias("least_id")), "hn_key").withColumn("block", F.floor(F.col("place") / BLOCK))
    looks = places.join(queries, F.col("hn_key") == F.col("q_key")).select(
        F.col("curve").alias("q_curve"), "q_key", "q_vec", F.greatest(F.col("place") - reach, F.lit(0)).alias("lo"), F.least(F.col("place") + reach, F.lit(total - 1)).alias("hi")
    )
    looks = looks.withColumn("q_block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    crowd = looks.groupBy(F.col("q_curve").alias("curve"), F.col("q_block").alias("block")).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("crowds"))
    spread = blocks.join(crowd, ["curve", "block"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    dealt = looks.join(crowd.toDF("q_curve", "q_block", "crowds"), ["q_curve", "q_block"]).withColumn("q_crowd", F.pmod(F.xxhash64("q_key"), "crowds").cast("int"))
    ranked = spread.groupBy("curve", "block", "crowd").cogroup(dealt.groupBy("q_curve", "q_block", "q_crowd")).applyInPandas(_rank_blocks(nearest), "q_key long, hn_key long, least_id long, score double")
    return ranked.groupBy("q_key", "hn_key").agg(F.min("least_id").alias("least_id"), F.max("score").alias("score"))


def nearest_rows(candidates: DataFrame, points: DataFrame, asked: DataFrame, nearest: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest directions' ids for every query (asked: query_id, q_key), the query's
    own left out, equal scores to the smaller id."""
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "least_id")
    best = candidates.withColumn("c_rn", F.row_number().over(order)).filter(F.col("c_rn") <= nearest + 1)
    opened = best.join(points.select("hn_key", "hn_ids"), "hn_key").select("q_key", F.explode("hn_ids").alias("vec_id"), "score")
    near = opened.withColumn("c_rn", F.row_number().over(Window.partitionBy("q_key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("c_rn") <= nearest + 1)
    answers = near.groupBy("q_key").agg(F.sort_array(F.collect_list(F.struct("c_rn", "vec_id", "score"))).alias("c_found"))
    # at most nearest + 1 a direction; a query that is not among them (its direction has smaller ids) leaves the last out
    others = F.slice(F.filter("c_found", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return asked.join(answers, "q_key").select("query_id", F.posexplode(others).alias("c_at", "x")).select("query_id", (F.col("c_at") + 1).alias("rank"), "x.vec_id", "x.score")


def _reach(total: int, share: float, nearest: int) -> int:
    return max(math.ceil(total * share), 16 * nearest)


def pick_share(points: DataFrame, places: DataFrame, queries: DataFrame, total: int, nearest: int) -> float:
    """The smallest share that finds TARGET_RECALL of the neighbours of PROBES queries; these are found by brute force in
    blocks of one ordering, which is the measure and no answer."""
    probes = staged(queries.orderBy(F.xxhash64(F.lit(3), "q_key")).limit(PROBES), "op5-probes")
    true = window_candidates(points, places.filter("curve = 0"), probes, total, total, nearest).filter("q_key <> hn_key")
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "least_id")
    near = staged(true.withColumn("c_rn", F.row_number().over(order)).filter(F.col("c_rn") <= nearest).select("q_key", "hn_key"), "op5-true")
    at = places.join(probes.select("q_key"), F.col("hn_key") == F.col("q_key")).select("curve", "q_key", F.col("place").alias("own"))
    far = near.join(places, "hn_key").join(at, ["curve", "q_key"]).groupBy("q_key", "hn_key").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("away"))
    away = [r["away"] for r in far.select("away").collect()]  # PROBES x nearest rows at most
    for share in SHARES:
        if sum(a <= _reach(total, share, nearest) for a in away) >= TARGET_RECALL * len(away):
            return share
    return SHARES[-1]


def neighbours(embeddings: DataFrame, is_query, nearest: int = NEAREST, share: float | None = None, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where is_query (a condition on hn_id) holds, the nearest other rows
    by cosine. share None: picked by pick_share. Vectors that usable() leaves out neither ask nor answer; rows of another
    length are never neighbours. Repeated ids count once. No vectors or no queries: no rows."""
    vectors = staged(usable(embeddings, id_col, vector_col).dropDuplicates(["hn_id"]), "op5-vectors")
    points = staged(directions(vectors, nearest + 1), "op5-points")
    total = points.count()
    places = staged(orderings(points, seed), "op5-places")
    asked = staged(keyed(vectors.filter(is_query)).select(F.col("hn_id").alias("query_id"), F.col("hn_key").alias("q_key")), "op5-asked")
    queries = staged(points.join(asked.select(F.col("q_key").alias("hn_key")).distinct(), "hn_key").select(F.col("hn_key").alias("q_key"), F.col("hn_vec").alias("q_vec")), "op5-queries")
    if share is None:
        share = pick_share(points, places, queries, total, nearest)
    return nearest_rows(window_candidates(points, places, queries, _reach(total, share, nearest), total, nearest), points, asked, nearest)


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score). Vectors that are null, zero or hold null or non-finite components take no part;
    equal vectors and scores rank by vec_id; an empty table gives no rows."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("hn_id") % 50 == 0)
