"""Factor models whose parameters stay in tables: truncated SVD by block Krylov steps and a factorisation machine over user and
item one-hots by alternating least squares. The driver sees matrices of the number of factors only.

A model is two tables, people (user_id, bias, factors) and items (content_id, bias, factors); a pair scores
people.bias + items.bias + <people.factors, items.factors>."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import staged


def weighted_sums(cells: DataFrame, table: DataFrame, on: str, to: str, width: int) -> DataFrame:
    """(to, x): for each `to` the sum of s * x over its cells (on, to, s), x from table (on, x array of width)."""
    sums = F.array(*[F.sum(F.col("s") * F.col("x")[i]) for i in range(width)])
    return cells.join(table, on).groupBy(to).agg(sums.alias("x"))


def gram(table: DataFrame, width: int) -> np.ndarray:
    """The width x width matrix of sums of products of x. Tasks add up their rows; width squared sums reach the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(width * width)
    for at, v in table.select("x").mapInArrow(products, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out.reshape(width, width)


def times(x: Column, matrix: np.ndarray) -> Column:
    """x (an array) times a small matrix."""

    @F.pandas_udf("array<double>")
    def product(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()) @ matrix)) if len(rows) else pd.Series([], dtype=object)

    return product(x)


def _independent(g: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Combinations of columns with Gram matrix g that are orthonormal; directions that are all but zero are left out."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    kept = values > least * max(values.max(), 1e-300)
    return vectors[:, kept] / np.sqrt(values[kept])


def truncated_svd(cells: DataFrame, rank: int = 10, steps: int = 5, spare: int = 10) -> tuple[DataFrame, DataFrame, list[float]]:
    """(user_id, u), (content_id, v) and the singular values of the sparse matrix cells (user_id, content_id, s), largest
    first; u holds the singular values. A block of rank + spare directions and its images under A'A, `steps` blocks in all,
    are made orthonormal by item; the best combinations of them are the result. With as many directions as items it is exact."""
    cells = staged(cells.filter("s <> 0").select("user_id", "content_id", "s"), "cells")
    width = rank + spare
    start = F.array(*[F.pmod(F.xxhash64("content_id", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1.0 for i in range(width)])
    block = staged(cells.select("content_id").distinct().withColumn("x", start), "block")
    basis, size, fresh = None, 0, width
    for step in range(steps):
        if basis is not None:  # the image of the last block, less its part in the basis
            seen = weighted_sums(cells, block, "content_id", "user_id", fresh)
            block = weighted_sums(cells, seen, "user_id", "content_id", fresh)
        new, old = block, size
        for _ in range(2):  # twice, for what rounding leaves
            both = new if basis is None else new.join(basis.withColumnRenamed("x", "b"), "content_id").select("content_id", F.concat("b", "x").alias("x"))
            both = staged(both, "both")
            g = gram(both, old + fresh)
            within, across = g[old:, old:], g[:old, old:]
            keep = _independent(within - across.T @ across)
            if not keep.shape[1]:
                break
            change = np.concatenate([-across @ keep, keep])
            new, fresh = staged(both.select("content_id", times(F.col("x"), change).alias("x")), "fresh"), keep.shape[1]
        if not keep.shape[1]:
            break
        block, size = new, old + fresh
        basis = block if basis is None else staged(basis.join(block.withColumnRenamed("x", "n"), "content_id").select("content_id", F.concat("x", "n").alias("x")), "basis")
    if basis is None:
        return cells.select("user_id", F.array().cast("array<double>").alias("u")).limit(0), block.select("content_id", F.col("x").alias("v")).limit(0), []
    images = staged(weighted_sums(cells, basis, "content_id", "user_id", size), "images")
    values, vectors = np.linalg.eigh(gram(images, size))
    best = np.argsort(-values)[:rank]
    turn = vectors[:, best]
    left = images.select("user_id", times(F.col("x"), turn).alias("u"))
    right = basis.select("content_id", times(F.col("x"), turn).alias("v"))
    return staged(left, "left"), staged(right, "right"), np.sqrt(np.maximum(values[best], 0)).tolist()


def factorisation_machine(train: DataFrame, rank: int = 8, penalty: float = 0.05, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """People and items of a second-order factorisation machine over user and item one-hots, fitted to train (user_id,
    content_id, score) by least squares in turn: with the items fixed, each user's bias and factors are a ridge regression of
    its own, and the other way round. Its normal equations are sums over events, so a user's events meet in no task. The mean
    of all scores is part of people.bias. Users or items without events have no row."""
    cells = staged(train.filter("user_id is not null and content_id is not null and score is not null").select("user_id", "content_id", F.col("score").cast("double").alias("score")), "cells")
    mean = cells.agg(F.avg("score")).first()[0] or 0.0
    cells = cells.withColumn("y", F.col("score") - mean)
    start = F.array(*[(F.pmod(F.xxhash64("content_id", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1.0) * 0.3 for i in range(rank)])
    items = staged(cells.select("content_id").distinct().select("content_id", F.lit(0.0).alias("bias"), start.alias("factors")), "items")
    people = None
    for _ in range(rounds):
        people = staged(_solved(cells, items, "content_id", "user_id", rank, penalty), "people")
        items = staged(_solved(cells, people, "user_id", "content_id", rank, penalty), "items")
    return people.withColumn("bias", F.col("bias") + mean), items


def _solved(cells: DataFrame, fixed: DataFrame, on: str, to: str, rank: int, penalty: float) -> DataFrame:
    """(to, bias, factors) by ridge regression of y less the fixed bias on (1, fixed factors); the penalty counts per event."""
    x = [F.lit(1.0), *[F.col("factors")[i] for i in range(rank)]]
    rest = F.col("y") - F.col("bias")
    upper = [(i, j) for i in range(rank + 1) for j in range(i, rank + 1)]
    sums = cells.join(fixed, on).groupBy(to).agg(F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("xx"), F.array(*[F.sum(xi * rest) for xi in x]).alias("xy"), F.count("*").alias("n"))
    at = tuple(np.array(upper).T)

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=object)
        a = np.zeros((len(n), rank + 1, rank + 1))
        a[:, at[0], at[1]] = a[:, at[1], at[0]] = np.stack(xx.to_numpy())
        a += penalty * n.to_numpy(np.float64)[:, None, None] * np.eye(rank + 1)
        return pd.Series(list(np.linalg.solve(a, np.stack(xy.to_numpy())[:, :, None])[:, :, 0]))

    told = sums.select(to, solve("xx", "xy", "n").alias("w"))
    return told.select(to, F.col("w")[0].alias("bias"), F.slice("w", 2, rank).alias("factors"))


def scores(pairs: DataFrame, people: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (user_id, content_id, ...) with `predicted`; a side that the model does not know adds nothing."""
    met = pairs.join(people.select("user_id", F.col("bias").alias("pb"), F.col("factors").alias("pf")), "user_id", "left")
    met = met.join(items.select("content_id", F.col("bias").alias("ib"), F.col("factors").alias("if")), "content_id", "left")
    dot = F.aggregate(F.zip_with("pf", "if", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return met.withColumn("predicted", zero(F.col("pb")) + zero(F.col("ib")) + zero(dot)).drop("pb", "pf", "ib", "if")
