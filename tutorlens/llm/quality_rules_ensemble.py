"""Quality classifier: a sparse rule ensemble.

Tree paths of a random forest over text statistics become conjunctive rules, an L1 logistic regression weighs them,
and the rules it keeps are compiled into one Spark column expression. Texts never leave the JVM; only the rule matrix of
the bounded training sample is made in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ratio, staged, table, training_labels, words

#: Labelled rows that a fit may use at most (the only sample in this operator).
MAX_TRAINING_ROWS = 20_000
CUTOFF = 0.3

FEATURES = [
    "q_log_words", "q_word_len", "q_upper", "q_symbol", "q_digit", "q_stop", "q_distinct", "q_dup_line",
    "q_stutter", "q_symbol_word", "q_upper_word", "q_bar_word", "q_log_lines", "q_line_words", "q_bang", "q_long_word",
]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(q_doc, FEATURES) of docs (text and any other columns), a row a row: q_doc is the whole row. A null text counts as
    empty. The generators of one row keep Spark from writing a statistic out once more wherever a rule reads it."""
    text = F.coalesce(F.col("q_doc.text"), F.lit(""))
    counted = (
        ("q_n_upper", r"\p{Lu}"), ("q_n_symbol", r"[#*$%&|<>{}\[\]=~^_\\]"), ("q_n_digit", r"[0-9]"),
        ("q_n_bang", r"[!?]"), ("q_n_stop", r"[.!?](?=\s|$)"), ("q_n_symbol_word", r"[#*$%&]{2,}(?=\s|[.,]|$)"),
        ("q_n_upper_word", r"(?<![\p{L}])\p{Lu}{2,}(?![\p{L}])"), ("q_n_bar", r"\s\|(?=\s)"), ("q_n_long", r"\S{25,}"),
        ("q_n_stutter", r"(?<!\S)(\S++)(?=\s++\1(?!\S))"),
    )
    read = F.struct(
        words(text).alias("q_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0).alias("q_lines"),
        F.length(text).alias("q_chars"),
        *[F.regexp_count(text, F.lit(p)).alias(n) for n, p in counted],
    )
    once = docs.select(F.struct("*").alias("q_doc")).select("q_doc", F.inline(F.array(read)))
    n, lines = F.size("q_words"), F.size("q_lines")
    features = F.struct(
        F.log1p(n).alias("q_log_words"),
        ratio(F.col("q_chars"), n).alias("q_word_len"),
        ratio(F.col("q_n_upper"), F.col("q_chars")).alias("q_upper"),
        ratio(F.col("q_n_symbol"), F.col("q_chars")).alias("q_symbol"),
        ratio(F.col("q_n_digit"), F.col("q_chars")).alias("q_digit"),
        ratio(F.col("q_n_stop"), n).alias("q_stop"),
        ratio(F.size(F.array_distinct("q_words")), n).alias("q_distinct"),
        ratio(lines - F.size(F.array_distinct("q_lines")), lines).alias("q_dup_line"),
        ratio(F.col("q_n_stutter"), n).alias("q_stutter"),
        ratio(F.col("q_n_symbol_word"), n).alias("q_symbol_word"),
        ratio(F.col("q_n_upper_word"), n).alias("q_upper_word"),
        ratio(F.col("q_n_bar"), n).alias("q_bar_word"),
        F.log1p(lines).alias("q_log_lines"),
        ratio(n, lines).alias("q_line_words"),
        ratio(F.col("q_n_bang"), n).alias("q_bang"),
        ratio(F.col("q_n_long"), n).alias("q_long_word"),
    )
    return once.select("q_doc", F.inline(F.array(features)))


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold). A rule is a tuple of (feature, op, cut)."""

    bias: float
    rules: tuple = field(default_factory=tuple)  # ((conditions, weight), ...)

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            total = total + F.when(_holds(conditions), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(conditions: tuple) -> Column:
    out = None
    for name, op, cut in conditions:
        one = F.col(name) <= F.lit(cut) if op == "<=" else F.col(name) > F.lit(cut)
        out = one if out is None else out & one
    return out


def tree_paths(debug_string: str, names: list[str]) -> list[tuple]:
    """Every path from a root to a node of the printed trees, as conjunctions with one bound a side and feature."""
    rules, path = {}, []
    for line in debug_string.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            depth = len(m[1]) - 4
            path[depth:] = [(names[int(m[2])], m[3], float(m[4]))]
            tight: dict[tuple[str, str], float] = {}
            for name, op, cut in path:
                pick = min if op == "<=" else max
                tight[name, op] = pick(cut, tight.get((name, op), cut))
            rules[tuple(sorted((name, op, cut) for (name, op), cut in tight.items()))] = None
        elif "Tree" in line:
            path = []
    return list(rules)


def rule_matrix(train: DataFrame, rules: list[tuple]) -> DataFrame:
    """(label, features) of train (label, FEATURES): a vector with 1.0 for each rule that holds. Hundreds of rules would
    make hundreds of columns to compile; here a rule costs one array operation a batch."""

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            columns = {name: frame[name].to_numpy() for name in FEATURES}
            out = np.ones((len(frame), len(rules)))
            for k, conditions in enumerate(rules):
                for name, op, cut in conditions:
                    out[:, k] *= columns[name] <= cut if op == "<=" else columns[name] > cut
            yield pd.DataFrame({"label": frame["label"], "held": list(out)})

    return train.select("label", *FEATURES).mapInPandas(held, "label int, held array<double>").select("label", array_to_vector("held").alias("features"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS, seed: int = 11) -> RuleModel:
    """labels (doc_id, <label> 0/1): held-out rows are left aside here. At most max_rows labelled rows are used, taken by
    the order of a hash of doc_id; of rows that share an id any one. With no row, or one class only, the model is the
    smoothed share of label 1."""
    sample = training_labels(labels, label).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    # the sample holds max_rows rows of 12 bytes at most, so it may be broadcast
    stats = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    train = stats.select("q_doc.doc_id", F.col("q_doc.label").alias("label"), *FEATURES).dropDuplicates(["doc_id"])
    train = staged(train.repartition(2, "doc_id").sortWithinPartitions("doc_id"), "op1-train")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (total + 2)
        return RuleModel(math.log(share / (1 - share)))
    vectors = train.select("label", array_to_vector(F.array(*FEATURES)).alias("features")).cache()
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=24, maxDepth=4, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=max(2, total // 2000), seed=seed).fit(vectors)
    vectors.unpersist()
    rules = tree_paths(forest.toDebugString, FEATURES)
    if not rules:
        share = (counts[1] + 1) / (total + 2)
        return RuleModel(math.log(share / (1 - share)))
    matrix = rule_matrix(train, rules).cache()
    lasso = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=0.002, maxIter=60, standardization=True).fit(matrix)
    matrix.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def score(docs: DataFrame, model: RuleModel, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted): every row of docs once, null or empty texts included."""
    scored = with_statistics(docs.select("doc_id", "text")).select("q_doc.doc_id", model.score().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleModel, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs whose own text reaches the cutoff, with their columns; one pass without a shuffle."""
    return with_statistics(docs).filter(model.score() >= cutoff).select("q_doc.*")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row a row of documents. Null and empty texts are scored like any other,
    repeated rows alike; a null doc_id counts as held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
