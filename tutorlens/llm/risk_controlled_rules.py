"""Quality rules whose cutoffs are chosen under a risk bound. DataFrame functions only.

Each rule rejects a text whose statistic exceeds a cutoff; texts fall into strata by length. A fifth of the documents with
labels open to training (the design part) orders, for each stratum, steps that tighten one rule by one cutoff of a fixed
grid: first those that catch most bad texts for the good ones they cost. The other labelled good texts test that order:
step by step an exact binomial test must refute, at level DELTA divided by the number of strata, that all rules together
reject RISK or more of the good texts; the steps before the first that fails are used. As the order does not depend on the
texts that test it, no correction for the steps is needed, and with confidence 1 - DELTA no stratum loses more than RISK of
its good texts to the rules. A stratum with fewer good texts than the test needs at no rejection (least_rows) is joined to
its smaller neighbour; if all together have fewer, there is no cutoff and the base rules alone decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ratio, staged, table, training_labels, words

RISK, DELTA = 0.02, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Lower bounds of the length strata, in words.
STRATA = (0, 200, 800)
# The cutoffs that are tested.
GRID = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
RULES = ("symbols", "repeats", "dup_lines", "capitals", "same_words")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stratum, r_<rule>...) of docs
    (doc_id, text), a row a row. A null text counts as empty: all counts 0 and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        "doc_id",
        words(F.col("text")).alias("qr_words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("qr_lines"),
        F.length(text).alias("qr_chars"),
        F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")).alias("qr_space"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("qr_upper"),
    )
    n = F.size("qr_words")
    window = lambda w, i: F.struct(F.xxhash64(w, F.get("qr_words", i + 1), F.get("qr_words", i + 2)).alias("h"), i.alias("i"))
    # windows sorted by hash: equal ones stand side by side, so no pair of windows is compared
    sorted_windows = F.when(n >= 3, F.array_sort(F.slice(F.transform("qr_words", window), 1, n - 2))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    windows = read.withColumn("qr_sorted", sorted_windows)
    again = F.filter(
        F.transform("qr_sorted", lambda x, k: F.when((x["h"] == F.get("qr_sorted", k - 1)["h"]) | (x["h"] == F.get("qr_sorted", k + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    repeated = windows.withColumn("qr_again", F.array_sort(again)).drop("qr_sorted")
    covered = F.aggregate("qr_again", F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last")), lambda acc: acc["sum"])
    counted = repeated.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.col("qr_chars") - F.col("qr_space")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("qr_lines").alias("qr_n_lines"),
        "qr_upper",
        F.size(F.array_distinct("qr_words")).alias("qr_distinct"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stratum = F.lit(0)
    for k, least in enumerate(STRATA[1:], 1):
        stratum = F.when(F.col("n_words") >= least, k).otherwise(stratum)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), stratum.alias("stratum"),
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("r_symbols"),
        ratio(F.col("n_repeat_words"), F.col("n_words")).alias("r_repeats"),
        ratio(F.col("n_dup_lines"), F.col("qr_n_lines")).alias("r_dup_lines"),
        ratio(F.col("qr_upper"), F.col("word_chars")).alias("r_capitals"),
        F.when(F.col("n_words") > 0, 1 - ratio(F.col("qr_distinct"), F.col("n_words"))).otherwise(F.lit(0.0)).alias("r_same_words"),
    )


def refuted(rejected: int, n: int, risk: float, level: float) -> bool:
    """Exact binomial test: with a rejection rate of risk or more, `rejected` or fewer of n have probability <= level."""
    if n == 0:
        return False
    tail = 0.0
    for k in range(rejected + 1):
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if tail > level:
            return False
    return True


def least_rows(risk: float, level: float) -> int:
    """Good texts that a test needs to pass if none of them is rejected."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def pooled(rows: dict[int, int], least: int) -> list[list[int]]:
    """Strata joined until each group has `least` rows or is the only one: the smallest group goes to its smaller neighbour."""
    groups = [[s] for s in range(len(STRATA))]
    size = lambda g: sum(rows.get(s, 0) for s in g)
    while len(groups) > 1 and min(map(size, groups)) < least:
        at = min(range(len(groups)), key=lambda i: size(groups[i]))
        to = min((i for i in (at - 1, at + 1) if 0 <= i < len(groups)), key=lambda i: size(groups[i]))
        first, second = sorted((at, to))
        groups[first : second + 1] = [groups[first] + groups[second]]
    return groups


def ordered_steps(bad: dict[tuple[str, int], int], good: dict[tuple[str, int], int]) -> list[tuple[str, int]]:
    """(rule, place in GRID) in the order in which rules are tightened, from the counts of bad and good design texts above each
    cutoff: the next step is the one that catches most more bad texts for each more good text (and one) it costs. Steps
    after the last that catches any are left out; ties go to the first rule, then to the looser cutoff."""
    at, steps = dict.fromkeys(RULES, len(GRID)), []
    of = lambda counts, r, k: counts.get((r, k), 0) if k < len(GRID) else 0
    while True:
        best = None
        for i, r in enumerate(RULES):
            for k in range(at[r] - 1, -1, -1):
                more = of(bad, r, k) - of(bad, r, at[r])
                merit = more / (1 + of(good, r, k) - of(good, r, at[r]))
                if more > 0 and (best is None or (-merit, i, -k) < best[0]):
                    best = ((-merit, i, -k), r, k)
        if best is None:
            return steps
        steps.append(best[1:])
        at[best[1]] = best[2]


def choose_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """{(stratum, rule): cutoff} from statistics() rows and labels (doc_id, label 0/1) open to training. Counts a stratum,
    rule and cutoff are all that leaves Spark."""
    design = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    known = stats.filter(~F.col("base_failed")).join(labels, "doc_id").withColumn("design", design)
    held = staged(known.select("stratum", "design", "label", *[f"r_{r}" for r in RULES]), "op10-labelled")
    above = [F.count_if(F.col(f"r_{r}") > c).alias(f"{r}.{k}") for r in RULES for k, c in enumerate(GRID)]
    counts = held.groupBy("stratum", "design", "label").agg(F.count("*").alias("n"), *above).collect()
    level = delta / len(STRATA)
    groups = pooled({c["stratum"]: c["n"] for c in counts if not c["design"] and c["label"] == 1}, least_rows(risk, level))
    paths = []
    for group in groups:
        told = {label: {(r, k): sum(c[f"{r}.{k}"] for c in counts if c["design"] and c["label"] == label and c["stratum"] in group) for r in RULES for k in range(len(GRID))} for label in (0, 1)}
        paths.append(ordered_steps(told[0], told[1]))
    # a text falls at the first step whose cutoff it exceeds
    fall = F.lit(None).cast("int")
    for group, path in zip(groups, paths, strict=True):
        at = F.coalesce(*[F.when(F.col(f"r_{r}") > GRID[k], i) for i, (r, k) in enumerate(path)], F.lit(len(path)))
        fall = F.when(F.col("stratum").isin(group), at).otherwise(fall)
    fallen = held.filter(~F.col("design") & (F.col("label") == 1)).groupBy("stratum", fall.alias("step")).agg(F.count("*").alias("n")).collect()
    out = {}
    for group, path in zip(groups, paths, strict=True):
        mine = [f for f in fallen if f["stratum"] in group]
        for i, (r, k) in enumerate(path):
            if not refuted(sum(f["n"] for f in mine if f["step"] <= i), sum(f["n"] for f in mine), risk, level):
                break
            out.update({(s, r): GRID[k] for s in group})
    return out


def broken(cutoffs: dict[tuple[int, str], float]) -> Column:
    """Names of the rules that a row of statistics() breaks."""
    hits = [F.when((F.col("stratum") == s) & (F.col(f"r_{r}") > c), F.lit(r)) for (s, r), c in sorted(cutoffs.items())]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """statistics() of docs with broken (rule names) and kept: not base_failed and no rule broken. labels (doc_id,
    quality 0/1): held-out rows are left aside. Without labels no cutoff passes and base_failed alone decides."""
    stats = staged(statistics(docs), "op10-statistics")
    cutoffs = choose_cutoffs(stats, training_labels(labels, "quality"), risk, delta)
    return stats.withColumn("broken", broken(cutoffs)).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, kept, broken), a row a row of documents. Null and empty texts count nothing and
    fail the base; missing labels or labels of one class leave rules without a cutoff; an empty table gives no rows."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))
