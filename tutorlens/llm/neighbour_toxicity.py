"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts is the index: TF-IDF vectors over the terms whose document counts tell the classes
apart (all other terms are stop words), kept as inverted lists by example number, cut at every BLOCK examples, with the
largest weight of each piece. For a text, the pieces' largest weights bound the cosine of all examples of a block; blocks
are read from the largest bound on, and those whose bound cannot reach the k-th best are never read. The k nearest
examples by exact cosine vote by distance; votes, mapped by isotonic steps fitted on leave-one-out votes, are the score,
and the voters are the evidence.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, staged, table, training_labels

#: Labelled examples of each class in the index at most (the only sample in this operator).
MAX_EXAMPLES = 2_000
NEIGHBOURS, BLOCK, CUTOFF, EVIDENCE = 15, 64, 0.5, 3
#: Log-likelihood ratio at which a term counts as telling, before the correction for the number of terms tried.
ALPHA = 0.01

TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    return Counter(TERM.findall((text or "").lower()))


@dataclass
class Index:
    """terms: term -> (idf, row of the bounds or None where no example has it); lists: for each row, block -> (places in
    the block, weights); examples are numbered by doc_id."""

    terms: dict
    lists: list
    bounds: np.ndarray  # rows x blocks: the largest weight of each piece
    ids: list
    labels: list
    votes: list  # weight of an example's vote: how many labelled rows it stands for
    prior: float
    empty_score: float
    steps: list  # [(vote share from which on, score)]

    def vector(self, counts: Counter) -> list:
        raw = [(t, (1 + math.log(n)) * self.terms[t][0]) for t, n in sorted(counts.items()) if t in self.terms]
        norm = math.sqrt(sum(w * w for _, w in raw))
        return [(t, w / norm) for t, w in raw]

    def nearest(self, vector: list, k: int, without: int = -1) -> list:
        """The k examples with the largest cosine (above 0), exactly; ties to the smaller number: [(-cosine, example)].
        Blocks are read from the largest bound on, up to the first whose bound stays below the k-th best."""
        known = [(self.terms[t][1], q) for t, q in vector if self.terms[t][1] is not None]
        if not known:
            return []
        bound = np.array([q for _, q in known]) @ self.bounds[[r for r, _ in known]]
        best: list = []  # a heap of (cosine, -example), its least on top
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == k and bound[block] < best[0][0] - 1e-12:
                break
            got = np.zeros(BLOCK)
            for row, q in known:
                if piece := self.lists[row].get(block):
                    got[piece[0]] += q * piece[1]
            for place in np.flatnonzero(got).tolist():
                found = (float(got[place]), -(block * BLOCK + place))
                if -found[1] == without:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return sorted((-s, -e) for s, e in best)

    def vote(self, found: list) -> float:
        total, yes = 0.2, 0.2 * self.prior
        for minus, example in found:
            w = self.votes[example] / (1.05 + minus)
            total += w
            yes += w * self.labels[example]
        return yes / total

    def calibrated(self, share: float) -> float:
        return self.steps[max(0, bisect_right(self.steps, (share, 2.0)) - 1)][1] if self.steps else share


def build(examples: list[tuple[int, Counter, int]], sizes: dict[int, int]) -> Index:
    """examples: (doc_id, term counts, label); sizes: labelled rows of each class that they stand for."""
    examples = sorted(examples, key=lambda x: x[0])
    counts = [c for _, c, _ in examples]
    labels = [label for *_, label in examples]
    n = Counter(labels)
    with_term: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for c, label in zip(counts, labels, strict=True):
        for t in c:
            with_term[t][label] += 1

    def telling(a: int, b: int) -> bool:
        """G2 with one degree of freedom: the tail is erfc(sqrt(G2 / 2)); Bonferroni over the terms tried."""
        g2 = 0.0
        for seen, of in ((a, n[0]), (b, n[1])):
            for part, share in ((seen, (a + b) / len(labels)), (of - seen, 1 - (a + b) / len(labels))):
                if part and of * share > 0:
                    g2 += 2 * part * math.log(part / (of * share))
        return bool(n[0] and n[1]) and math.erfc(math.sqrt(max(0.0, g2) / 2)) <= ALPHA / len(with_term)

    kept = sorted(t for t, (a, b) in with_term.items() if telling(a, b))
    idf = {t: math.log((1 + len(labels)) / (1 + sum(with_term[t]))) + 1 for t in kept}
    votes = [sizes.get(label, n[label]) / n[label] for label in labels]
    total = sum(votes)
    prior = sum(v * label for v, label in zip(votes, labels, strict=True)) / total if total else 0.0
    bounds = np.zeros((len(kept), -(-len(examples) // BLOCK)))
    index = Index({t: (idf[t], row) for row, t in enumerate(kept)}, [], bounds, [i for i, *_ in examples], labels, votes, prior, prior, [])
    vectors = [index.vector(c) for c in counts]
    pieces: list[dict] = [defaultdict(list) for _ in kept]
    for e, v in enumerate(vectors):
        for t, w in v:
            pieces[index.terms[t][1]][e // BLOCK].append((e % BLOCK, w))
    for row, of in enumerate(pieces):
        index.lists.append({block: (np.array([p for p, _ in x]), np.array([w for _, w in x])) for block, x in of.items()})
        for block, (_, weights) in index.lists[row].items():
            bounds[row, block] = weights.max()
    blank = [(v, y) for vec, v, y in zip(vectors, votes, labels, strict=True) if not vec]
    index.empty_score = (sum(v * y for v, y in blank) + prior) / (sum(v for v, _ in blank) + 1)
    index.steps = isotonic([(index.vote(index.nearest(v, NEIGHBOURS, e)), votes[e], labels[e]) for e, v in enumerate(vectors) if v])
    return index


def isotonic(points: list[tuple[float, float, int]]) -> list[tuple[float, float]]:
    """Non-decreasing steps (from, mean label) by pooling adjacent violators over (share, weight, label)."""
    pools: list[list[float]] = []
    for share, weight, label in sorted(points):
        if pools and pools[-1][0] == share:
            pools[-1][1] += weight
            pools[-1][2] += weight * label
        else:
            pools.append([share, weight, weight * label])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, w, y = pools.pop()
            pools[-1][1] += w
            pools[-1][2] += y
    return [(share, y / w) for share, w, y in pools]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = MAX_EXAMPLES) -> Index:
    """At most max_examples of either class, by the order of a hash of doc_id, from rows open to training; of rows that
    share an id any one. Texts are cut to their term counts by Spark; the driver builds the index of these."""
    known = staged(training_labels(labels, label), "op6-labels")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # 2 x max_examples rows at most, so it may be broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [terms(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = picked.mapInPandas(counted, f"doc_id {kind}, label int, terms array<string>, counts array<int>").collect()
    return build([(r["doc_id"], Counter(dict(zip(r["terms"], r["counts"], strict=True))), r["label"]) for r in rows], sizes)


def score(docs: DataFrame, index: Index, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): every row of docs once. Texts without a telling term (null, empty
    ones too) get the smoothed share of label 1 among such examples and no evidence; without labels all scores are 0."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the terms of 2 x MAX_EXAMPLES texts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, memo = shared.value, {}
        for frame in frames:
            out = []
            for text in frame["text"]:
                found = TERM.findall((text or "").lower())
                counts = Counter(t for t in found if t in own.terms)
                key = tuple(sorted(counts.items()))
                if key not in memo:
                    if len(memo) > 50_000:
                        memo.clear()
                    near = own.nearest(own.vector(counts), NEIGHBOURS) if counts else []
                    memo[key] = (own.calibrated(own.vote(near)) if near else own.empty_score, [own.ids[e] for _, e in near[:EVIDENCE]])
                out.append(memo[key])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [float(s) for s, _ in out], "evidence": [e for _, e in out]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, evidence array<{kind}>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "evidence")


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), a row a row of documents; odd rows as in score(). A null doc_id
    counts as held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
