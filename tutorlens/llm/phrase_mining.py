"""Phrase collocations from mergeable Misra-Gries summaries and one exact second pass.

Pass 1: tasks turn texts into 64-bit hashes of (lang, phrase) for phrases of one to three words and count them in bounded
buffers. Each buffer is cut by hash partition; a partition merges what all tasks sent into one Misra-Gries summary whose
capacity exceeds the partition's mass (phrase occurrences) divided by the threshold. What a summary takes off all
counters together is then below the threshold, so a phrase that occurs as often always survives. Partitions are numbered
by the leading bits of the hash, and their number follows the bytes of the corpus, so a summary fits in a task whatever
the corpus. Survivors set bits in a filter of FILTER_BITS bits, the only thing broadcast: its size is fixed.
Pass 2: texts are read again and phrases that pass the filter are counted exactly, by their words. What the filter lets
through in error (few, until survivors are about as many as bits) only costs time: counts below the threshold go.

Odd rows: null text is empty; null lang is `und`; empty tables give no row; a text of any length is one slice of its own;
repeated rows count as often as they stand; ids and other columns are not read. Equal scores are ordered by count, then by
phrase. Phrases never cross a separator or the end of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

THRESHOLD, LONGEST, TOP = 10, 3, 2000
#: A candidate goes when a longer one that holds it has this percentage of its count, or more.
COVERED = 50
#: Text bytes that a task tokenizes at once, phrases it counts before it sends, text bytes that a task of the merge
#: stands for (Arrow holds what it reads at once: raise it with the memory of executors), bits of the filter.
SLICE_BYTES, BUFFER, TASK_BYTES, FILTER_BITS = 1 << 22, 1 << 20, 1 << 23, 27
#: Hash partitions a task of the merge, so that tasks are about equal, and tasks at least.
PARTS_A_TASK, LEAST_TASKS = 4, 16
#: Copies of each count that phrases are joined with, so that one common word is not one task; first cut of the top list.
SALTS, FIRST_CUT = 16, 256
SEPARATORS = r"[.,;:!?\x0A-\x0D]+"


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of consecutive rows with about SLICE_BYTES of text."""
    lang, text = pc.fill_null(batch.column(0), "und"), pc.fill_null(batch.column(1), "")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(text)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield lang.slice(a, b - a), text.slice(a, b - a)


class Words:
    """The words of a slice as codes into `names`, in order, separators and ends of texts as code -1."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        marked = pc.replace_substring_regex(pc.ascii_lower(text), SEPARATORS, " . ")
        tokens = pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, ".", " "))
        coded = pc.dictionary_encode(tokens.flatten())
        self.names, self.langs = coded.dictionary, pc.dictionary_encode(lang)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whose = np.repeat(self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        there = code != pc.index(self.names, "").as_py()
        self.code, self.lang = code[there], whose[there]
        self.code[self.code == pc.index(self.names, ".").as_py()] = -1
        self.langs = self.langs.dictionary

    def hashes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1, 2 and 3: where phrases start, and their hashes."""
        name = pd.util.hash_array(self.names.to_numpy(zero_copy_only=False), categorize=False)
        home = pd.util.hash_array(self.langs.to_numpy(zero_copy_only=False), categorize=False)
        word = self.code >= 0
        own, out = name[self.code], []
        h, ok = _mixed(own + home[self.lang]), word
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(ok)
            out.append((at, h[at]))
            if n < LONGEST:
                ok = ok[:-1] & word[n:]
                h = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[n:])
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count[order], first)


class MisraGries:
    """At most `capacity` counters. A true count exceeds its counter by `taken` at most, and taken * (capacity + 1) is at most
    the mass added, in whatever pieces and order it came."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        key, count = merged([self.keys, *keys], [self.counts, *counts])
        if len(key) > self.capacity:
            off = int(np.partition(count, len(count) - self.capacity - 1)[len(count) - self.capacity - 1])
            left = count > off
            key, count = key[left], count[left] - off
            self.taken += off
        self.keys, self.counts = key, count

    def at_least(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.taken >= threshold]


def _sent(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row a hash partition: its mass, its keys as differences and its counts, in planes of bytes, which compress well."""
    of = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    rows = [(int(of[a]), int(counts[a:b].sum()), planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(counts[a:b].astype(np.uint32))) for a, b in zip(edges, edges[1:], strict=False)]
    part, mass, key, count = zip(*rows, strict=True)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(mass, pa.int64()), pa.array(key, pa.binary()), pa.array(count, pa.binary())], ["part", "mass", "keys", "counts"])


def _received(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda x, kind: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(flat(keys, np.uint64), dtype=np.uint64), flat(counts, np.uint32).astype(np.int64)


def _buffered(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for lang, text in slices(batch):
                for _, h in Words(lang, text).hashes():
                    if len(h):
                        k, c = np.unique(h, return_counts=True)
                        keys.append(k)
                        counts.append(c.astype(np.int64))
                        held += len(k)
                if held > BUFFER:
                    yield _sent(*merged(keys, counts), parts)
                    keys, counts, held = [], [], 0
        if held:
            yield _sent(*merged(keys, counts), parts)

    return run


def _bits(keys: np.ndarray) -> tuple[int, bytes]:
    """The filter's bytes from the one of the first key to the one of the last; keys are sorted."""
    at = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    first = int(at[0]) >> 3
    flags = np.zeros(((int(at[-1]) >> 3) - first + 1) * 8, np.uint8)
    flags[at - 8 * first] = 1
    return first, np.packbits(flags).tobytes()


def _summarised(threshold: int):
    def survivors(held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(sum(m for m, _, _ in held) // threshold + 1)
        keys, counts, size = [], [], 0
        for i, (_, k, c) in enumerate(held):
            key, count = _received(k, c)
            keys.append(key)
            counts.append(count)
            size += len(key)
            if size > max(len(summary.keys), BUFFER // 4) or i == len(held) - 1:
                summary.add(keys, counts)
                keys, counts, size = [], [], 0
        found = summary.at_least(threshold)
        if len(found):
            first, bits = _bits(found)
            yield pa.record_batch([pa.array([first], pa.int64()), pa.array([bits], pa.binary())], ["first", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("part", "mass", "keys", "counts")], strict=True):
                if row[0] != part and held:
                    yield from survivors(held)
                    held = []
                part = row[0]
                held.append(row[1:])
        if held:
            yield from survivors(held)

    return run


def frequent_filter(docs: DataFrame, threshold: int = THRESHOLD, task_bytes: int = TASK_BYTES) -> bytes:
    """The bits that hashes of frequent phrases set: 2 ** FILTER_BITS bits, whatever the corpus."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(LEAST_TASKS, -(-size // task_bytes))
    sent = docs.select("lang", "text").mapInArrow(_buffered(tasks * PARTS_A_TASK), "part int, mass long, keys binary, counts binary")
    dealt = sent.repartition(tasks, "part").sortWithinPartitions("part")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for first, bits in dealt.mapInArrow(_summarised(threshold), "first long, bits binary").collect():
        out[first : first + len(bits)] |= np.frombuffer(bits, np.uint8)
    return out.tobytes()


def _counted(held):
    """held: a broadcast filter. Rows (lang, words, phrase, n), 0 words: all words of a lang in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for lang, text in slices(batch):
                yield from exact(Words(lang, text), bits)

    def exact(w: Words, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, names = len(w.names), w.names
        whose, n = np.unique(w.lang[w.code >= 0], return_counts=True)
        yield rows(w, whose, 0, pa.array([""] * len(whose), names.type), n)
        phrase, ids = None, None
        for length, (at, h) in enumerate(w.hashes(), 1):
            place = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            at = at[(bits[place >> 3] >> (7 - (place & 7))) & 1 == 1]
            if length > 1:
                at = at[(ids[at] >= 0) & (ids[at + 1] >= 0)]
            last = w.code[at + length - 1]
            key = (w.lang[at] if length == 1 else ids[at]) * size + last
            found, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if not len(found):
                return
            tail = names.take(pa.array(last[first]))
            phrase = tail if length == 1 else pc.binary_join_element_wise(phrase.take(pa.array(ids[at[first]])), tail, " ")
            ids = np.full(len(w.code), -1, np.int64)
            ids[at] = inverse
            yield rows(w, w.lang[at[first]], length, phrase, n)

    def rows(w: Words, whose: np.ndarray, length: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([w.langs.take(pa.array(whose)), pa.array(np.full(len(n), length, np.int32)), phrase, pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])

    return run


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, words, phrase, n) of every phrase of one to three words with n of threshold or more, counted exactly, and of all
    words of a lang (words 0, phrase empty)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_filter(docs, threshold))
    counted = docs.select("lang", "text").mapInArrow(_counted(held), "lang string, words int, phrase string, n long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("words") == 0) | (F.col("n") >= threshold))


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """rows with the count of the phrase in column `part`."""
    copies = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(copies, ["lang", part, "salt"]).drop("salt")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals: exact for counts below 10 ** 15."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * d(a) * d(a), d(left) * d(right))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each lang."""
    counts = staged(phrase_counts(docs, threshold), "phrases")
    parts = counts.filter("words between 1 and 2").select("lang", "phrase", "n")
    word = F.split("phrase", " ")
    long = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), word.alias("w"))
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("rest"))
    known = _looked_up(_looked_up(cuts, parts, "first", "l"), parts, "rest", "r").withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = known.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = long.filter("words = 3").select("lang", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = [F.desc("b.score"), F.desc("a"), F.asc("phrase")]
    cut = F.pmod(F.xxhash64("phrase"), F.lit(FIRST_CUT))
    near = kept.withColumn("near", F.row_number().over(Window.partitionBy("lang", cut).orderBy(*order))).filter(F.col("near") <= top)
    ranks = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return ranks.join(totals, "lang").select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each lang over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


#: DuckDB form: all phrases are counted, none is pruned beforehand.
ORACLE = rf"""WITH texts AS (SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, range(1, {LONGEST + 1}) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
long AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {THRESHOLD}),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y FROM long, range(1, {LONGEST}) r(c) WHERE c < k),
scored AS (SELECT cuts.lang, cuts.phrase, a, c, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM long g WHERE g.k = 3 AND g.lang = b.lang AND b.phrase IN (array_to_string(g.w[1:2], ' '), array_to_string(g.w[2:3], ' ')) AND 100 * g.a >= {COVERED} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}"""
