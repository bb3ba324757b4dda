"""Best-fit packing by exact complements.

Token lengths have at most CAPACITY different values, so the packing is planned on their counts: a table that does not
grow with the input. For each length, from the longest, single, pair and triple sums of the lengths still available are
looked up for the exact gap and used as often as the counts allow; what is left is packed best-fit decreasing, again on
counts. Singles are always used; how many of the pairs and triples is chosen by the sequences that the plan needs. The plan is a list of patterns (lengths of one sequence) with the sequences that each one fills. Every piece
then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

CAPACITY, END_ID = 1024, 2
#: Shares that all pieces are dealt to at most, and the pieces that are not worth a share of their own.
SHARES, LEAST_SHARE = 20_000, 1_000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Length of a run of blanks or of other characters from which on a text goes to the tokenizer itself: the ranks' matcher
#: recurses on runs of millions. Shorter texts hold no such run and are not searched.
LONG = 50_000
LONG_RUN = re.compile(rf"\s{{{LONG}}}|\S{{{LONG}}}")

_encoders: dict = {}


def _encoder(vocabulary: str, ranks: str):
    """text -> ids of the tokenizer file, without special tokens added. The ranks file holds the same vocabulary and
    gives the same ids several times faster; texts that spell a special token or hold a very long run, and texts that
    the ranks fail on, go to the tokenizer itself."""
    if (vocabulary, ranks) not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={})

        def encode(text: str) -> list[int]:
            if not any(s in text for s in special) and (len(text) < LONG or not LONG_RUN.search(text)):
                return fast.encode_ordinary(text)
            return slow.encode(text, add_special_tokens=False).ids

        _encoders[vocabulary, ranks] = encode
    return _encoders[vocabulary, ranks]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row a piece: ids of the text (null: empty) and end_id, cut from
    the end into full pieces where they are more than capacity; the first piece may be shorter."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary, ranks)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids), capacity), len(ids)], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": frame["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, sequences)] that uses every counted length up; sums are at most capacity. Every plan
    begins with exact fillings: of singles, of singles and pairs, and up to triples. Pairs and triples use up small
    pieces that best fit may place better, so they are tried for the lengths from each of several floors on, and the
    plan with the fewest sequences is taken, of equal ones that with the most exact fillings tried."""
    tries = [(members, floor) for members in (3, 2) for floor in (0, capacity // 2, capacity * 3 // 4, capacity * 7 // 8)] + [(1, 0)]
    return min((_plan(counts, capacity, *t) for t in tries), key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, members: int, floor: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fillings with up to `members` others beside lengths of at least floor (singles beside all), then best fit."""
    left = Counter({k: v for k, v in counts.items() if v > 0})
    have = np.zeros(capacity + 1, bool)
    have[list(left)] = True
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        times = min(left[k] // n for k, n in need.items())
        if times:
            out.append((lengths, times))
            for k, n in need.items():
                left[k] -= n * times
                if not left[k]:
                    del left[k]
                    have[k] = False
        return times > 0

    def exact(length: int, gap: int) -> Iterator[tuple[int, ...]]:
        """Fillings of the gap beside length by available lengths: the single one, then pairs, then triples, longest
        members first; all of them, as far as the caller reads."""
        yield (gap,)
        a = np.flatnonzero(have[: min(gap, length) + 1])
        if members >= 2 and length >= floor:
            for x in a[have[gap - a] & (a * 2 >= gap)][::-1].tolist():
                yield x, gap - x
        if members >= 3 and length >= floor:
            for x in a[a * 3 >= gap][::-1].tolist():
                b = a[(a <= x) & (a <= gap - x)]
                for y in b[have[gap - x - b] & (b * 2 >= gap - x)][::-1].tolist():
                    yield x, y, gap - x - y

    if capacity in left:
        use((capacity,))
    for length in sorted(left, reverse=True):
        for others in exact(length, capacity - length):
            use((length, *others))
            if not left[length]:
                break
    while left:
        longest = max(left)
        lengths, gap, rest = [longest], capacity - longest, Counter(left)
        rest[longest] -= 1
        while fits := [k for k, n in rest.items() if n > 0 and k <= gap]:
            k = max(fits)
            lengths.append(k)
            rest[k] -= 1
            gap -= k
        use(tuple(lengths))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with doc_id, piece, length; it must give the same rows when read again) with sequence_id and offset. Pieces
    of a length are alike to the plan, so ties need no order; equal rows get places of their own. The pieces of a length
    are dealt to as many shares as they need, and a share is ranked in one task."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    per_share = max(LEAST_SHARE, sum(counts.values()) // SHARES)
    shares = {k: -(-n // per_share) for k, n in counts.items()}
    if max(shares.values(), default=1) > 1:
        dealt = F.element_at(F.create_map(*[F.lit(x).cast("long") for k, n in shares.items() if n > 1 for x in (k, n)]), F.col("length"))
    else:
        dealt = F.lit(None).cast("long")
    share = F.pmod(F.xxhash64("doc_id", "piece", F.lit(5)), F.coalesce(dealt, F.lit(1))).alias("pk_share")
    ranked = cut.select("*", share).withColumn("pk_rank", F.row_number().over(Window.partitionBy("length", "pk_share").orderBy("doc_id", "piece")))
    # capacity + SHARES rows at most
    sizes = [tuple(r) for r in cut.groupBy("length", share).agg(F.count("*").alias("n")).collect()]
    total: Counter = Counter()
    before = {}
    for length, part, n in sorted(sizes):
        before[length, part] = total[length]
        total[length] += n
    base, total = {k: ([], []) for k in counts}, Counter()
    sequence = 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for k in lengths:  # ranks total[k] .. total[k] + times stand at this offset of sequences from `sequence` on
            base[k][0].append(total[k])
            base[k][1].append((sequence, offset))
            total[k] += times
            offset += k
        sequence += times

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, offsets = [], []
            for length, part, rank in zip(frame["length"], frame["pk_share"], frame["pk_rank"], strict=True):
                rank += before[length, part] - 1
                starts, where = base[length]
                at = bisect_right(starts, rank) - 1
                ids.append(where[at][0] + rank - starts[at])
                offsets.append(where[at][1])
            yield frame[names].assign(sequence_id=np.array(ids, np.int64), offset=np.array(offsets, np.int64))

    names = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    without text is one piece of one id. An id that stands twice is packed twice. No documents: no rows."""
    return pack(staged(pieces(docs, **options), "op3-pieces"), options.get("capacity", CAPACITY))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places. A null or empty text is one piece of the end id; rows that share an
    id are packed each; the ids of very long runs come from the tokenizer itself; an empty table gives no rows."""
    return pack_documents(table(spark, sf_dir, "documents"))
