"""Pairs of close texts: TF-IDF rows kept as sparse blocks, and every two blocks met in one task."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import staged
from .scorers import STOP_WORDS, TOKEN

#: Words of a part, and terms of a block, about; blocks that small inputs are cut into, if each has LEAST terms.
CUT, SIZE, SPREAD, LEAST = 1 << 21, 1 << 21, 8, 1 << 17
#: Meetings that are held at once.
MEETINGS = 1 << 19
_PART = {"ids": np.int64, "ends": np.int32, "at": np.int32, "tf": np.int32, "term": np.int64}
_BLOCK = {"ids": np.int64, "norm": np.float64, "ends": np.int32, "head": np.float64, "firsts": np.int32, "at": np.int32, "tf": np.int32, "term": np.int64, "place": np.int32, "df": np.int64}


def close_texts(texts: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of the pairs a < b with a cosine of `least` or more, weights as in scorers.tfidf(). texts (content_id, a whole
    number, and text): equal texts count once, under their smallest id, and N is the number of different ones.

    Texts are shuffled once, then cut into blocks of sparse rows (terms as 64-bit hashes, counts). Frequencies travel once a
    block and term. Blocks are met by a cartesian product, which reads them again and again but writes nothing: neither
    meetings nor candidates leave their task, so disk grows with the texts and not with their pairs."""
    kind = dict(texts.dtypes)["content_id"]
    digest = F.unhex(F.sha2("text", 256))
    first = staged(texts.groupBy(digest.alias("digest")).agg(F.min("content_id").alias("content_id")), "first")
    held = first.groupBy("content_id").agg(F.collect_list("digest").alias("digests"))
    own = texts.groupBy("content_id").agg(F.collect_set("text").alias("texts")).join(held, "content_id")
    kept = F.filter("texts", lambda x: F.array_contains("digests", F.unhex(F.sha2(x, 256))))
    terms = F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))))
    parts = own.select(F.col("content_id").cast("long").alias("id"), terms.alias("terms")).mapInArrow(_cut, "n long, ids binary, ends binary, at binary, tf binary, term binary, docs binary")
    n_docs = first.count()
    blocks, count = _blocks(staged(parts.withColumn("part", F.monotonically_increasing_id()), "parts"), n_docs, least)
    side = lambda name: blocks.repartitionByRange(count, "block").select([F.col(c).alias(f"{c}_{name}") for c in blocks.columns])
    both = side("a").join(side("b"), F.col("block_a") <= F.col("block_b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda name: _Block({c: _unpacked(batch[f"{c}_{name}"][row].as_buffer(), kind) for c, kind in _BLOCK.items()}, n_docs)  # noqa: B023, E731
                a = read("a")
                b = a if batch["block_a"][row] == batch["block_b"][row] else read("b")
                yield from _met(a, b, least)
                del a, b
                pa.default_memory_pool().release_unused()  # the next task may run in the same process

    return both.mapInArrow(meet, "a long, b long, sim double").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "sim")


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte (all first bytes, all second ones, ...), which leaves little of small ones."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _unpacked(held: pa.Buffer, kind: type) -> np.ndarray:
    n, size = int.from_bytes(held[:8].to_pybytes(), "little"), np.dtype(kind).itemsize
    raw = pa.decompress(held[8:], n * size, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _steps(at: np.ndarray) -> np.ndarray:
    """Numbers that mostly ascend, as steps from each to the next; np.cumsum() undoes it."""
    return np.diff(at, prepend=at.dtype.type(0))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, terms) as parts of sparse rows: `at` are places in `term` (hashes), `docs` the rows that have each."""
    for batch in batches:
        last = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False))
        for part in np.split(np.arange(len(last)), np.flatnonzero(np.diff(last // CUT)) + 1):
            if len(part):
                yield from _part(batch.slice(part[0], len(part)))


def _part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words = pc.list_flatten(batch["terms"]).dictionary_encode()
    stop = pc.is_in(words.dictionary, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
    code, row = words.indices.to_numpy(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False))
    use = np.bincount(code, minlength=len(stop))
    place = np.empty(len(stop), np.int64)
    place[np.argsort(-use, kind="stable")] = np.arange(len(stop))  # frequent words have low places: small steps
    code, row = code[~stop[code]], row[~stop[code]]
    key, tf = np.unique(row * len(stop) + place[code], return_counts=True)
    if len(key):
        row, at = np.divmod(key, len(stop))
        rows, n = np.unique(row, return_counts=True)
        term = np.empty(len(stop), np.int64)
        term[place] = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in words.dictionary.to_pylist()), np.int64)
        docs = np.bincount(at, minlength=len(stop))
        numbers = {"ids": batch["id"].to_numpy()[rows], "ends": np.cumsum(n).astype(np.int32), "at": _steps(at.astype(np.int32)), "tf": tf.astype(np.int32), "term": term, "docs": docs}
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(key)], pa.int64())} | {c: pa.array([_packed(x)], pa.binary()) for c, x in numbers.items()})


def _blocks(parts: DataFrame, n_docs: int, least: float) -> tuple[DataFrame, int]:
    """The parts put together to blocks, and their number: rows with their norms, terms from the rarest on; see _Block."""
    sizes = sorted(parts.select("part", "n").collect())  # a row for some million words
    size = max(LEAST, min(SIZE, -(-sum(r.n for r in sizes) // SPREAD)))
    ends = np.cumsum([0, *[r.n for r in sizes]])
    dealt = [(r.part, int(at) // size) for r, at in zip(sizes, ends, strict=False)]
    owned = parts.join(F.broadcast(parts.sparkSession.createDataFrame(dealt, "part long, block int")), "part")

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                term, docs = (_unpacked(batch[c][row].as_buffer(), np.int64) for c in ("term", "docs"))
                yield pa.RecordBatch.from_pydict({"block": np.repeat(batch["block"].to_numpy()[row], (docs > 0).sum()), "term": term[docs > 0], "docs": docs[docs > 0]})

    words = owned.select("block", "term", "docs").mapInArrow(used, "block int, term long, docs long")
    shared = words.select("block", "term", F.sum("docs").over(Window.partitionBy("term")).alias("df")).filter("df > 1")  # the others have 1

    def weigh(owned: pa.Table, shared: pa.Table) -> pa.Table:
        term, at = np.unique(shared["term"].to_numpy(), return_index=True)
        if not len(term):  # nothing to meet others by
            return pa.table({c: [] for c in ("block", *_BLOCK)}, pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in _BLOCK]]))
        df = shared["df"].to_numpy()[at]
        rank = np.empty(len(term), np.int64)
        rank[np.lexsort((term, df))] = np.arange(len(term))
        found = {c: [] for c in ("ids", "norm", "n", "head", "firsts", "at", "tf")}
        for row in range(owned.num_rows):
            ids, ends, at, tf, own = (_unpacked(owned[c][row].as_buffer(), kind) for c, kind in _PART.items())
            at, rows, place = np.cumsum(at), np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0)), np.searchsorted(term, own)
            place[place == len(term)] = 0
            known = term[place] == own
            weight = tf * _idf(np.where(known, df[place], 1), n_docs)[at]
            met = known[at]
            key = rows[met] * len(term) + rank[place][at[met]]
            sort = np.argsort(key)
            norm, rows, n = np.sqrt(np.bincount(rows, weight * weight)), rows[met], np.bincount(rows[met], minlength=len(ids))
            ends, squares = np.cumsum(n), (weight[met][sort] / norm[rows]) ** 2
            sums = np.append(0, np.cumsum(squares))
            rest = sums[ends][rows] - sums[:-1]  # a row's terms stay together when sorted
            for c, x in (("ids", ids), ("norm", norm), ("n", n), ("head", sums[ends] - sums[ends - n]), ("firsts", np.bincount(rows[rest >= max(0, least - 1e-9) ** 2], minlength=len(ids))), ("at", key[sort] % len(term)), ("tf", tf[met][sort])):
                found[c].append(x)
        whole = {c: np.concatenate(x) for c, x in found.items()}
        numbers = whole | {"ends": np.cumsum(whole["n"]).astype(np.int32), "firsts": whole["firsts"].astype(np.int32), "at": _steps(whole["at"].astype(np.int32)), "term": _steps(term), "place": rank.astype(np.int32), "df": df}
        return pa.table({"block": owned["block"].slice(0, 1)} | {c: pa.array([_packed(numbers[c])], pa.binary()) for c in _BLOCK})

    blocks = owned.drop("docs").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(weigh, ", ".join(["block int", *[f"{c} binary" for c in _BLOCK]]))
    return staged(blocks, "blocks"), max(1, len({block for _, block in dealt}))


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1 + n_docs) / (1 + df)) + 1


class _Block:
    """Rows of a block: entry k is the term `at[k]` with the weight `w[k]` (divided by its row's `norm` where it counts); `term`
    has the hashes in order, and `place` where `at` has them. A row's terms from one on have the norm `rest`, from its first on
    the square `head` (terms of no other row are left out), and `firsts` of them have a rest of `least` or more: the entries
    `first`, of the rows `row`."""

    def __init__(self, x: dict[str, np.ndarray], n_docs: int):
        self.ids, self.ends, self.norm, self.place = x["ids"], x["ends"], x["norm"], x["place"]
        self.starts = np.append(0, self.ends[:-1])
        self.term, self.at = np.cumsum(x["term"]), np.cumsum(x["at"], dtype=np.int64)
        idf = np.empty(len(self.term))
        idf[self.place] = _idf(x["df"], n_docs)
        self.w = idf.take(self.at)
        self.w *= x["tf"]
        n = x["firsts"]
        before = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        self.first = np.arange(n.sum()) + np.repeat(self.starts - before, n)
        sums = np.append(0, np.cumsum((self.w[self.first] / self.norm[self.row]) ** 2))
        self.rest = np.sqrt(np.maximum(0, np.repeat(x["head"] + sums[before], n) - sums[:-1]))


def _met(a: _Block, b: _Block, least: float) -> Iterator[pa.RecordBatch]:
    """Close pairs of a row of a and one of b. With terms in one order, rarest first, a pair's terms from one place on add no
    more than the product of both rows' norms from there, so a pair that meets first where this is below `least` is not close:
    rows meet by their first entries alone. Every pair met is summed over all its terms."""
    found = np.searchsorted(a.term, b.term)
    found[found == len(a.term)] = 0
    both = a.term[found] == b.term
    at = np.full(len(b.term), len(a.term))  # terms of b as a has them; what a lacks has the last place
    at[b.place[both]] = a.place[found[both]]
    at, key = at.take(b.at), a.at[a.first]
    sort = np.argsort(key, kind="stable")
    row, rest = a.row[sort], a.rest[sort]
    count = np.bincount(key, minlength=len(a.term) + 1)
    start = np.cumsum(count) - count
    asks = np.flatnonzero(count[at[b.first]])
    own, ask_rest, term = b.row[asks], b.rest[asks], at[b.first[asks]]
    n = count[term]
    ends, k, open_ = np.cumsum(n), 0, np.zeros(0, np.int64)
    shift = start[term] - ends + n
    while k < len(n):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - n[k] + MEETINGS, side="right")))
        ask = np.repeat(np.arange(k, to), n[k:to])
        met = np.arange(ends[k] - n[k], ends[to - 1]) + shift[ask]
        near = rest[met] * ask_rest[ask] >= least - 1e-9
        if a is b:
            near &= row[met] < own[ask]
        pairs = np.setdiff1d(own[ask[near]] * len(a.ids) + row[met[near]], open_)
        yield _sums(a, b, at, pairs, least)
        goes_on = to < len(n) and own[to] == own[to - 1]  # a row whose entries are not all asked yet: its pairs are not summed twice
        open_ = np.concatenate([open_[open_ // len(a.ids) == own[to]], pairs[pairs // len(a.ids) == own[to]]]) if goes_on else open_[:0]
        k = to


def _sums(a: _Block, b: _Block, at: np.ndarray, pairs: np.ndarray, least: float) -> pa.RecordBatch:
    """Sums of products of pairs (row of b times the rows of a, plus row of a) that are `least` or more. The shorter row is
    looked up in the longer one."""
    of_b, of_a = np.divmod(pairs, len(a.ids))
    out, short = np.empty(len(pairs)), (a.ends - a.starts)[of_a] <= (b.ends - b.starts)[of_b]
    a_long = np.flatnonzero(~short)
    a_long = a_long[np.argsort(of_a[a_long], kind="stable")]
    dense = np.zeros(len(a.term) + 1)
    for these, x, at_x, rows_x, y, at_y, rows_y in ((np.flatnonzero(short), b, at, of_b, a, a.at, of_a), (a_long, a, a.at, of_a, b, at, of_b)):
        last, found, rows = -1, [], rows_y[these]
        for i, first, end in zip(rows_x[these].tolist(), y.starts[rows].tolist(), y.ends[rows].tolist(), strict=True):
            if i != last:
                dense[at_x[x.starts[last] : x.ends[last]] if last >= 0 else slice(0)] = 0
                dense[at_x[x.starts[i] : x.ends[i]]] = x.w[x.starts[i] : x.ends[i]]
                dense[-1], last = 0, i
            found.append(dense.take(at_y[first:end]) @ y.w[first:end])
        out[these] = found
        dense[:] = 0
    out /= a.norm[of_a] * b.norm[of_b]
    close = out >= least
    one, other = a.ids[of_a[close]], b.ids[of_b[close]]
    return pa.RecordBatch.from_pydict({"a": np.minimum(one, other), "b": np.maximum(one, other), "sim": out[close]})
