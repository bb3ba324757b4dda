"""Near-duplicate join on word five-grams by chosen paths.

Every text becomes a set of hashed five-word shingles and a sketch of COORDINATES sampled tokens: coordinate c holds the
smallest shingle hash of the c-th residue class, and where a short text has no hash of that class, the token of another
coordinate, sought in an order that is the same for all texts. So two sets of any size share a coordinate about as often
as their Jaccard similarity. A run splits all sets on one coordinate; groups above LEAF sets are split again, on as many further
coordinates as BRANCHES has for that level, and groups of at most LEAF sets are compared in full. Runs repeat until a
pair at the threshold is met with the target recall. Every candidate is verified on its whole shingle sets.

Groups that stay above LEAF at the last level hold sets that agree on several sampled tokens: near copies of each other.
Their members are first compared with two members of the group instead of all with all: the most central one, which
agrees most with the group's commonest low bit at each coordinate (the original, where a group is made of its copies),
and one drawn by hash. Members that these links put into one class need no further comparison; those outside the
group's largest class are compared in full with every member of another class, in blocks of BLOCK sets, so no link
between classes is missed. At the end the classes that reach into a huge group are compared whole, every member with
every other in the same blocks, and each member's links are counted there; pairs never leave the task.
Exact copies (equal words) are folded before and never make pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, words

SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
COORDINATES, LEAF, BRANCHES = 64, 40, (2, 1, 1)
#: Sets of a huge group that are compared with as many others at a time, and about how many shingles these have at most.
BLOCK, BLOCK_SHINGLES = 128, 25_000
#: Sketch agreement below which a pair is not verified: five standard errors below the threshold, for sets of few shingles
#: agree less evenly than a sample (of pairs at the threshold, sets of 4 to 450 shingles, 0.02 % at most fall below it).
LEAST_AGREEMENT = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Runs after which a pair at the threshold is met with probability target, whatever the depth."""
    meet = 1.0
    for branches in reversed(BRANCHES):
        meet = 1 - (1 - threshold * meet) ** branches
    return math.ceil(math.log(1 - target) / math.log(1 - threshold * meet))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


EMPTY = np.iinfo(np.uint32).max
#: For each coordinate, the order in which it seeks a token among the others where it has none.
with np.errstate(over="ignore"):
    BORROW = np.argsort(_mix(np.arange(1, COORDINATES**2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(COORDINATES, COORDINATES), axis=1)


def filled(low: np.ndarray) -> np.ndarray:
    """Sketches (a row each) with their EMPTY coordinates filled from others; rows without any token stay EMPTY."""
    out = low.copy()
    row, c = np.nonzero((low == EMPTY) & (low != EMPTY).any(1)[:, None])
    for step in range(COORDINATES):
        out[row, c] = token = low[row, BORROW[c, step]]
        row, c = row[token == EMPTY], c[token == EMPTY]
        if not len(row):
            break
    return out


def shingles_of(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of all rows' word hashes; a row of fewer than SHINGLE words has its word list as one shingle."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
    w = _mix(hashes.view(np.uint64))
    total = np.zeros(len(w), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):  # beyond the row's end nothing is added
            part = np.zeros(len(w), np.uint64)
            part[: len(w) - i] = w[i:]
            part[place + i >= n[rows]] = 0
            total = total * np.uint64(0x9E3779B97F4A7C15) + part
        total = _mix(total)
    keep = (place == 0) | (place + SHINGLE <= n[rows])
    return rows[keep], total[keep]


def _slices(offsets: np.ndarray, most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` words each (or one row)."""
    a, last = 0, len(offsets) - 1
    while a < last:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, last)
        a = b


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, hashes = _lists(batch, "cp_words")
        for a, b in _slices(offsets):
            rows, sh = shingles_of(offsets[a : b + 1] - offsets[a], hashes[offsets[a] : offsets[b]])
            where = rows * COORDINATES + (sh % np.uint64(COORDINATES)).astype(np.int64)
            low = np.full((b - a) * COORDINATES, EMPTY, np.uint32)
            np.minimum.at(low, where, (sh >> np.uint64(32)).astype(np.uint32))
            low = filled(low.reshape(-1, COORDINATES)).ravel()
            ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * COORDINATES)
            bits = np.packbits((low & 1).astype(np.uint8).reshape(-1, COORDINATES), axis=1, bitorder="little").view(np.int64).ravel()
            columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.ListArray.from_arrays(ends, pa.array(low.view(np.int32))), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, ["cp_id", "cp_key", "cp_sketch", "cp_bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, hashes = _lists(batch, "cp_words")
        for a, b in _slices(offsets):
            rows, sh = shingles_of(offsets[a : b + 1] - offsets[a], hashes[offsets[a] : offsets[b]])
            order = np.lexsort((sh, rows))
            rows, sh = rows[order], sh[order]
            first = np.ones(len(sh), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (sh[1:] != sh[:-1])
            rows, sh = rows[first], sh[first]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(sh.view(np.int64)))], ["cp_id", "cp_set"])


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["cp_a", "cp_b"])


def _pairs_in_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each small group whose sketches agree well enough."""
    for batch in batches:
        pairs = []
        for ids, sketches in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = sketches.values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), COORDINATES)
            used = s != -1
            for i in range(len(ids) - 1):
                either = (used[i] | used[i + 1 :]).sum(1)
                same = ((s[i] == s[i + 1 :]) & used[i]).sum(1)
                pairs += [(ids[i], ids[i + 1 + j]) for j in np.flatnonzero(same >= LEAST_AGREEMENT * either)]
        yield _pair_batch(pairs)


def _incidence(sets: pa.Array, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which set holds which of the shared shingles, as a matrix, and the sizes of the sets."""
    sizes, flat = sets.value_lengths().to_numpy(zero_copy_only=False), sets.flatten().to_numpy()
    place = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
    held = shared[place] == flat
    matrix = np.zeros((len(sizes), len(shared)), np.float32)
    matrix[np.repeat(np.arange(len(sizes)), sizes)[held], place[held]] = 1
    return matrix, sizes


def links_of_blocks(threshold: float):
    """Links between members of different classes of two blocks: all set intersections of the blocks as one product."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for a, class_a, set_a, b, class_b, set_b in zip(*batch.columns, strict=True):
                a, class_a, b, class_b = (x.values.to_numpy() for x in (a, class_a, b, class_b))
                shared = np.intersect1d(set_a.values.flatten().to_numpy(), set_b.values.flatten().to_numpy())
                if len(shared):
                    (one, n), (other, m) = _incidence(set_a.values, shared), _incidence(set_b.values, shared)
                    common = (one @ other.T).astype(np.float64)
                    near = (common >= threshold * (n[:, None] + m - common)) & (class_a[:, None] != class_b)
                    pairs += [(a[i], b[j]) for i, j in np.argwhere(near)]
            yield _pair_batch(pairs)

    return find


def counts_of_blocks(threshold: float):
    """(cp_id, cp_links) of the members of blocks b: copies of the members of blocks a that are near them, summed over
    the blocks of a task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Counter()
        for batch in batches:
            for a, copies, set_a, b, set_b in zip(*batch.columns, strict=True):
                a, copies, b = (x.values.to_numpy() for x in (a, copies, b))
                shared = np.intersect1d(set_a.values.flatten().to_numpy(), set_b.values.flatten().to_numpy())
                if len(shared):
                    (one, n), (other, m) = _incidence(set_a.values, shared), _incidence(set_b.values, shared)
                    common = (one @ other.T).astype(np.float64)
                    near = (common >= threshold * (n[:, None] + m - common)) & (a[:, None] != b)
                    for i, k in zip(b.tolist(), (copies @ near).tolist(), strict=True):
                        links[i] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64())], ["cp_id", "cp_links"])

    return find


def _place(run: Column, node: Column) -> Column:
    """The coordinate (from 1) that a node of a run's tree splits on; nodes count as in a heap, the root being 0 here.
    7 and 13 are odd, so runs begin on different coordinates and a path does not meet one twice within 63 nodes."""
    return (F.pmod(run * 13 + node * 7, F.lit(COORDINATES)) + 1).cast("int")


def _pivots(large: DataFrame, bits: DataFrame) -> list[DataFrame]:
    """Two tables (key, pivot) of the groups in large (key, cp_id). The commonest low bits are sums, so that no group is
    gathered in a task."""
    members = staged(large.select("key", "cp_id").join(bits, "cp_id"), "op2-large")
    ones = [F.sum(F.shiftrightunsigned("cp_bits", c).bitwiseAND(F.lit(1))).alias(f"c{c}") for c in range(COORDINATES)]
    common = F.lit(0).cast("long")
    for c in range(COORDINATES):
        common = common.bitwiseOR(F.shiftleft((2 * F.col(f"c{c}") > F.col("n")).cast("long"), c))
    centres = members.groupBy("key").agg(F.count("*").alias("n"), *ones).select("key", common.alias("centre"))
    drawn = F.xxhash64(F.lit(0), "cp_id")
    # most agreement, then a draw that all groups share, as one number
    agreed = COORDINATES - F.bit_count(F.col("cp_bits").bitwiseXOR(F.col("centre")))
    near = F.shiftleft(agreed.cast("long"), 55) + F.shiftrightunsigned(drawn, 9)
    central = members.join(centres, "key").select("key", "cp_id", near.alias("near")).groupBy("key").agg(F.max_by("cp_id", "near").alias("pivot"))
    return [central, members.groupBy("key").agg(F.min_by("cp_id", drawn).alias("pivot"))]


def across_classes(large: DataFrame, texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame | None:
    """(cp_a < cp_b) links of different classes within the groups of large (key, cp_id): members outside the largest
    class of their group against all others; None where every group has one class. classes (cp_id, cp_class); a member
    without one is its own class. Every two blocks of a group are a row of their own, so groups of any size spread."""
    labelled = staged(large.select("key", "cp_id").join(classes, "cp_id", "left").select("key", "cp_id", F.coalesce("cp_class", "cp_id").alias("cp_class")), "op2-labelled")
    sizes = labelled.groupBy("key", "cp_class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n_all"), F.max("n").alias("most"), F.max_by("cp_class", F.struct("n", "cp_class")).alias("largest")).filter("most < n_all")
    members = staged(labelled.join(mixed.select("key", "largest"), "key"), "op2-mixed")
    if members.isEmpty():
        return None
    rows = staged(members.join(shingle_sets(texts, members.select("cp_id").distinct()), "cp_id"), "op2-mixed-sets").withColumn("few", F.col("cp_class") != F.col("largest"))
    pieces = F.greatest(F.count("*") / BLOCK, F.sum(F.size("cp_set")) / BLOCK_SHINGLES)
    n_blocks = lambda few: rows.filter("few" if few else "true").groupBy("key").agg(F.ceil(pieces).cast("int").alias("blocks"))

    def blocks(members: DataFrame, side: str) -> DataFrame:
        block = F.pmod(F.xxhash64("cp_id"), "blocks").cast("int").alias("block")
        gathered = members.groupBy("key", block).agg(F.collect_list(F.struct("cp_id", "cp_class", "cp_set")).alias("m"))
        return gathered.select("key", "block", *[F.col(f"m.{c}").alias(f"{side}_{c}") for c in ("cp_id", "cp_class", "cp_set")])

    every = n_blocks(False)
    few = blocks(rows.filter("few").join(n_blocks(True), "key"), "a").drop("block").join(every, "key")
    facing = few.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = facing.join(blocks(rows.join(every, "key"), "b"), ["key", "block"]).drop("key", "block")
    return staged(pairs.mapInArrow(links_of_blocks(threshold), "cp_a long, cp_b long").distinct(), "op2-links")


def counted_links(large: DataFrame, texts: DataFrame, classes: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """(cp_id, cp_links): for every member of the classes (cp_id, cp_class) that hold a member of large (key, cp_id), the
    documents of other texts that are near it; copies (cp_id, cp_copies). Every block of a class meets every block of it."""
    reached = large.select("cp_id").distinct().join(classes, "cp_id").select("cp_class").distinct()
    members = staged(classes.join(reached, "cp_class").select("cp_id", "cp_class").join(copies, "cp_id"), "op2-counted")
    rows = staged(members.join(shingle_sets(texts, members.select("cp_id").distinct()), "cp_id"), "op2-counted-sets")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("cp_set")) / BLOCK_SHINGLES)).cast("int").alias("blocks")
    block = F.pmod(F.xxhash64("cp_id"), "blocks").cast("int").alias("block")
    gathered = staged(
        rows.join(rows.groupBy("cp_class").agg(blocks), "cp_class").groupBy("cp_class", "blocks", block)
        .agg(F.collect_list(F.struct("cp_id", "cp_copies", "cp_set")).alias("m")).select("cp_class", "blocks", "block", "m.cp_id", "m.cp_copies", "m.cp_set"), "op2-blocks",
    )
    facing = gathered.select("cp_class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cp_id").alias("a"), "cp_copies", F.col("cp_set").alias("set_a"))
    pairs = facing.join(gathered.select("cp_class", "block", F.col("cp_id").alias("b"), F.col("cp_set").alias("set_b")), ["cp_class", "block"]).drop("cp_class", "block")
    return pairs.mapInArrow(counts_of_blocks(threshold), "cp_id long, cp_links long").groupBy("cp_id").agg(F.sum("cp_links").alias("cp_links"))


def candidates(sketches: DataFrame, runs: int) -> tuple[DataFrame, DataFrame | None]:
    """(cp_a < cp_b) pairs to verify from sketches (cp_id, cp_sketch, cp_bits), without repeats, and the huge groups
    (key, cp_id) that are compared with their pivots only, if there are any."""
    first = [F.struct(F.lit(r).alias("run"), F.element_at("cp_sketch", _place(F.lit(r), F.lit(0))).alias("v")) for r in range(runs)]
    level = (
        sketches.select("cp_id", F.explode(F.array(*first)).alias("x"))
        .filter("x.v <> -1")
        .select("cp_id", "x.run", F.lit(1).alias("node"), F.xxhash64("x.run", "x.v").alias("key"))
    )
    found, huge = [], None
    bits, sketches = sketches.select("cp_id", "cp_bits"), sketches.select("cp_id", "cp_sketch")
    for depth in range(len(BRANCHES) + 1):
        # written, so that the join below reads two shuffles, of which Spark can split a group that a third of all rows have
        counts = staged(level.groupBy("key").agg(F.count("*").alias("cp_n")).filter("cp_n > 1"), f"op2-counts{depth}")
        sized = staged(level.join(counts, "key"), f"op2-groups{depth}")
        # a group holds LEAF sets at most here
        leaves = sized.filter(F.col("cp_n") <= LEAF).join(sketches, "cp_id").groupBy("key").agg(F.collect_list(F.struct("cp_id", "cp_sketch")).alias("m"))
        found.append(leaves.select("m.cp_id", "m.cp_sketch").mapInArrow(_pairs_in_leaves, "cp_a long, cp_b long"))
        large = sized.filter(F.col("cp_n") > LEAF)
        if large.isEmpty():
            break
        if depth == len(BRANCHES):
            huge = large
            for pivots in _pivots(large, bits):
                against = large.join(pivots, "key").filter("cp_id <> pivot")
                found.append(against.select(F.least("cp_id", "pivot").alias("cp_a"), F.greatest("cp_id", "pivot").alias("cp_b")))
        else:
            nodes = [F.col("node") * 2 + b for b in range(BRANCHES[depth])]
            split = F.array(*[F.struct(n.alias("node"), F.element_at("cp_sketch", _place(F.col("run"), n)).alias("v")) for n in nodes])
            level = (
                large.join(sketches, "cp_id")
                .select("cp_id", "run", "key", F.explode(split).alias("x"))
                .filter("x.v <> -1")
                .select("cp_id", "run", "x.node", F.xxhash64("key", "x.node", "x.v").alias("key"))
            )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct(), huge


def components(edges: DataFrame) -> DataFrame:
    """(cp_id, cp_class) of the nodes of edges (cp_a, cp_b): the smallest id of each connected component, by repeated
    minimum of the neighbours' labels and label halving; the work of a round follows the number of edges."""
    both = staged(edges.select("cp_a", "cp_b").unionByName(edges.select(F.col("cp_b").alias("cp_a"), F.col("cp_a").alias("cp_b"))), "op2-edges")
    labels = staged(both.groupBy("cp_a").agg(F.least(F.min("cp_b"), F.first("cp_a")).alias("cp_class")).withColumnRenamed("cp_a", "cp_id"), "op2-labels")
    while True:  # every round lets a label pass one edge and one jump at least, so it ends
        near = both.join(labels, both.cp_b == labels.cp_id).groupBy("cp_a").agg(F.min("cp_class").alias("near"))
        better = labels.join(near, labels.cp_id == near.cp_a).select("cp_id", F.least("cp_class", "near").alias("cp_class"), F.col("cp_class").alias("was"))
        jump = labels.select(F.col("cp_id").alias("j"), F.col("cp_class").alias("jumped"))
        new = better.join(jump, better.cp_class == jump.j, "left").select("cp_id", F.least("cp_class", "jumped").alias("cp_class"), "was")
        changes = Observation()
        labels = staged(new.observe(changes, F.count_if(F.expr("cp_class <> was")).alias("n")).select("cp_id", "cp_class"), "op2-labels")
        if not changes.get["n"]:
            return labels


@contextmanager
def bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Within, Spark puts Bloom filters before the shuffle of a large join side of any size, not from 10 GB on."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1MB")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_hashes() -> Column:
    return F.transform(words(F.lower("text")), lambda w: F.xxhash64(w)).alias("cp_words")


def shingle_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(cp_id, cp_set) of the texts (cp_id, text) whose id is in ids (cp_id)."""
    # few texts are wanted: the ids are written, so that Spark knows their size and broadcasts them below its threshold;
    # beyond it, its Bloom filter keeps the other texts out of the shuffle (it weighs filtered sides only, hence the
    # condition, which holds for every id)
    picked = staged(ids, "op2-wanted").filter(F.col("cp_id") >= F.lit(-(2**63)))
    with bloom_filters(texts.sparkSession):
        return staged(texts.join(picked, "cp_id", "left_semi").select("cp_id", word_hashes()).mapInArrow(_sets, "cp_id long, cp_set array<long>"), "op2-sets")


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (cp_a, cp_b) whose whole shingle sets reach the threshold; texts (cp_id, text)."""
    sets = shingle_sets(texts, pairs.select(F.col("cp_a").alias("cp_id")).unionByName(pairs.select(F.col("cp_b").alias("cp_id"))).distinct())
    left, right = sets.toDF("cp_a", "cp_sa"), sets.toDF("cp_b", "cp_sb")
    common = F.size(F.array_intersect("cp_sa", "cp_sb"))
    near = pairs.join(left, "cp_a").join(right, "cp_b").filter(common >= threshold * (F.size("cp_sa") + F.size("cp_sb") - common))
    return staged(near.select("cp_a", "cp_b").distinct(), "op2-links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, count_links: bool = True) -> DataFrame:
    """(doc_id, class_id, copies, links) of docs (doc_id, text), one row a row of docs with an id (rows without one are
    left out). class_id is the smallest doc_id among documents joined by links of Jaccard similarity >= threshold on
    distinct five-word shingles of lower-cased words; copies counts the documents with the same words, links the other
    documents on verified links (copies count). Without count_links, two members of a huge group whose class other links
    show may go uncompared, so links is then too small there; class_id is the same. Texts without words (null, empty,
    blank) link to nothing. Repeated ids fold: an id has the class of all its texts."""
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("cp_id"), "text")
    key = F.concat_ws(".", F.xxhash64("cp_words").cast("string"), F.xxhash64(F.lit(1), "cp_words").cast("string"))
    hashed = texts.select("cp_id", word_hashes()).select("cp_id", F.when(F.size("cp_words") > 0, key).alias("cp_key"), "cp_words")
    members = staged(hashed.mapInArrow(_sketch, "cp_id long, cp_key string, cp_sketch array<int>, cp_bits long"), "op2-members")
    folded = staged(members.filter("cp_key is not null").groupBy("cp_key").agg(F.min("cp_id").alias("cp_id"), F.count("*").alias("cp_copies")), "op2-folded")
    sketches = staged(members.join(folded, ["cp_key", "cp_id"]).dropDuplicates(["cp_key"]).select("cp_id", "cp_sketch", "cp_bits"), "op2-sketches")
    pairs, huge = candidates(sketches, runs_needed(threshold, target_recall))
    links = verified(texts, staged(pairs, "op2-pairs"), threshold)
    classes = components(links)
    if huge is not None:
        more = across_classes(huge, texts, classes, threshold)
        if more is not None:
            links = staged(links.unionByName(more).distinct(), "op2-links")
            classes = components(links)
    copies = folded.select("cp_id", "cp_copies")
    ends = links.unionByName(links.select(F.col("cp_b").alias("cp_a"), F.col("cp_a").alias("cp_b")))
    n_links = ends.join(copies, ends.cp_b == copies.cp_id).groupBy("cp_a").agg(F.sum("cp_copies").alias("cp_links")).withColumnRenamed("cp_a", "cp_id")
    if huge is not None and count_links:
        counted = staged(counted_links(huge, texts, classes, copies, threshold), "op2-counts")
        n_links = n_links.join(counted, "cp_id", "left_anti").unionByName(counted)
    per_text = folded.join(classes, "cp_id", "left").join(n_links, "cp_id", "left")
    out = members.select(F.col("cp_id").alias("doc_id"), "cp_key").join(per_text, "cp_key", "left").select(
        "doc_id",
        F.coalesce("cp_class", "cp_id", "doc_id").alias("class_id"),
        F.coalesce("cp_copies", F.lit(1)).cast("long").alias("copies"),
        (F.coalesce("cp_links", F.lit(0)) + F.coalesce("cp_copies", F.lit(1)) - 1).cast("long").alias("links"),
    )
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.max("links").alias("links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose class holds a smaller doc_id; rows without an id stay. Rows equal in id and text
    are copies too: one of them stays. Rows that share an id but not the text are one document and fare alike."""
    # written, so that Spark knows its size and moves the documents' texts only where it outgrows a broadcast
    others = staged(near_duplicates(docs, count_links=False, **options).filter("doc_id <> class_id").select("doc_id"), "op2-others")
    out = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    again = staged(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "op2-again")
    if again.isEmpty():
        return out
    once = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, copies, links), one row a document with an id. Texts without words (null, empty, blank) are
    classes of their own without links; texts of fewer than five words are one shingle; repeated ids fold; an empty table
    gives no rows. See near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
