"""Scorers: long (user_id, content_id, score) frames over the users x catalog grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import FMRegressor, LinearRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import staged
from . import factors

# Words that text scoring leaves out.
STOP_WORDS = [
    "un", "una", "unas", "unos", "el", "la", "las", "los", "al", "del", "lo", "alguno", "algunos", "alguna", "algunas", "de", "en", "para", "por", "con", "sin",
    "sobre", "bajo", "entre", "hasta", "desde", "hacia", "y", "o", "u", "e", "pero", "mas", "como", "cuando", "donde", "quien", "que", "cual", "cuyo", "este",
    "esta", "estos", "estas", "ese", "esa", "esos", "esas", "aquel", "aquella", "aquellos", "aquellas", "mi", "tu", "su", "mis", "tus", "sus", "nuestro",
    "nuestra", "nuestros", "nuestras", "yo", "ella", "nosotros", "nosotras", "vosotros", "vosotras", "ellos", "ellas", "me", "te", "se", "nos", "os", "le",
    "les", "mio", "tuyo", "suyo", "míos", "tuyos", "suyos", "miá", "tuá", "suá", "mías", "tuyas", "suyas", "no", "si", "sí", "muy", "mucho", "poco", "menos",
    "bastante", "demasiado", "casi", "solo", "también", "tampoco", "ser", "estar", "hacer", "tener", "haber", "poder", "querer", "ir", "venir", "ver", "dar",
    "saber", "cómo", "qué", "cuál", "cuándo", "dónde",
]
TOKEN = r"[\p{L}\p{N}_]{2,}"


def grid(users: DataFrame, contents: DataFrame) -> DataFrame:
    """Every user with every content: what is ranked. Spark broadcasts the catalog while it is small."""
    return users.select("user_id").crossJoin(contents.select("content_id"))


def popularity(train: DataFrame, users: DataFrame, contents: DataFrame) -> DataFrame:
    counts = train.groupBy("content_id").agg(F.count("*").cast("double").alias("score"))
    return grid(users, contents).join(counts, "content_id", "left").select("user_id", "content_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def pair_coin(seed: int) -> Column:
    """A fixed shuffle of (user, content) pairs that any SQL engine repeats."""
    return F.pmod(F.col("user_id") * 7919 + F.col("content_id") * 104729 + seed * 31, F.lit(1000003))


def random_topk(users: DataFrame, contents: DataFrame, history: DataFrame | None, k: int = 5, seed: int = 123) -> DataFrame:
    """k items a user by pair_coin, not in the history, score 1, all others 0."""
    every = grid(users, contents)
    free = every if history is None else every.join(history.select("user_id", "content_id").distinct(), ["user_id", "content_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(pair_coin(seed), "content_id")
    chosen = free.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("user_id", "content_id", F.lit(1.0).alias("score"))
    return every.join(chosen, ["user_id", "content_id"], "left").select("user_id", "content_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def tfidf(texts: DataFrame, key: str = "content_id", text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, term, weight): raw counts times ln((1 + N) / (1 + df)) + 1, rows of length 1. A key may have several rows of
    text; N is the number of keys."""
    terms = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term")).filter(~F.col("term").isin(stop_words))
    tf = staged(terms.groupBy(key, "term").agg(F.count("*").alias("tf")), "terms")  # texts are cut into terms once
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = texts.agg(F.countDistinct(key).alias("n_docs"))  # one row
    raw = tf.join(df, "term").crossJoin(total).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("raw"), "df", "n_docs")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def similarity(weights: DataFrame) -> DataFrame:
    """(a, b, sim): cosine of contents that share a term."""
    left = weights.select(F.col("content_id").alias("a"), "term", F.col("weight").alias("wa"))
    right = weights.select(F.col("content_id").alias("b"), "term", F.col("weight").alias("wb"))
    return left.join(right, "term").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def close_pairs(weights: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of the pairs a < b with a cosine of `least` or more. weights are rows of length 1. With terms in one order,
    rarest first, a pair's terms from one place on add no more than the product of both rows' norms from there (`rest` with
    the term, `beyond` without). So a pair that meets first where the product of the rests is below `least` is not close: only
    terms with a rest of `least` or more are joined. What a pair's meetings add up to, with the product of the norms beyond
    the last of them, bounds its cosine. The pairs left are summed over all their terms, first roughly and then exactly, by blocks
    of rows."""
    weights = staged(weights.select("content_id", "term", "weight"), "weights")
    ranked = weights.join(weights.groupBy("term").agg(F.count("*").alias("df")), "term")
    later = Window.partitionBy("content_id").orderBy("df", "term")
    norm = lambda first: F.sqrt(F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(later.rowsBetween(first, Window.unboundedFollowing)), F.lit(0.0)))
    prefix = ranked.select("content_id", "term", "weight", norm(0).alias("rest"), norm(1).alias("beyond")).filter(F.col("rest") >= least - 1e-9)
    prefix = staged(prefix, "prefix")
    side = lambda name: prefix.select("term", F.col("content_id").alias(name), *[F.col(c).alias(c + name) for c in ("weight", "rest", "beyond")])
    met = side("a").join(side("b"), "term").filter("a < b").filter(F.col("resta") * F.col("restb") >= least - 1e-9)
    met = met.select("a", "b", (F.col("weighta") * F.col("weightb")).alias("part"), (F.col("beyonda") * F.col("beyondb")).alias("left"))
    bound = met.groupBy("a", "b").agg((F.sum("part") + F.min("left")).alias("bound"))
    pairs = staged(bound.filter(F.col("bound") >= least - 1e-9).select("a", "b"), "pairs")
    near = staged(_summed(weights, pairs, _rough_sums, ROUGH).filter(F.col("sim") >= least - 1e-4).select("a", "b"), "near")
    return _summed(weights, near, _exact_sums, EXACT).filter(F.col("sim") >= least)


#: Terms of a block of rows in the two passes of _summed(), about; places of terms in the first.
ROUGH, EXACT, PLACES = 1 << 22, 1 << 16, 1 << 22


def _summed(weights: DataFrame, pairs: DataFrame, sums: Callable[[pa.Table, pa.Table], pa.Table], size: int) -> DataFrame:
    """pairs (a, b; a < b) with `sim`, what sums() makes of them and of the rows (id, t, w: terms, weights) that are
    theirs. Rows are dealt to blocks of about `size` terms, those of an anchor (the smallest partner) to one
    block or to neighbours; a row goes once to each two blocks that have a pair of it, not once to each pair."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("anchor")), F.struct(F.col("b").alias("id"), F.col("a").alias("anchor")))).alias("x")).groupBy("x.id").agg(F.min("x.anchor").alias("anchor"))
    terms = weights.groupBy(F.col("content_id").alias("id")).agg(F.count("*").alias("n"))
    ends = staged(ends.join(terms, "id"), "ends")
    blocks = max(1, round((ends.agg(F.sum("n")).first()[0] or 0) / size))
    shares = ends.groupBy("anchor").agg(F.ceil(F.sum("n") / size).alias("shares"))
    block = F.pmod(F.xxhash64("anchor") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")), F.lit(blocks))
    dealt = staged(ends.join(shares, "anchor").select("id", block.alias("block")), "blocks")
    of = lambda name: dealt.select(F.col("id").alias(name), F.col("block").alias(f"block_{name}"))
    placed = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high"))
    placed = staged(placed, "placed")
    wanted = placed.select(F.col("low").alias("first"), F.col("high").alias("second"), F.explode(F.array("a", "b")).alias("id")).distinct()
    t = F.xxhash64("term")
    held = F.struct(t.alias("t"), F.col("weight").alias("w")) if sums is _exact_sums else F.struct(F.pmod(t, F.lit(PLACES)).cast("int").alias("t"), F.col("weight").cast("float").alias("w"))
    rows = weights.join(dealt.select(F.col("id").alias("content_id")), "content_id", "left_semi").groupBy(F.col("content_id").alias("id")).agg(F.sort_array(F.collect_list(held)).alias("v"))
    rows = rows.select("id", F.transform("v", lambda x: x.t).alias("t"), F.transform("v", lambda x: x.w).alias("w"))
    kind = dict(pairs.dtypes)["a"]
    return wanted.join(rows, "id").groupBy("first", "second").cogroup(placed.groupBy("low", "high")).applyInArrow(sums, f"a {kind}, b {kind}, sim double")


def _met(rows: pa.Table, pairs: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Terms and weights of rows, and the places in them of the rows of each pair."""
    ids = rows["id"].to_numpy()
    order = np.argsort(ids)
    t, w = ([x.values.to_numpy() for x in rows[c]] for c in ("t", "w"))
    a, b = (order[np.searchsorted(ids, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b"))
    return t, w, a, b


def _rough_sums(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums of products, by places of terms and in single precision: terms of one place count as one, which only adds."""
    t, w, a, b = _met(rows, pairs)
    out, dense, last = np.zeros(len(pairs)), np.zeros(PLACES, np.float32), -1
    for k in np.argsort(a, kind="stable"):
        if a[k] != last:
            if last >= 0:
                dense[t[last]] = 0
            last = a[k]
            np.add.at(dense, t[last], w[last])
        out[k] = dense[t[b[k]]] @ w[b[k]]
    return pa.table({"a": pairs["a"], "b": pairs["b"], "sim": out})


def _exact_sums(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums of products in double precision; terms are sorted by their 64-bit hashes."""
    t, w, a, b = _met(rows, pairs)
    out = np.zeros(len(pairs))
    for k, (i, j) in enumerate(zip(a, b, strict=True)):
        at = np.searchsorted(t[j], t[i])
        at[at == len(t[j])] = 0
        same = t[j][at] == t[i]
        out[k] = w[i][same] @ w[j][at[same]]
    return pa.table({"a": pairs["a"], "b": pairs["b"], "sim": out})


#: Contents up to which similarities are one matrix (8 MB here, and that much in each task); beyond, they are joined by term.
MOST_DENSE, CHUNK = 1024, 2048


def similarity_matrix(weights: DataFrame, n: int) -> DataFrame:
    """similarity() of the contents 0 to n - 1 (column `at`, n of MOST_DENSE at most) by matrix products: a task takes some
    terms with their contents and adds up one n x n product, so no row stands for a pair and a term."""
    if n > MOST_DENSE:
        raise ValueError("too many contents for a matrix; use similarity()")
    rows = weights.select("term", "at", "weight").repartition("term").sortWithinPartitions("term")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, left = np.zeros((n, n)), None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            term = whole["term"]
            new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy()])
            last = np.flatnonzero(new)[-1]
            left = whole.slice(last)  # the last term may go on in the next batch
            add(total, whole.slice(0, last), new[:last])
        if left is not None:
            add(total, left, np.arange(len(left)) == 0)
        a, b = np.nonzero(total)
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "sim"])

    def add(total: np.ndarray, part: pa.Table, new: np.ndarray) -> None:
        column, at, weight = np.cumsum(new) - 1, part["at"].to_numpy(), part["weight"].to_numpy()
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
            a, b = np.searchsorted(column, [first, first + CHUNK])
            dense = np.zeros((n, CHUNK))
            dense[at[a:b], column[a:b] - first] = weight[a:b]
            total += dense @ dense.T

    return rows.mapInArrow(multiply, "a int, b int, sim double").groupBy("a", "b").agg(F.sum("sim").alias("sim"))


def listed(items: DataFrame) -> DataFrame:
    """One row: `held`, the contents (content_id, needs) in order of id, for a catalog of MOST_LISTED contents at most."""
    row = staged(items.agg(F.sort_array(F.collect_list(F.struct("content_id", "needs"))).alias("held")), "catalog")
    if row.select(F.size("held")).first()[0] > MOST_LISTED:
        raise ValueError("too many contents for one list; use the scorers over a grid")
    return row


MOST_LISTED = 65_536


def popular_items(train: DataFrame, items: DataFrame) -> DataFrame:
    """items (content_id, needs) with score, the number of events in train: a ranking that all users share."""
    counts = train.groupBy(F.col("content_id").cast("int").alias("content_id")).agg(F.count("*").cast("double").alias("score"))
    return staged(items.join(counts, "content_id", "left").select("content_id", "needs", F.coalesce("score", F.lit(0.0)).alias("score")), "popular")


def random_rankings(users: DataFrame, items: DataFrame, k: int = 5, seed: int = 123) -> DataFrame:
    """users (seen, ...) with `ranking`: k unseen contents by pair_coin, score 1, then all others, score 0; ids ascend in both."""
    coin = lambda x: F.pmod(F.col("user_id") * 7919 + x.content_id * 104729 + seed * 31, F.lit(1000003))
    drawn = F.array_sort(F.transform(F.filter("held", lambda x: ~F.array_contains("seen", x.content_id)), lambda x: F.struct(coin(x).alias("coin"), x.content_id.alias("content_id"))))
    chosen = F.transform(F.slice(drawn, 1, k), lambda x: x.content_id)
    scored = lambda xs, score: F.transform(xs, lambda x: F.struct(F.lit(score).alias("score"), x.content_id.alias("content_id"), x.needs.alias("needs")))
    every = users.crossJoin(F.broadcast(listed(items))).withColumn("chosen", chosen)  # one row
    ones, rest = F.filter("held", lambda x: F.array_contains("chosen", x.content_id)), F.filter("held", lambda x: ~F.array_contains("chosen", x.content_id))
    return every.withColumn("ranking", F.concat(scored(ones, 1.0), scored(rest, 0.0))).drop("held", "chosen")


def _own_rankings(users: DataFrame, told: DataFrame, catalog: DataFrame, ids: np.ndarray, score: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """users with `ranking`: score() gives a row of scores (one a content of ids) for each row of told (user_id, ...)."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = score(part)
                order = [np.lexsort((ids, -r)) for r in rows]
                yield pa.record_batch([part.column(0), pa.array([o.astype(np.int32) for o in order], pa.list_(pa.int32())), pa.array([r[o] for r, o in zip(rows, order, strict=True)], pa.list_(pa.float64()))], ["user_id", "places", "scores"])

    own = told.mapInArrow(rank, "user_id long, places array<int>, scores array<double>")
    ranked = users.join(own, "user_id").crossJoin(F.broadcast(catalog))  # one row
    item = F.zip_with("places", "scores", lambda p, s: F.struct(s.alias("score"), F.get("held", p).content_id.alias("content_id"), F.get("held", p).needs.alias("needs")))
    return ranked.withColumn("ranking", item).drop("held", "places", "scores")


def tfidf_rankings(users: DataFrame, train: DataFrame, items: DataFrame, texts: DataFrame, relevance: float = 0.5) -> DataFrame:
    """users with `ranking` by the mean similarity to the contents that they liked. A user's similarities are summed as rows of
    the matrix, in Arrow batches."""
    catalog = listed(items)
    ids = np.array([x.content_id for x in catalog.first().held], np.int64)
    places = train.sparkSession.createDataFrame([(int(c), i) for i, c in enumerate(ids)], "content_id int, at int")
    found = similarity_matrix(tfidf(texts).join(F.broadcast(places), "content_id"), len(ids)).toArrow()
    sims = np.zeros((len(ids), len(ids)))
    sims[found["a"].to_numpy(), found["b"].to_numpy()] = found["sim"].to_numpy()
    liked = train.filter(F.col("score") >= relevance).join(F.broadcast(places), "content_id").groupBy("user_id").agg(F.collect_set("at").alias("liked"))
    told = users.select("user_id").join(liked, "user_id", "left").select("user_id", F.coalesce("liked", F.array().cast("array<int>")).alias("liked"))
    mean = lambda batch: np.round(np.stack([sims[x].sum(axis=0) / max(1, len(x)) for x in batch.column(1).to_pylist()]), 9)
    return _own_rankings(users, told, catalog, ids, mean)


def factor_rankings(users: DataFrame, people: DataFrame, model: DataFrame, items: DataFrame) -> DataFrame:
    """users with `ranking` by a factor model (people and model as factors.py has them); what it does not know adds nothing."""
    catalog = listed(items)
    ids = np.array([x.content_id for x in catalog.first().held], np.int64)
    known = {r.content_id: r for r in items.select("content_id").join(model, "content_id").collect()}
    width = max([len(r.factors) for r in known.values() if r.factors is not None] or [0])
    bias = np.array([known[c].bias if c in known else 0.0 for c in ids])
    own_of = np.array([known[c].factors if c in known and known[c].factors else [0.0] * width for c in ids]).reshape(len(ids), width)
    told = users.select("user_id").join(people, "user_id", "left").select("user_id", F.coalesce("bias", F.lit(0.0)).alias("bias"), F.coalesce("factors", F.array_repeat(F.lit(0.0), width)).alias("factors"))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        own = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        return batch.column(1).to_numpy(zero_copy_only=False)[:, None] + bias + own @ own_of.T

    return _own_rankings(users, told, catalog, ids, score)


def profile_rankings(users: DataFrame, words: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """users with `ranking` by the cosine of their text (words: user_id, text) with the contents'. Users of one text are scored
    once; a pair that shares no term has score 0."""
    catalog = listed(items)
    ids = np.array([x.content_id for x in catalog.first().held], np.int64)
    found = tfidf_profile(words.select("text", F.md5("text").alias("told")).distinct(), texts, key="told")
    rows = found.groupBy("told").agg(F.collect_list("content_id").alias("ids"), F.collect_list("score").alias("scores"))
    told = users.select("user_id").join(words.select("user_id", F.md5("text").alias("told")), "user_id", "left").join(rows, "told", "left").select("user_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.coalesce("scores", F.array().cast("array<double>")).alias("scores"))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(ids)))
        at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        out[at, np.searchsorted(ids, batch.column(1).flatten().to_numpy(zero_copy_only=False))] = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        return out

    return _own_rankings(users, told, catalog, ids, score)


def tfidf_scores(train: DataFrame, users: DataFrame, contents: DataFrame, texts: DataFrame, relevance: float = 0.5) -> DataFrame:
    """Mean similarity to the contents that the user liked; 0 without any. texts (content_id, text)."""
    liked = train.filter(F.col("score") >= relevance).select("user_id", F.col("content_id").alias("a")).distinct()
    n = liked.groupBy("user_id").agg(F.count("*").alias("n"))
    total = liked.join(similarity(tfidf(texts)), "a").groupBy("user_id", F.col("b").alias("content_id")).agg(F.sum("sim").alias("total"))
    mean = total.join(n, "user_id").select("user_id", "content_id", (F.col("total") / F.col("n")).alias("score"))
    return grid(users, contents).join(mean, ["user_id", "content_id"], "left").select("user_id", "content_id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def tfidf_profile(queries: DataFrame, texts: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """(key, content_id, score): cosine of query texts with contents in the contents' vocabulary; pairs without a shared
    term are absent (score 0)."""
    weights = tfidf(texts)
    vocabulary = weights.groupBy("term").agg(F.count("*").alias("df"))
    total = texts.agg(F.countDistinct("content_id").alias("n_docs"))
    terms = queries.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = terms.join(vocabulary, "term").crossJoin(total).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("q"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    return raw.join(weights, "term").groupBy(key, "content_id").agg(F.sum(F.col("q") * F.col("weight")).alias("dot")).join(norm, key).select(key, "content_id", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))


def _one_hot(frame: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """frame with `<prefix>_features`; a null is a category of its own, an unseen value is all zeros."""
    filled = frame.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("desconocido")).alias(f"{prefix}_{c}") for c in columns])
    names = [f"{prefix}_{c}" for c in columns]
    stages = [
        StringIndexer(inputCols=names, outputCols=[f"{n}_i" for n in names], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{n}_i" for n in names], outputCols=[f"{n}_v" for n in names], dropLast=True),
    ]
    stages.append(VectorAssembler(inputCols=[f"{prefix}_{c}_v" for c in columns], outputCol=f"{prefix}_features"))
    return Pipeline(stages=stages).fit(filled).transform(filled)


def _weighed(vector: Column, weights: np.ndarray) -> Column:
    """A vector of features times weights (one column: a number, more: an array), in Arrow batches."""
    array = vector_to_array(vector)
    flat = weights.ndim == 1

    @F.pandas_udf("double" if flat else "array<double>")
    def product(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        out = np.stack(rows.to_numpy()) @ weights
        return pd.Series(out if flat else list(out))

    return product(array)


def svd_ridge(train: DataFrame, users: DataFrame, contents: DataFrame, profile: list[str], features: list[str], rank: int = 10, alpha: float = 1.0, collaborative: bool = True) -> tuple[DataFrame, DataFrame]:
    """People and items (see factors.py) of a ridge regression on u.v (truncated SVD of the mean scores), one-hot profile and
    one-hot content features. collaborative False (new users): u.v is 0 in the prediction."""
    cells = train.groupBy("user_id", "content_id").agg(F.avg("score").alias("s"))
    left, right, _ = factors.truncated_svd(cells, min(rank, contents.count() - 1))
    people = _one_hot(users, profile, "p").select("user_id", "p_features")
    items = _one_hot(contents, features, "c").select("content_id", "c_features").join(right, "content_id", "left")
    dot = F.coalesce(F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))
    assemble = VectorAssembler(inputCols=["uv", "p_features", "c_features"], outputCol="features")
    known = train.select("user_id", "content_id", "score").join(left, "user_id", "left").join(people, "user_id").join(items, "content_id").withColumn("uv", dot)
    data = staged(assemble.transform(known).select("features", F.col("score").alias("label")), "ridge")
    n, dev = data.agg(F.count("*"), F.stddev_pop("label")).first()
    # Spark divides the penalty by the deviation of the label and by n
    model = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha / n * dev).fit(data)
    w, width = model.coefficients.toArray(), people.first().p_features.size
    own = F.transform("u", lambda x: x * float(w[0])) if collaborative else F.lit(None).cast("array<double>")
    told = people.join(left, "user_id", "left").select("user_id", (_weighed(F.col("p_features"), w[1 : 1 + width]) + model.intercept).alias("bias"), own.alias("factors"))
    return told, items.select("content_id", _weighed(F.col("c_features"), w[1 + width :]).alias("bias"), F.col("v").alias("factors"))


def profile_machine(train: DataFrame, users: DataFrame, contents: DataFrame, profile: list[str], size: int = 8, seed: int = 456) -> tuple[DataFrame, DataFrame]:
    """People and items of a factorisation machine on profile and content one-hots, for users without events: what the
    features of one side do among themselves is a bias, and its sum of factors meets the other side's."""
    people = _one_hot(users, profile, "p").select("user_id", "p_features")
    items = _one_hot(contents, ["content_id"], "c").select("content_id", "c_features")
    assemble = VectorAssembler(inputCols=["p_features", "c_features"], outputCol="features")
    data = staged(assemble.transform(train.join(people, "user_id").join(items, "content_id")).select("features", F.col("score").alias("label")), "machine")
    model = FMRegressor(factorSize=size, solver="adamW", stepSize=0.01, regParam=1e-4, maxIter=15, seed=seed).fit(data)
    linear, v, cut = model.linear.toArray(), model.factors.toArray(), people.first().p_features.size

    def side(frame: DataFrame, key: str, name: str, w: np.ndarray, v: np.ndarray, base: float) -> DataFrame:
        # features are 0 or 1: pairs among them are half of the squared sum less the squares
        both = frame.select(key, _weighed(F.col(name), np.column_stack([w - 0.5 * (v * v).sum(axis=1), v])).alias("x"))
        own = F.slice("x", 2, size)
        return both.select(key, (F.col("x")[0] + base + 0.5 * F.aggregate(own, F.lit(0.0), lambda a, b: a + b * b)).alias("bias"), own.alias("factors"))

    return side(people, "user_id", "p_features", linear[:cut], v[:cut], model.intercept), side(items, "content_id", "c_features", linear[cut:], v[cut:], 0.0)
