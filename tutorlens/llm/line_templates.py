"""Line dedup by a log-template tree. DataFrame functions only.

A line's words with digits, addresses or links are variable from the start. The tree has a fixed depth: the number of
words, then the first LEADING words; a leaf holds the lines that agree on these. Within a leaf a word is constant at its
place if MIN_DOCS documents have it there and they are at least LEAST_SHARE of those that have the line's common words:
the number of documents that LEAST_CONSTANT of the line's words reach. So the same template has the same constants in
few documents and in many, also beside larger templates in its leaf. Every other word is a variable field, and lines with the same constants are
of one template. A template that MIN_DOCS documents share is dropped everywhere but at its first place (smallest doc_id,
then line), so copies of a document lose their lines and one stays whole. Lines with few constants (below LEAST_CONSTANT)
are not generalised. Lines of two words up to LEADING are a leaf of their own, and keep their digits, addresses and links
where these leave few constants; those without a letter and lines of one word are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LEADING, MIN_DOCS, LEAST_CONSTANT, LEAST_SHARE = 3, 3, 0.6, 0.5
VARIABLE = "<*>"


#: A word with a digit, an at sign or a link, from its first character on.
CHANGING = r"(?<![^ ])(?:[^ 0-9@:]|:(?!//))*+(?:[0-9@]|://)[^ ]*"

#: Lines of at most LEADING words; those whose masked form has fewer constants than LEAST_CONSTANT.
SHORT, SHORT_VARIABLE = r"^[^ ]*(?: [^ ]*){0,2}$", r"^(?:[^ ]+ )?<\*>$|^<\*> [^ ]+$|^<\*> <\*> [^ ]+$|^<\*> [^ ]+ <\*>$|^[^ ]+ <\*> <\*>$"


def _lines(docs: DataFrame) -> DataFrame:
    """(lt_doc, lt_row, lt_pos, lt_masked, lt_leaf, lt_key) of lines of two words or more. What needs a
    pattern is done inside the generator, once a line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    spaced = F.when(odd, F.regexp_replace(text, r"[\x20\t\x0B\f\r]+", " ")).otherwise(text)
    mask = lambda x: F.regexp_replace(x, CHANGING, VARIABLE)
    masked = F.transform(
        F.transform(F.split(spaced, "\n", -1), lambda x: F.trim(x)),
        lambda x: F.when(~x.rlike("[0-9@]|://"), x).when(x.rlike(SHORT) & mask(x).rlike(SHORT_VARIABLE), x).otherwise(mask(x)),
    )
    read = docs.select("doc_id", "text").select(F.col("doc_id").alias("lt_doc"), row_key().alias("lt_row"), F.posexplode(masked).alias("lt_pos", "lt_masked"))
    start = F.substring_index("lt_masked", " ", LEADING)
    n_spaces = F.length("lt_masked") - F.length(F.replace("lt_masked", F.lit(" "), F.lit("")))
    return read.filter((start != F.col("lt_masked")) | (F.col("lt_masked").contains(" ") & F.col("lt_masked").rlike(r"\p{L}"))).select(
        "lt_doc", "lt_row", "lt_pos", "lt_masked", F.xxhash64(n_spaces, start).alias("lt_leaf"), F.unhex(F.md5("lt_masked")).alias("lt_key")
    )


def row_key() -> Column:
    """Tells apart rows that share a doc_id; rows that are equal in both count as one document and fare alike."""
    return F.xxhash64("doc_id", "text")


def _documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, lt_docs): in how many documents each key stands, if in MIN_DOCS; counted in two steps, so that a key that
    most documents have is summed before it moves."""
    once = rows.groupBy(key, "lt_doc", "lt_row").agg(F.lit(1).alias("one"))
    return once.groupBy(key).agg(F.count("one").alias("lt_docs")).filter(F.col("lt_docs") >= MIN_DOCS)


def templates(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(lt_key, lt_template) of lines whose template recurs; keys: _lines(docs) without the text."""
    exact = staged(_documents(keys, "lt_key"), "op8-exact").select("lt_key")
    others = staged(keys.join(exact, "lt_key", "left_anti").select("lt_leaf", "lt_key", "lt_doc", "lt_row"), "op8-others")
    leaves = _documents(others, "lt_leaf").select("lt_leaf")
    # leaves with one key left cannot be generalised further than that key
    wide = others.join(leaves, "lt_leaf", "left_semi").groupBy("lt_leaf").agg(F.min("lt_key").alias("a"), F.max("lt_key").alias("b")).filter("a <> b").select("lt_leaf")
    texts = _lines(docs).select("lt_leaf", "lt_key", "lt_masked", "lt_row").join(staged(wide, "op8-leaves"), "lt_leaf", "left_semi").join(exact, "lt_key", "left_anti")
    distinct = staged(texts.groupBy("lt_leaf", "lt_key").agg(F.first("lt_masked").alias("lt_masked"), F.collect_set("lt_row").alias("lt_rows")), "op8-texts")
    tokens = distinct.select("lt_leaf", "lt_key", "lt_rows", F.posexplode(F.split("lt_masked", " ", -1)).alias("lt_place", "lt_word"))
    # texts left here stand in fewer than MIN_DOCS documents each; a document counts once, however many lines have the word
    once = tokens.filter(F.col("lt_word") != VARIABLE).select("lt_leaf", "lt_place", "lt_word", F.explode("lt_rows").alias("lt_row")).distinct()
    constant = once.groupBy("lt_leaf", "lt_place", "lt_word").agg(F.count("*").alias("seen")).filter(F.col("seen") >= MIN_DOCS)
    marked = tokens.drop("lt_rows").join(constant, ["lt_leaf", "lt_place", "lt_word"], "left")
    word = F.struct("lt_place", F.col("lt_word").alias("word"), F.coalesce("seen", F.lit(0)).alias("seen"))
    common = F.element_at(F.sort_array("words.seen", False), F.ceil(LEAST_CONSTANT * F.size("words")).cast("int"))
    fields = F.transform("words", lambda w: F.when((w["seen"] > 0) & (w["seen"] >= LEAST_SHARE * F.col("common")), w["word"]).otherwise(F.lit(VARIABLE)))
    general = (
        marked.groupBy("lt_leaf", "lt_key").agg(F.sort_array(F.collect_list(word)).alias("words"))
        .withColumn("common", common).filter("common > 0")
        .select("lt_key", F.unhex(F.md5(F.concat_ws(" ", F.col("lt_leaf").cast("string"), F.array_join(fields, " ")))).alias("lt_template"))
    )
    general = staged(general, "op8-general")
    recurring = _documents(others.join(general, "lt_key"), "lt_template").select("lt_template")
    return exact.select("lt_key", F.col("lt_key").alias("lt_template")).unionByName(general.join(recurring, "lt_template", "left_semi").select("lt_key", "lt_template"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(lt_doc, lt_row, lt_drop): per document the places (from 0) of lines to drop; documents without any are absent."""
    keys = staged(_lines(docs).drop("lt_masked"), "op8-keys")
    hits = staged(keys.join(templates(docs, keys), "lt_key").select("lt_template", "lt_doc", "lt_row", "lt_pos"), "op8-hits")
    # a place belongs to one template, so first places are taken out by place: no join on a template that all have
    first = hits.groupBy("lt_template").agg(F.min(F.struct("lt_doc", "lt_row", "lt_pos")).alias("f")).select(F.col("f.lt_doc").alias("f_doc"), F.col("f.lt_row").alias("f_row"), F.col("f.lt_pos").alias("f_pos"))
    same = F.col("lt_doc").eqNullSafe(F.col("f_doc")) & (F.col("lt_row") == F.col("f_row")) & (F.col("lt_pos") == F.col("f_pos"))
    return hits.join(first, same, "left_anti").groupBy("lt_doc", "lt_row").agg(F.sort_array(F.collect_set("lt_pos")).alias("lt_drop"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns but lt_...) with `lt_n` lines, `lt_drop` places dropped (empty array if
    none) and the remaining text; every row stays, a null text stays null. Equal rows fare alike."""
    drops = staged(dropped_lines(docs), "op8-drops").toDF("lt_d", "lt_r", "lt_drop")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("lt_d")) & (row_key() == F.col("lt_r")), "left").drop("lt_d", "lt_r")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lt_drop", i)), "\n")
    return joined.withColumns({"lt_n": F.coalesce(F.size(lines), F.lit(0)), "text": F.when(F.col("lt_drop").isNull(), F.col("text")).otherwise(kept), "lt_drop": F.coalesce("lt_drop", F.array().cast("array<int>"))})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, text), a row a row of documents: places of the lines dropped and the text left.
    The first place of a recurring template stays, for lines that recur only because whole documents were copied would
    else go from every copy and no whole document would be left. A null text stays null with no line, an empty one has
    one empty line; rows equal in id and text fare alike; an empty table gives no rows."""
    out = without_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lt_n").cast("long").alias("n_lines"), F.size("lt_drop").cast("long").alias("n_dropped"), F.array_join("lt_drop", ",").alias("dropped"), "text")
