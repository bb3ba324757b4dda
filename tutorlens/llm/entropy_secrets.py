"""Secret scan: known shapes, then sliding-window entropy over candidate strings. DataFrame functions only.

Known shapes are `assign`, `access` and `hex` (see KINDS). The method adds `entropy` spans: candidate strings (runs of
key characters with a letter and a digit) are read by a window; as it moves one character, the counts of the character
that comes and of the one that goes change by one, and with them the sum of c*log2(c) from which the window's Shannon
entropy follows. A candidate whose highest window entropy reaches the limit of its character class is reported, unless
the allow list knows it or a known shape covers part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The shapes of the contract, in its order: kind, pattern, group that must be long, least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
#: Marks put around matches; the same characters in a text are first exchanged for another non-character.
MARK, OTHER = "﷐", "﷑"
#: Candidate strings, window width, and the entropy (bits a character) that a class must reach within a window.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
CLASS_LIMITS = {"hex": 3.0, "lower": 3.6, "mixed": 3.8}
#: The characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Strings that look random but are known to be harmless (placeholders, alphabets, identifiers).
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx|abcdefgh|01234567|12345678|qwerty|"
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}|^/?[a-z]+(?:[/_-][a-z0-9]{1,12})+$"
)

SPAN = "array<struct<start:int,end:int,text:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order, as structs (start, end, text) in code points, end exclusive. text must
    hold no MARK."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    walked = F.aggregate(
        F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i % 2 == 1).alias("hit"))),
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["x"])).alias("at"),
            F.when(p["hit"], F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["x"])).alias("end"), p["x"].alias("text"))))).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(F.size(parts) > 1, walked).otherwise(F.array().cast(SPAN))


def highest_entropy(s: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of a window of width characters of s; s is at least width long and of ALPHABET.
    A fold over the characters keeps the counts of the window (an array by character): the one that goes is taken off,
    the one that comes is added, and the sum of c*log2(c) follows. The work of a step does not depend on s."""
    part = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    slots = len(ALPHABET) + 1  # the first is for what goes while the first window fills
    count = lambda counts, at: F.element_at(counts, at + 1)

    def put(counts: Column, at: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at), F.array(value), F.slice(counts, at + 2, slots - 1 - at))

    come = F.transform(F.split(s, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    go = F.slice(F.concat(F.array_repeat(F.lit(0), width), come), F.lit(1), F.length(s))
    both = F.zip_with(come, go, lambda a, b: a * 100 + b)

    def move(acc: Column, x: Column) -> Column:
        comes, goes = F.floor(x / 100).cast("int"), x % 100
        gone = count(acc["counts"], goes)

        def enter(counts: Column) -> Column:
            there = count(counts, comes)
            total = acc["total"] - F.when(goes > 0, part(gone) - part(gone - 1)).otherwise(F.lit(0.0)) + part(there + 1) - part(there)
            least = F.when(acc["n"] >= width - 1, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(put(counts, comes, there + 1).alias("counts"), total.alias("total"), least.alias("least"), (acc["n"] + 1).alias("n"))

        # the array of one keeps the counts without the one that goes from being made again for each use
        return F.transform(F.array(put(acc["counts"], goes, gone - 1)), enter)[0]

    start = F.struct(F.array_repeat(F.lit(0.0), slots).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"), F.lit(0).alias("n"))
    return F.aggregate(both, start, move, lambda acc: F.log2(F.lit(float(width))) - acc["least"] / float(width))


def entropy_limit(s: Column) -> Column:
    """The limit of the narrowest character class that holds s."""
    lower = s.rlike(r"^(?:[a-z0-9/_=+-]+|[A-Z0-9/_=+-]+)$")
    return F.when(s.rlike(r"^[0-9a-fA-F]+$"), CLASS_LIMITS["hex"]).when(lower, CLASS_LIMITS["lower"]).otherwise(CLASS_LIMITS["mixed"])


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of docs (doc_id, text), a row a row: found are all spans as structs (start, order, kind, end,
    text) by start, then kind. Null and empty texts have none."""
    marked = docs.select("doc_id", F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, OTHER).alias("sc_text"))
    text, none = F.col("sc_text"), F.array().cast(SPAN)

    def long_enough(kind: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(matches(text, pattern), lambda m: F.length(F.regexp_extract(m["text"], pattern, group)) >= least)
        return F.when(text.rlike(pattern), kept).otherwise(none).alias(f"sc_{kind}")

    likely = F.filter(matches(text, CANDIDATE), lambda m: m["text"].rlike("[0-9]") & m["text"].rlike("[A-Za-z]") & ~m["text"].rlike(ALLOWED))
    base = marked.select("doc_id", *[long_enough(*_quick(k)) for k in KINDS], F.when(text.rlike(CANDIDATE), likely).otherwise(none).alias("sc_candidates"))
    known = base.withColumn("sc_known", F.concat(*[f"sc_{k}" for k, *_ in KINDS]))
    free = F.filter("sc_candidates", lambda m: ~F.exists("sc_known", lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])))
    added = F.filter(free, lambda m: highest_entropy(m["text"]) >= entropy_limit(m["text"]))
    found = known.withColumn("sc_entropy", added)

    def labelled(order: int, kind: str) -> Column:
        return F.transform(f"sc_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["text"].alias("text")))

    spans = [labelled(i, k) for i, k in enumerate([*[x[0] for x in KINDS], "entropy"])]
    return found.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def _quick(kind: tuple) -> tuple:
    """Runs of one class are matched only from the least length on: the same spans, found faster."""
    name, pattern, group, least = kind
    return (name, {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}.get(name, pattern), group, least)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy), a row a row of documents. Null and empty texts
    have no spans and the hash of nothing; an empty table gives no rows."""
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda m: m["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k, *_ in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), count("entropy"))
