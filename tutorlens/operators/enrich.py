"""Enrichment records: requests, lenient JSON, validation, resumption, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import staged

QUIZ = "array<struct<question:string,options:array<string>,correct_index:int,explanation:string,concept_id:string>>"
RECORD = f"struct<tldr:string,key_points:array<string>,quiz:{QUIZ}>"
# Request limits (text, headings, glossary entries, definition).
TEXT_LIMIT, HEADINGS, ENTRIES, DEFINITION = 30_000, 20, 40, 200


def cut_text(text: Column, n: int = TEXT_LIMIT) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n[...]"))).otherwise(text)


def glossary_lines(blocks: Column) -> Column:
    """Lines of the glossary blocks' first ENTRIES entries that have a term, definitions cut; blocks array<struct<type,
    entries array<struct<term,definition>>>>."""
    entries = F.slice(F.flatten(F.transform(F.filter(blocks, lambda b: b["type"] == "glossary"), lambda b: b["entries"])), 1, ENTRIES)
    named = F.filter(entries, lambda e: F.coalesce(e["term"] != "", F.lit(False)))
    return F.array_join(F.transform(named, lambda e: F.concat(F.lit("- "), e["term"], F.lit(": "), F.substring(F.coalesce(e["definition"], F.lit("")), 1, DEFINITION))), "\n")


def requests(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(content_id, prompt) of docs (content_id, title, topic, subtopic, difficulty, learning_objective, headings, blocks,
    text); a null field is left empty. The concept list is one row."""
    known = concepts.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s (%s)", F.col("concept_id").cast("string"), "concept_name"))), "; ").alias("known"))
    field = lambda name, *cols: F.concat(F.lit(f"- {name}: "), F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    bullets = F.array_join(F.transform(F.slice(F.coalesce("headings", F.array().cast("array<string>")), 1, HEADINGS), lambda h: F.concat(F.lit("- "), h)), "\n")
    terms = F.coalesce(glossary_lines(F.col("blocks")), F.lit(""))
    parts = [
        field("Title", "title"), field("Topic", "topic", "subtopic"), field("Difficulty", "difficulty"), field("Objective", "learning_objective"), F.concat(F.lit("Concepts: "), F.col("known")),
        F.when(terms != "", F.concat(F.lit("Glossary:\n"), terms)), F.lit("Headings:"), F.when(bullets == "", "(none)").otherwise(bullets), F.lit("Text:"), F.coalesce(cut_text(F.col("text")), F.lit("")),
    ]
    return docs.crossJoin(known).select("content_id", F.concat_ws("\n", *parts).alias("prompt"))


def json_part(response: Column) -> Column:
    """The object of a fenced or noisy response."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).otherwise(loose)


def checked(responses: DataFrame, concepts: DataFrame) -> DataFrame:
    """(content_id, response, ok, errors, data, corrupt) of responses (content_id, response); any error rejects the record, a
    concept that is unknown becomes null, corrupt is an object that is no JSON of the record. concepts: a few names, gathered
    to one row."""
    known = concepts.agg(F.collect_set(F.col("concept_id").cast("string")).alias("known"))
    kind = f"{RECORD[:-1]},_corrupt_record:string>"
    told = F.from_json(json_part(F.col("response")), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = responses.withColumn("told", told).withColumn("r", F.when(F.col("told._corrupt_record").isNull(), F.col("told"))).crossJoin(known)
    quiz = F.col("r.quiz")
    bad = lambda test: F.coalesce(F.exists(quiz, test), F.lit(False))
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    rules = [
        ("no json", F.col("r").isNull() | (F.col("r.tldr").isNull() & quiz.isNull())),
        ("tldr", F.coalesce(F.length(F.trim("r.tldr")) < 20, F.lit(True))),
        ("key_points", ~F.coalesce(F.size("r.key_points").between(2, 6), F.lit(False))),
        ("quiz", F.coalesce(F.size(quiz), F.lit(0)) < 1),
        ("options", bad(lambda q: ~F.coalesce(F.size(q["options"]).between(2, 6), F.lit(False)))),
        ("correct_index", bad(lambda q: F.coalesce((q["correct_index"] < 0) | (q["correct_index"] >= F.size(q["options"])), F.lit(True)))),
        ("question", bad(lambda q: blank(q["question"]))),
        ("explanation", bad(lambda q: blank(q["explanation"]))),
    ]
    errors = F.array_compact(F.array(*[F.when(hit, name) for name, hit in rules]))
    question = lambda q: F.struct(
        F.trim(q["question"]).alias("question"), F.transform(q["options"], lambda o: F.trim(o)).alias("options"), q["correct_index"].alias("correct_index"),
        F.trim(q["explanation"]).alias("explanation"), F.when(F.array_contains("known", q["concept_id"]), q["concept_id"]).alias("concept_id"),
    )
    clean = F.struct(F.col("r.tldr").alias("tldr"), F.filter(F.transform("r.key_points", lambda p: F.trim(p)), lambda p: p != "").alias("key_points"), F.transform(quiz, question).alias("quiz"))
    return parsed.select("content_id", "response", (F.size(errors) == 0).alias("ok"), errors.alias("errors"), F.when(F.size(errors) == 0, clean).alias("data"), F.col("told._corrupt_record").alias("corrupt"))


def validate(responses: DataFrame, concepts: DataFrame) -> DataFrame:
    """(content_id, ok, errors, data): checked() without the raw texts."""
    return checked(responses, concepts).select("content_id", "ok", "errors", "data")


def quarantine(rows: DataFrame) -> DataFrame:
    """(content_id, reason, _corrupt_record) of the rejected rows of checked(), each once, with the response as it came. reason:
    no response, no object (nothing between braces), broken json (not of the record's kinds), or the rules it breaks."""
    reason = F.when(F.col("response").isNull(), "no response").when(json_part(F.col("response")) == "", "no object").when(F.col("corrupt").isNotNull(), "broken json").otherwise(F.array_join("errors", ","))
    return rows.filter("not ok").select("content_id", reason.alias("reason"), F.col("response").alias("_corrupt_record"))


def write_checked(responses: DataFrame, concepts: DataFrame, path: str) -> None:
    """Good records as JSON lines below path/records, all others below path/quarantine. Responses are read and checked once."""
    rows = staged(checked(responses, concepts), "checked")
    rows.filter("ok").select("content_id", "data.*").write.json(f"{path}/records")
    quarantine(rows).write.json(f"{path}/quarantine")


def outcome(validated: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: records ok, with errors and skipped (already done)."""
    n = validated.agg(F.count_if("ok").alias("n_ok"), F.count_if(F.expr("not ok")).alias("n_error"), F.count("*").alias("n_all"))
    return n.withColumn("n_skipped", F.lit(0).cast("long")) if skipped is None else n.crossJoin(skipped.agg(F.count("*").alias("n_skipped")))


def error_list(validated: DataFrame) -> DataFrame:
    """(error, n): records by error, one row an error."""
    return validated.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def quiz_by_concept(validated: DataFrame) -> DataFrame:
    return validated.filter("ok").select(F.explode("data.quiz").alias("q")).groupBy("q.concept_id").agg(F.count("*").alias("n_questions"))


def work_list(docs: DataFrame, done: DataFrame, pilot: str | None = None, limit: int | None = None) -> DataFrame:
    """docs still to do: of the pilot ids (comma list, any case) if given, not done, the first `limit` by id."""
    out = docs.join(done.select("content_id"), "content_id", "left_anti")
    if pilot:
        out = out.filter(F.upper("content_id").isin([x.strip().upper() for x in pilot.split(",")]))
    return out.orderBy("content_id").limit(limit) if limit else out


def usage(records: DataFrame) -> DataFrame:
    """Totals over records with elapsed_ms, input_tokens, output_tokens."""
    return records.agg(F.count("*").alias("calls"), F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"), F.median("elapsed_ms").alias("median_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
