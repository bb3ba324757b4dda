"""Page jobs: urls, text, headings, links, videos, sections, blocks and records of a pages (url, html) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extraction_class, host, is_pdf_body, is_pdf_url, normal, plain, titles_match
from ..sources.files import staged
from .html import parsed


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, heading) in document order, repeated texts dropped."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("pos", "tag")).select("page_id", "pos", F.regexp_extract("tag", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), plain(F.col("tag")).alias("heading"))
    first = Window.partitionBy("page_id", F.lower("heading")).orderBy("pos")
    return each.filter("heading <> ''").withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def links(pages: DataFrame, main_only: bool = True) -> DataFrame:
    """(page_id, pos, label, href): absolute links with a label of 3 characters or more, each target once, from the main
    container (html.py; none without one) or, without main_only, the whole page. Anchors of the page itself are left out. A
    short label without end punctuation is a call to action: the last h1 to h4 opened before it tells what it leads to."""
    kept = lambda x: (~x.raw.rlike(r"^(#|mailto:|javascript:|$)")) & (F.length(x.label) >= 3) & (x.main | F.lit(not main_only))
    path = lambda u: F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    own = lambda x: x.href.rlike("#.") & (path(x.href) == path(F.coalesce("url", F.lit(""))))
    call = lambda x: (F.length(x.label) < 25) & ~x.label.rlike("[.?!:]$") & (F.coalesce(F.length(x.heading), F.lit(0)) >= 3)
    wanted = parsed(pages).select("page_id", "url", F.col("parts.links").alias("found")).select("page_id", F.filter("found", lambda x: kept(x) & ~own(x)).alias("found"))
    once = F.filter("found", lambda x, i: F.array_position(F.transform("found", lambda y: y.href), x.href) == i + 1)
    return wanted.select("page_id", F.posexplode(once).alias("pos", "x")).select("page_id", "pos", F.when(call(F.col("x")), F.col("x.heading")).otherwise(F.col("x.label")).alias("label"), "x.href")


VIDEO = "array<struct<url:string,platform:string>>"


def video_info(parts: Column) -> Column:
    """struct(has_video, video_urls, platforms, schema_type) of parsed pages: video and source tags, frames (those of unknown
    hosts without a platform), data-video ids, VideoObjects. A url counts once, as what it was first."""
    told = lambda url, platform: F.struct(F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url).alias("url"), platform.alias("platform"))
    host_of = lambda u: F.when(F.lower(u).rlike(r"youtube\.com|youtube-nocookie\.com|youtu\.be"), "youtube").when(F.lower(u).contains("vimeo.com"), "vimeo").when(F.lower(u).contains("wistia"), "wistia")
    direct = lambda urls: F.transform(urls, lambda u: told(u, F.lit("direct")))
    frames = F.transform(parts["frames"], lambda u: told(u, host_of(u)))
    ids = F.transform(parts["data_ids"], lambda v: told(F.concat(F.lit("https://www.youtube.com/embed/"), v), F.lit("youtube")))
    objects = video_objects(parts["scripts"])
    named = F.flatten(F.transform(objects, lambda o: F.array(told(o.content, F.lit("direct")), told(o.embed, F.lit(None).cast("string")))))
    every = F.filter(F.concat(*[x.cast(VIDEO) for x in (direct(parts["media"]), frames, ids, named)]), lambda x: x.url.isNotNull())
    # the first of each url, in a let: every is used for the look-back and for the walk
    once = F.flatten(F.transform(F.array(every), lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y.url), x.url) == i + 1)))
    schema = F.when(F.size(objects) > 0, "VideoObject")
    urls, platforms = F.transform(once, lambda x: x.url), F.array_sort(F.array_distinct(F.filter(F.transform(once, lambda x: x.platform), lambda p: p.isNotNull())))
    return F.struct(((F.size(once) > 0) | schema.isNotNull()).alias("has_video"), urls.alias("video_urls"), platforms.alias("platforms"), schema.alias("schema_type"))


def video_objects(scripts: Column) -> Column:
    """array<struct<content, embed>>: one a VideoObject (a type, or one of a list of types) in JSON-LD scripts, each an object
    or a list of them, read as variant values; content is contentUrl or else url. Scripts that are no JSON give nothing."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    filled = lambda v, name: F.nullif(get(v, f"$.{name}", "string"), F.lit(""))
    items = lambda s: F.coalesce(get(F.try_parse_json(s), "$", "array<variant>"), F.array(F.try_parse_json(s)))
    is_video = lambda v: F.coalesce(F.array_contains(get(v, "$['@type']", "array<string>"), "VideoObject"), get(v, "$['@type']", "string") == "VideoObject", F.lit(False))
    each = F.transform(scripts, lambda s: F.transform(items(s), lambda v: F.when(is_video(v), F.struct(F.coalesce(filled(v, "contentUrl"), filled(v, "url")).alias("content"), filled(v, "embedUrl").alias("embed")))))
    return F.filter(F.flatten(each), lambda o: o.isNotNull())


def canonical_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""))


def fan_out(pages: DataFrame) -> DataFrame:
    """(page_id, deduped_from): pages that share a canonical url, with the first of them (null for itself)."""
    keyed = pages.select("page_id", canonical_url(F.col("url")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"))
    return keyed.join(first, "key").select("page_id", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("deduped_from"))


def sections(docs: DataFrame) -> DataFrame:
    """docs (page_id, text, headings array) -> (page_id, heading, start, end, found): each heading is sought after the one
    before, in any case, with any blanks between its words and either form of quotes; places are those of the text itself. It
    ends at the next found start or the end of the text. Blank headings are nowhere."""
    straight = lambda c: F.translate(c, "“”’‘", "\"\"''")
    quoted = lambda h: F.replace(F.replace(F.trim(F.regexp_replace(straight(h), r"\s+", " ")), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E\\s+\\Q"))
    pattern = lambda h: F.concat(F.lit("(?iu)\\Q"), quoted(h), F.lit("\\E"))

    def found(h: Column, start: Column) -> Column:
        """(at, length) of the heading from a place on, both counted from 1; at 0: nowhere."""
        rest = F.substring(straight(F.col("text")), start, F.length("text"))
        at = F.when(F.trim(h) == "", 0).otherwise(F.regexp_instr(rest, pattern(h)))
        return F.struct(F.when(at > 0, at + start - 1).otherwise(0).alias("at"), F.coalesce(F.length(F.regexp_substr(rest, pattern(h))), F.lit(0)).alias("length"))

    def next_one(acc: Column, h: Column) -> Column:
        return F.element_at(F.transform(F.array(found(h, acc["at"])), lambda f: F.struct(  # the match is found once
            F.when(f["at"] > 0, f["at"] + f["length"]).otherwise(acc["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(h.alias("heading"), (f["at"] - 1).alias("start"), (f["at"] > 0).alias("found")))).alias("out"),
        )), 1)

    step = F.aggregate("headings", F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<heading:string,start:int,found:boolean>>").alias("out")), next_one, lambda acc: acc["out"])
    each = docs.select("page_id", F.length("text").alias("n"), F.posexplode(step).alias("pos", "s")).select("page_id", "n", "pos", "s.*")
    later = Window.partitionBy("page_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(F.first(F.when(F.col("found"), F.col("start")), ignorenulls=True).over(later), F.col("n"))
    return each.select("page_id", "pos", "heading", F.when(F.col("found"), F.col("start")).alias("start"), F.when(F.col("found"), end).alias("end"), "found")


ITEM, NUMBER = r"^\s*[-•·]\s+", r"^\s*\d+[.)]\s+"
ENTRY = "array<struct<term:string,definition:string>>"


def headings_at(lines: Column, heads: Column) -> Column:
    """For each line the place of the heading that it is, or -1: headings (array of texts) are met in their order."""
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, line: Column) -> Column:
        hit = F.coalesce(normal(line) == normal(F.get(heads, acc["k"])), F.lit(False)) & (F.trim(line) != "")
        return F.struct((acc["k"] + hit.cast("int")).alias("k"), F.concat(acc["at"], F.array(F.when(hit, acc["k"]).otherwise(-1))).alias("at"))

    return F.aggregate(lines, start, step, lambda acc: acc["at"])


def glossary_entries(items: Column) -> Column:
    """Pairs of term and definition: an item that looks like a term (60 characters and 8 words at most, no closing point)
    takes the next one as its definition; others are definitions without a term."""
    short = lambda t: (t != "") & (F.length(t) <= 60) & ~t.rlike("[.,;]$") & (F.size(F.split(t, r"\s+")) <= 8)
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("term"), F.array().cast(ENTRY).alias("out"))

    def step(acc: Column, item: Column) -> Column:
        t = F.trim(item)
        opens = acc["term"].isNull() & short(t) & (acc["i"] < F.size(items) - 1)
        entry = F.array(F.struct(F.coalesce(acc["term"], F.lit("")).alias("term"), t.alias("definition")))
        return F.struct((acc["i"] + 1).alias("i"), F.when(opens, t).alias("term"), F.when(opens, acc["out"]).otherwise(F.concat(acc["out"], entry)).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


LINKS = "array<struct<label:string,href:string,block:int,start:int>>"


def place_of(label: Column, content: Column) -> Column:
    """Where a label stands in a text (from 1, 0: nowhere): as it is, or else with any blanks for its own."""
    quoted = F.replace(F.replace(label, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E\\s+\\Q"))
    literal = F.instr(content, label)
    return F.when(literal > 0, literal).otherwise(F.regexp_instr(content, F.concat(F.lit("\\Q"), quoted, F.lit("\\E"))))


def _used(links: Column, runs: Column) -> Column:
    """links with the block that uses each up (-1: none) and its place there, blocks being met in their order. A paragraph uses
    all free links that it names; a list whose items are labels of as many free links, one each, uses these, any other none."""
    free = lambda x: x.block < 0
    taken = lambda x, b, at: F.struct(x.label.alias("label"), x.href.alias("href"), b.run.alias("block"), at.cast("int").alias("start"))

    def named(state: Column, b: Column) -> Column:
        hit = lambda x: free(x) & (F.length(x.label) >= 2) & (F.instr(normal(b.content), normal(x.label)) > 0) & (place_of(x.label, b.content) > 0)
        return F.transform(state, lambda x: F.when(hit(x), taken(x, b, place_of(x.label, b.content) - 1)).otherwise(x))

    def listed(state: Column, b: Column) -> Column:
        def item(acc: Column, text: Column) -> Column:
            labels = F.transform(acc.state, lambda x: F.when(free(x), normal(x.label)))
            hit = F.coalesce(F.array_position(labels, normal(text)), F.lit(0))
            moved = F.transform(acc.state, lambda x, i: F.when(i + 1 == hit, taken(x, b, acc.n)).otherwise(x))
            return F.struct(moved.alias("state"), (acc.n + 1).alias("n"), (acc.ok & (hit > 0)).alias("ok"))

        walked = F.aggregate(F.coalesce(b["items"], F.array().cast("array<string>")), F.struct(state.alias("state"), F.lit(0).alias("n"), F.lit(True).alias("ok")), item)
        return F.when(walked.ok, walked.state).otherwise(state)

    start = F.transform(links, lambda x: F.struct(F.trim(x.label).alias("label"), x.href.alias("href"), F.lit(-1).alias("block"), F.lit(-1).alias("start"))).cast(LINKS)
    return F.aggregate(runs, start, lambda acc, b: F.when(b.kind == "paragraph", named(acc, b)).when(b.kind == "list", listed(acc, b)).otherwise(acc).cast(LINKS))


def blocks(docs: DataFrame) -> DataFrame:
    """docs (page_id, text, and if there are any headings array<string>, links array<struct<label,href>>, format) ->
    (page_id, block, kind, style, n_lines, content, items, entries, links): runs of lines, closed by blank lines. Lines that
    are the next heading are blocks of their own. Links are used up in the order of blocks: a paragraph has those that it
    names, with their places in its content; a list is a link_list if every item is the label of a link of its own (start: the
    item). A list that is none is a glossary if the format says so, it has four bullets or more and half its entries have a
    term."""
    for name, kind in (("headings", "array<string>"), ("links", "array<struct<label:string,href:string>>"), ("format", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    cut = docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("at", F.when(F.size("headings") > 0, headings_at(F.col("lines"), F.col("headings"))))
    lines = cut.select("page_id", F.posexplode("lines").alias("pos", "line"), "at").withColumn("head", F.coalesce(F.get("at", F.col("pos")), F.lit(-1)))
    style = F.when(F.col("line").rlike(ITEM), "ul").when(F.col("line").rlike(NUMBER), "ol")
    kind = F.when(F.trim("line") == "", "blank").when(F.col("head") >= 0, "heading").when(style.isNotNull(), "list").otherwise("paragraph")
    order = Window.partitionBy("page_id").orderBy("pos")
    new = F.when((F.col("kind") != F.lag("kind", 1, "").over(order)) | (F.col("kind") == "heading"), 1).otherwise(0)
    grouped = lines.drop("at").withColumn("kind", kind).withColumn("style", style).withColumn("new", new).withColumn("run", F.sum("new").over(order)).filter("kind <> 'blank'")
    bare = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x["line"], ITEM, ""), NUMBER, "")))
    each = grouped.groupBy("page_id", "run", "kind").agg(
        F.min_by("style", "pos").alias("style"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), "\n").alias("content"), F.when(F.col("kind") == "list", bare).alias("items")
    )
    each = staged(each.withColumn("run", F.col("run").cast("int")), "runs")
    with_links = docs.filter(F.size("links") > 0).select("page_id", "links")
    runs = each.join(with_links, "page_id", "left_semi").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("run", "kind", "content", "items"))).alias("runs"))
    used = runs.join(with_links, "page_id").select("page_id", F.explode(_used(F.col("links"), F.col("runs"))).alias("x")).filter("x.block >= 0")
    used = used.groupBy("page_id", F.col("x.block").alias("run")).agg(F.sort_array(F.collect_list(F.struct("x.start", "x.label", "x.href"))).alias("links"))
    told = each.join(docs.select("page_id", "format"), "page_id").join(used, ["page_id", "run"], "left")
    linked = (F.col("kind") == "list") & F.col("links").isNotNull()
    pairs = F.when((F.col("style") == "ul") & (F.size("items") >= 4) & F.lower(F.coalesce("format", F.lit(""))).contains("glosario"), glossary_entries(F.col("items")))
    paired = told.withColumn("pairs", pairs)
    terms = F.size(F.filter("pairs", lambda e: e["term"] != ""))
    glossary = ~linked & F.coalesce(terms >= F.greatest(F.lit(1), F.floor(F.size("pairs") / 2)), F.lit(False))
    named = paired.withColumn("entries", F.when(glossary, F.col("pairs"))).withColumn("kind", F.when(linked, "link_list").when(glossary, "glossary").otherwise(F.col("kind")))
    return named.select("page_id", F.dense_rank().over(Window.partitionBy("page_id").orderBy("run")).alias("block"), "kind", "style", "n_lines", "content", "items", "entries", "links")


def link_places(blocks: DataFrame) -> DataFrame:
    """(page_id, href, block, start, end): the places in paragraphs of the links that blocks() found there."""
    each = blocks.filter("kind = 'paragraph'").select("page_id", "block", F.explode("links").alias("x"))
    return each.select("page_id", "x.href", "block", "x.start", (F.col("x.start") + F.length("x.label")).alias("end"))


def records(pages: DataFrame) -> DataFrame:
    """The ingest record of each page. A body with the magic number of a PDF is one whatever its url says, and has no text here;
    a page without a body has class fetch_error, one without text empty; neither fails the job."""
    body = F.coalesce("html", F.lit(""))
    read = staged(parsed(pages).select("page_id", "url", body.alias("html"), "parts"), "parts")
    pdf = is_pdf_body(F.encode("html", "UTF-8"))
    text = F.when(pdf, "").otherwise(F.col("parts.text"))
    held = read.withColumns({"pdf": pdf, "text": text, "video": video_info(F.col("parts"))})
    state = F.when(F.col("html") == "", "fetch_error").otherwise(extraction_class(F.col("text")))
    error = F.when(F.col("html") == "", "empty_body").when(F.col("text") == "", F.when(F.col("pdf"), "pdf_no_text").otherwise("no_text"))
    shown = lambda name: F.when((F.col("text") != "") & ~F.col("pdf"), F.col(f"video.{name}"))
    return held.select(
        "page_id", "url", host(F.col("url")).alias("host"), F.when(F.col("pdf"), "pdf").when((F.col("html") == "") & is_pdf_url(F.col("url")), "pdf").otherwise("html").alias("url_type"),
        F.when(F.col("html") == "", 0).otherwise(200).alias("status"), (F.col("html") != "").alias("ok"), F.when(F.col("text") != "", F.col("parts.title")).otherwise("").alias("title"), F.length("text").alias("text_len"),
        state.alias("classification"), F.coalesce(shown("has_video"), F.lit(False)).alias("has_video"), F.coalesce(shown("video_urls"), F.array().cast("array<string>")).alias("video_urls"),
        F.coalesce(shown("platforms"), F.array().cast("array<string>")).alias("platforms"), shown("schema_type").alias("schema_type"), F.coalesce(error, F.lit("")).alias("error"), "text",
    )


def class_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("classification").agg(F.count("*").alias("n"), F.sum("text_len").alias("chars"))


def ingest_summary(pages: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """The flat report of an ingest, one row a page, with the states of records(). catalog (page_id, title, source, format) may
    be missing."""
    extra = catalog if catalog is not None else pages.select("page_id", *[F.lit(None).cast("string").alias(c) for c in ("title", "source", "format")])
    known = extra.select("page_id", F.col("title").alias("title_csv"), F.col("source").alias("fuente"), "format")
    heads = headings(pages).groupBy("page_id").agg(F.count("*").alias("n"))
    whole = records(pages).join(known, "page_id", "left").join(heads, "page_id", "left")
    return whole.select(
        F.col("page_id").alias("content_id"), "url", "url_type", "fuente", "format", "status", "ok", F.col("title").alias("title_extracted"), "title_csv", titles_match(F.col("title"), F.col("title_csv")).alias("title_match"),
        "text_len", F.when(F.col("text_len") > 0, F.coalesce("n", F.lit(0))).otherwise(0).alias("num_headings"), "classification", "error",
    )
