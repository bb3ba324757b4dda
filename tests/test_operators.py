"""Micro fixtures: hand-made users, graph, pages, answers and files with known results."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tutorlens.functions import text as T
from tutorlens.operators import html
from tutorlens.operators.html import parsed
from tutorlens.operators import audit, enrich, factors, graph, metrics, pages, profiles, scorers, split
from tutorlens.sources import files
from tutorlens.streaming import exposure

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, u, c, None if t is None else T0 + dt.timedelta(hours=t), s, e) for i, (u, c, t, s, e) in enumerate(rows)], "event_id long, user_id long, content_id int, ts timestamp, score double, event string")


def test_warm_split_sides(spark):
    events = log(spark, [(1, 1, 0, 1.0, "viewed"), (2, 1, 0, 1.0, "viewed"), (2, 2, 1, 1.0, "viewed"), (2, 1, 9, 1.0, "viewed"), (3, 1, None, 1.0, "viewed"), (3, 2, 5, 1.0, "viewed"), (3, 3, 6, 0.1, "viewed")])
    got = {(r.user_id, r.content_id): r.side for r in split.warm_split(events).collect()}
    assert got == {(1, 1): "train", (2, 1): "train", (2, 2): "test", (3, 1): "train", (3, 2): "train", (3, 3): "test"}


def test_cold_split_keeps_all_rows_and_is_disjoint(spark):
    events = log(spark, [(u, c, c, 0.5, "viewed") for u in range(20) for c in range(3)])
    sides = split.cold_split(events, 5)
    assert sides.count() == 60
    test, pool = ({r.user_id for r in sides.filter(F.col("side") == s).collect()} for s in ("test", "pool"))
    assert len(test) == 5 and not test & pool


def test_required_takes_direct_coverage_only(spark):
    mapping = spark.createDataFrame([(1, 10, "directa"), (1, 11, "indirecta"), (2, 11, "directa")], "content_id int, concept_id int, coverage_type string")
    edges = spark.createDataFrame([(10, 9), (11, 10)], "concept_id int, prerequisite_concept_id int")
    assert {tuple(r) for r in graph.required(mapping, edges).collect()} == {(1, 9), (2, 10)}


def loop_metrics(scores, history, test, required, mastered, k):
    """The evaluation as a plain loop over users."""
    users, raw_hits, post_hits, ndcg, considered, rejected, feasible = 0, [], [], [], 0, 0, []
    for u in sorted({u for u, _ in scores}):
        order = sorted((c for v, c in scores if v == u and (u, c) not in history), key=lambda c: (-scores[u, c], c))
        rel = {c for v, c in test if v == u}
        ok = lambda c: required.get(c, set()) <= mastered.get(u, set())  # noqa: E731, B023
        post = []
        for c in order:
            if len(post) == k:
                break
            considered += 1
            if ok(c):
                post.append(c)
            else:
                rejected += 1
        if rel:
            users += 1
            raw_hits.append(len(set(order[:k]) & rel) / k)
            post_hits.append(len(set(post) & rel) / k)
            ideal = sum(1 / math.log2(i + 2) for i in range(min(len(rel), k)))
            ndcg.append(sum(1 / math.log2(i + 2) for i, c in enumerate(post) if c in rel) / ideal)
            feasible.append(len(post) >= k)
    mean = lambda x: sum(x) / len(x)
    return {"raw_precision_5": mean(raw_hits), "precision_5": mean(post_hits), "ndcg_5": mean(ndcg), "filter_rate_pct": 100 * rejected / considered, "feasibility_at_5_pct": 100 * mean(feasible), "users_evaluated": users}


def test_evaluate_equals_a_plain_loop(spark):
    rng = random.Random(4)
    scores = {(u, c): float(rng.randint(0, 4)) for u in range(5) for c in range(8)}
    history = {(0, 1), (1, 2), (2, 0)}
    test = {(0, 2), (0, 3), (1, 5), (3, 7)}
    required = {2: {1}, 3: {1, 2}, 5: {0}, 6: {3}, 7: {3}, 4: {4}}
    mastered = {0: {1, 2}, 1: {0}, 4: {0, 1, 2, 3, 4}}
    want = loop_metrics(scores, history, test, required, mastered, 5)
    pair = "user_id long, content_id int"
    got = metrics.evaluate(
        spark.createDataFrame([(u, c, s) for (u, c), s in scores.items()], f"{pair}, score double"), spark.createDataFrame(sorted(history), pair), spark.createDataFrame([(u, c, 1.0) for u, c in sorted(test)], f"{pair}, score double"),
        spark.createDataFrame([(c, r) for c, rs in required.items() for r in rs], "content_id int, required_concept_id int"), spark.createDataFrame([(u, c) for u, cs in mastered.items() for c in cs], "user_id long, concept_id int"), 8,
    ).first().asDict()
    assert want["feasibility_at_5_pct"] < 100
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-6), name


def test_profiles_follow_missing_codes(spark):
    rows = [(1, 1990, -97, -98, -99, -97), (2, 1990, 3, -97, 2, 1), (3, 1990, 3, 3, 1, 1), (4, 1990, 1, 1, 2, 0), (5, 1950, 3, 3, 1, 1)]
    survey = spark.createDataFrame([(i, y, 1, 5, 9, a, b, c, f, f, f, f, f, f) for i, y, a, b, c, f in rows], "respondent int, a0400 int, a0100 int, e0100 int, a1500 int, k0600 int, k0100 int, k1003 int, b0130a int, b0130b int, b0130c int, b1000b int, b1000c int, a0320 int")
    got = {r.user_id: (r.financial_knowledge_level, r.saving_habit, r.investment_experience) for r in profiles.user_profiles(survey).collect()}
    assert got == {"U0001": (None, None, None), "U0002": ("medio", "frecuente", "básica"), "U0003": ("alto", "frecuente", "básica"), "U0004": ("bajo", "ocasional", "ninguna")}


def test_page_parts(spark):
    html = '<html><body><nav><a href="/menu">menu</a></nav><article><h1>One &amp; two</h1><p>Para <a href="mailto:x@y">mail</a><a href="/go">See more</a></p><h2>Next</h2><ul><li>x</li></ul><iframe src="//www.youtube.com/embed/1"></iframe></article></body></html>'
    frame = spark.createDataFrame([(1, "https://h.org/a/b?x=1", html), (2, "https://h.org/a/b", None)], "page_id long, url string, html string")
    assert [(r.level, r.heading) for r in pages.headings(frame).orderBy("pos").collect()] == [(1, "One & two"), (2, "Next")]
    assert {r.href for r in pages.links(frame, main_only=False).collect()} == {"https://h.org/menu", "https://h.org/go"}
    video = parsed(frame.filter("page_id = 1")).select(pages.video_info(F.col("parts")).alias("v")).first().v
    assert video.has_video and video.video_urls == ["https://www.youtube.com/embed/1"] and video.platforms == ["youtube"]
    assert {r.page_id: r.deduped_from for r in pages.fan_out(frame).collect()} == {1: None, 2: 1}
    assert {r.page_id: r.classification for r in pages.records(frame).collect()} == {1: "short", 2: "fetch_error"}


def test_sections_and_blocks(spark):
    docs = spark.createDataFrame([(1, "A\ntext\nB\nmore\nA", ["A", "Z", "B", "A"])], "page_id long, text string, headings array<string>")
    assert [(r.heading, r.start, r.end, r.found) for r in pages.sections(docs).orderBy("pos").collect()] == [("A", 0, 7, True), ("Z", None, None, False), ("B", 7, 14, True), ("A", 14, 15, True)]
    text = spark.createDataFrame([(1, "one\ntwo\n\n- a\n- b\n1. x\n\nend")], "page_id long, text string")
    assert [(r.block, r.kind, r.style, r.n_lines, r.items) for r in pages.blocks(text).orderBy("block").collect()] == [(1, "paragraph", None, 2, None), (2, "list", "ul", 3, ["a", "b", "x"]), (3, "paragraph", None, 1, None)]


def test_sections_are_found_in_other_case_and_spacing(spark):
    text = "Intro\nThe  Big\tplan\nbody “here”\nWHAT’S  NEXT?\nthe big plan again İ\nend (a+b)"
    docs = spark.createDataFrame([(1, text, ["the big  PLAN", "What's next?", "The big plan", "none", "END (a+b)"]), (2, "", ["x"]), (3, None, ["x"]), (4, "x", [" "])], "page_id long, text string, headings array<string>")
    got = {(r.page_id, r.pos): (r.start, r.end, r.found) for r in pages.sections(docs).collect()}
    at = [text.index("The  Big"), text.index("WHAT"), text.index("the big plan"), text.index("end (")]
    assert [got[1, k] for k in range(5)] == [(at[0], at[1], True), (at[1], at[2], True), (at[2], at[3], True), (None, None, False), (at[3], len(text), True)]
    assert got[2, 0] == (None, None, False) and got[4, 0] == (None, None, False)


def loop_blocks(text, headings, links):
    """Blocks of a text by a plain loop: headings in order, lists, paragraphs; blocks use links up as they come."""
    norm = lambda x: " ".join(x.split()).lower()
    out, buffer, kind, k, pool = [], [], None, 0, list(links)

    def close():
        nonlocal buffer, pool
        if buffer:
            left, linked = list(pool), kind == "list"
            for x in buffer if linked else []:
                hit = next((label for label in left if norm(label) == norm(x)), None)
                linked = linked and hit is not None
                left = [label for i, label in enumerate(left) if hit is None or i != left.index(hit)]
            pool = left if linked else [label for label in pool if kind != "paragraph" or label not in "\n".join(buffer)]
            out.append(("link_list" if linked else kind, len(buffer), "\n".join(buffer)))
        buffer = []

    for line in text.split("\n"):
        item = re.sub(r"^\s*[-•·]\s+|^\s*\d+[.)]\s+", "", line)
        if not line.strip():
            now = None
        elif k < len(headings) and norm(line) == norm(headings[k]):
            now, k = "heading", k + 1
        else:
            now = "list" if item != line else "paragraph"
        if now != kind or now == "heading":
            close()
        kind = now
        if now:
            buffer.append(item.strip() if now == "list" else line.strip())
    close()
    return out


def test_blocks_equal_a_plain_loop(spark):
    rng = random.Random(6)
    lines = ["One", "Two  words", "", " ", "- alpha", "• beta", "3) gamma", "plain text", "Three", "more of it"]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(rng.choices(lines, k=rng.randint(1, 14))), rng.sample(["One", "two words", "Three"], rng.randint(0, 3)), [("alpha", "h1"), ("Beta", "h2"), ("plain", "h3"), ("alpha", "h4"), ("gamma", "h5")][: rng.randint(0, 5)]))
    frame = spark.createDataFrame(rows, "page_id long, text string, headings array<string>, links array<struct<label:string,href:string>>")
    got = {i: [] for i in range(60)}
    for r in pages.blocks(frame).orderBy("page_id", "block").collect():
        got[r.page_id].append((r.kind, r.n_lines, "\n".join(r["items"]) if r["items"] is not None else r.content))
    assert got == {i: loop_blocks(text, heads, [label for label, _ in links]) for i, text, heads, links in rows}


def test_glossary_and_link_places(spark):
    items = ["Term", "What it means, at length.", "Long item that ends with a point.", "Other term", "Its meaning", "Tail"]
    text = "\n".join(f"- {x}" for x in items) + "\n\nSee the guide here.\n\nSee the guide again"
    frame = spark.createDataFrame([(1, text, "Glosario web"), (2, text, "Vídeo")], "page_id long, text string, format string")
    blocks = pages.blocks(frame)
    kinds = {(r.page_id, r.block): (r.kind, r.entries) for r in blocks.collect()}
    assert kinds[2, 1][0] == "list" and kinds[1, 1][0] == "glossary"
    assert [(e.term, e.definition) for e in kinds[1, 1][1]] == [("Term", items[1]), ("", items[2]), ("Other term", "Its meaning"), ("", "Tail")]
    given = frame.filter("page_id = 1").withColumn("links", F.expr("array(struct('the guide' AS label, 'u1' AS href), struct('nowhere' AS label, 'u2' AS href))"))
    assert [tuple(r) for r in pages.link_places(pages.blocks(given)).collect()] == [(1, "u1", 2, 4, 13)]


def test_links_are_used_up_in_the_order_of_blocks(spark):
    def found(text, links, fmt=None):
        rows = [(1, text, [(a, b) for a, b in links], fmt)]
        out = pages.blocks(spark.createDataFrame(rows, "page_id long, text string, links array<struct<label:string,href:string>>, format string")).orderBy("block").collect()
        return [(r.kind, [(x.label, x.href, x.start) for x in r.links or []]) for r in out]

    # two items and one link: no link_list, and the link is still there for the paragraph
    assert found("- A1\n- A1\n\nsee A1", [("A1", "u")]) == [("list", []), ("paragraph", [("A1", "u", 4)])]
    assert found("- A1\n- A1\n\nsee A1", [("A1", "u"), ("A1", "v")]) == [("link_list", [("A1", "u", 0), ("A1", "v", 1)]), ("paragraph", [])]
    # a paragraph takes the link first; the list after it is left with none
    assert found("read More here\n\n- More", [("More", "u")]) == [("paragraph", [("More", "u", 5)]), ("list", [])]
    # any case and quotes match items; places in paragraphs need the letters, with any blanks between
    assert found("- the “One”\n- TWO\n\nA long\nlabel, the ONE", [("Two", "b"), ('The "one"', "a"), ("long label", "c"), ("the one", "d")]) == [("link_list", [('The "one"', "a", 0), ("Two", "b", 1)]), ("paragraph", [("long label", "c", 2)])]
    # marks of patterns are plain letters, a label of one letter is none, and an item too many makes a list
    assert found("x (a+b)\\E? y\n\n- q", [("(a+b)\\E?", "u"), ("x", "v")]) == [("paragraph", [("(a+b)\\E?", "u", 2)]), ("list", [])]
    assert found("- Aa\n- Bb\n- Cc", [("Aa", "u"), ("Bb", "v")]) == [("list", [])] and found("- Aa", []) == [("list", [])]


def test_main_links_take_the_heading_over_a_call(spark):
    html = '<nav><a href="/menu">menu</a></nav><article><h2>Budget tool</h2><a href="/tool">Try it</a><a href="b.html#x">A label that is long enough to stand</a><a href="/p#top">same page</a></article>'
    got = {r.href: r.label for r in pages.links(spark.createDataFrame([(1, "https://h.org/p", html)], "page_id long, url string, html string")).collect()}
    assert got == {"https://h.org/tool": "Budget tool", "https://h.org/b.html#x": "A label that is long enough to stand"}
    video = '<script type="application/ld+json">[{"@type": "VideoObject", "embedUrl": "//v/1"}, {"@type": "Article", "url": "x"}]</script><script type="application/ld+json">{"@type": "VideoObject", "contentUrl": "https://v/2", "url": "y"}</script><script type="application/ld+json">{broken</script>'
    found = parsed(spark.createDataFrame([(1, "u", video)], "page_id long, url string, html string")).select(pages.video_objects(F.col("parts.scripts"))).first()[0]
    assert [(x.content, x.embed) for x in found] == [(None, "//v/1"), ("https://v/2", None)]


def test_ingest_summary_states(spark):
    whole = "<title>The guide</title><h1>Head</h1><p>" + "word " * 60 + "</p>"
    rows = [(1, "https://h/x.pdf", None), (2, "https://h/y", "<p></p>"), (3, "https://h/z", whole), (4, "https://h/web", "%PDF-1.4 bytes"), (5, "https://h/w.pdf", whole), (6, "https://h/v", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    catalog = spark.createDataFrame([(3, "the  Guide!", "web", "Artículo")], "page_id long, title string, source string, format string")
    got = {r.content_id: (r.url_type, r.status, r.ok, r.title_match, r.num_headings, r.classification, r.error) for r in pages.ingest_summary(frame, catalog).collect()}
    assert got == {
        1: ("pdf", 0, False, False, 0, "fetch_error", "empty_body"), 2: ("html", 200, True, False, 0, "empty", "no_text"), 3: ("html", 200, True, True, 1, "ok", ""),
        4: ("pdf", 200, True, False, 0, "empty", "pdf_no_text"), 5: ("html", 200, True, False, 1, "ok", ""), 6: ("html", 0, False, False, 0, "fetch_error", "empty_body"),
    }


def parts_of(spark, html, url="https://h.org/x/y/page"):
    frame = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return frame, parsed(frame).select("parts", pages.video_info(F.col("parts")).alias("video")).first()


def test_videos_of_every_kind(spark):
    html = """<video src='a.mp4'><source src="//cdn/b.webm"><source></video><source src="outside.mp4"><picture><source src="p.png"></picture>
    <iframe src=" https://fast.wistia.net/embed/1 "></iframe><iframe src='https://player.vimeo.com/2'></iframe><iframe src="//www.YouTube-nocookie.com/embed/3"></iframe>
    <iframe src="https://maps.org/4"></iframe><iframe></iframe><div data-video=" ID5 "></div><div data-video=""></div>
    <script type="application/ld+json">[{"@type": ["Thing", "VideoObject"], "contentUrl": "https://v/6", "embedUrl": "//v/7"}, {"@type": "Article", "url": "no"}, 3]</script>
    <script type="application/ld+json">{"@type": "VideoObject", "contentUrl": "", "url": "a.mp4"}</script><script type="application/ld+json">{broken</script><script>{"@type": "VideoObject", "url": "no"}</script>"""
    video = parts_of(spark, html)[1].video
    assert video.video_urls == ["a.mp4", "https://cdn/b.webm", "https://fast.wistia.net/embed/1", "https://player.vimeo.com/2", "https://www.YouTube-nocookie.com/embed/3", "https://maps.org/4", "https://www.youtube.com/embed/ID5", "https://v/6", "https://v/7"]
    assert video.platforms == ["direct", "vimeo", "wistia", "youtube"] and video.schema_type == "VideoObject" and video.has_video
    bare = parts_of(spark, '<script type="application/ld+json">{"@type": "VideoObject"}</script>')[1].video
    assert bare.has_video and bare.video_urls == [] and bare.schema_type == "VideoObject"
    none = parts_of(spark, "<p>no video</p>")[1].video
    assert not none.has_video and none.schema_type is None and none.platforms == []


def test_links_of_containers(spark):
    links = lambda html: {r.href: r.label for r in pages.links(parts_of(spark, html)[0]).collect()}
    up = "<div role='main'><a href='../up.html'>One level up from here</a><a href='?q=1'>Query of the page itself</a><a href='//o.org/z'>Another host's page</a></div><a href='/out'>outside of it all</a>"
    assert links(up) == {"https://h.org/x/up.html": "One level up from here", "https://h.org/x/y/page?q=1": "Query of the page itself", "https://o.org/z": "Another host's page"}
    two = "<article><a href='/1'>first article, a link</a></article><article><a href='/2'>second article, a link</a></article>"
    assert links(two) == {"https://h.org/1": "first article, a link"}
    assert links("<article><a href='/1'>in an article, before</a></article><main><a href='/2'>in the main element</a></main>") == {"https://h.org/2": "in the main element"}
    assert links("<div id='content'><h2>Tool <b>box</b></h2><a href='/t'>Go</a><a href='/t2'>Try</a><a href='/t2'>again the same one</a></div>") == {"https://h.org/t2": "Tool box"}
    assert links("<section class='x main-content'><a href='/a'>ends with a point.</a></section>") == {"https://h.org/a": "ends with a point."}
    assert links("<a href='/a'>no container at all here</a>") == {} and links(None) == {}


def test_text_of_the_tree(spark):
    nested = "<head><title> A  b </title></head><nav><nav>in</nav>menu</nav><main><p>One<br>two <i>three</i></p><nav>skip</nav><div>four<script>x='</p>'</script></div></main><footer>end</footer>"
    parts = parts_of(spark, nested)[1].parts
    assert parts.text == "One\ntwo three\nfour" and parts.title == "A b"
    assert parts_of(spark, "<body>plain <b>text</b><footer>f</footer><p>more &amp; more")[1].parts.text == "plain text\nmore & more"
    assert parts_of(spark, None)[1].parts.text == "" and parts_of(spark, "<![if x]><p>odd<![endif]>")[1].parts is not None


def test_broken_responses_are_put_aside_once(spark, tmp_path):
    good = '{"tldr": "a text that is long enough", "key_points": ["a", "b"], "quiz": [{"question": "q", "options": ["x", "y"], "correct_index": 1, "explanation": "e", "concept_id": "C1"}]}'
    rows = [("ok", good), ("ok", good), ("none", None), ("words", "no braces here"), ("cut", good[:-2] + " }"), ("kind", good.replace('["a", "b"]', '"a"')), ("kind", good.replace('["a", "b"]', '"a"')), ("index", good.replace(": 1,", ": 7,")), ("empty", "{}"), (None, "")]
    responses = spark.createDataFrame(rows, "content_id string, response string")
    enrich.write_checked(responses, spark.createDataFrame([("C1", "one")], "concept_id string, concept_name string"), str(tmp_path / "out"))
    kept = spark.read.json(str(tmp_path / "out/records")).collect()
    aside = spark.read.schema("content_id string, reason string, _corrupt_record string").json(str(tmp_path / "out/quarantine"))
    aside = [(r.content_id, r.reason) for r in aside.select("content_id", "reason").collect()]
    assert [r.content_id for r in kept] == ["ok", "ok"] and len(kept) + len(aside) == len(rows)
    assert sorted(aside, key=str) == sorted([("none", "no response"), ("words", "no object"), ("cut", "broken json"), ("kind", "broken json"), ("kind", "broken json"), ("index", "correct_index"), ("empty", "no json,tldr,key_points,quiz"), (None, "no object")], key=str)


def test_requests_name_metadata_and_glossary(spark):
    docs = spark.createDataFrame([("C1", "A title", "ahorro", None, "básico", "To save", ["One"] * 30, [("list", None), ("glossary", [("", "orphan"), ("Term", "d" * 300)])], "x" * 30_001), ("C2",) + (None,) * 8], "content_id string, title string, topic string, subtopic string, difficulty string, learning_objective string, headings array<string>, blocks array<struct<type:string,entries:array<struct<term:string,definition:string>>>>, text string")
    concepts = spark.createDataFrame([("C02", "two"), ("C01", "one")], "concept_id string, concept_name string")
    got = {r.content_id: r.prompt for r in enrich.requests(docs, concepts).collect()}
    lines = got["C1"].split("\n")
    assert lines[:5] == ["- Title: A title", "- Topic: ahorro / ", "- Difficulty: básico", "- Objective: To save", "Concepts: C01 (one); C02 (two)"]
    assert lines[5:7] == ["Glossary:", "- Term: " + "d" * 200] and lines.count("- One") == 20 and lines[-1] == "[...]"
    assert "(none)" in got["C2"] and got["C2"].startswith("- Title: \n")


def test_eligibility_rules_by_hand(spark):
    events = log(spark, [(1, 0, 1, 1.0, "completed"), (1, 1, 2, 1.0, "viewed"), (2, 2, 1, 1.0, "disliked"), (2, 1, 2, 1.0, "viewed"), (1, 2, 3, 1.0, "viewed")])
    users = spark.createDataFrame([(1, "bajo", "ninguna"), (2, "alto", "básica")], "user_id long, level string, experience string")
    contents = spark.createDataFrame([(0, 0, "básico", False), (1, 0, "intermedio", False), (2, 1, "avanzado", True)], "content_id int, topic int, difficulty string, is_investment_related boolean")
    topics = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3)], "topic int, place int, concept_id int")
    seen = audit.first_seen(events, contents.join(topics, "topic").select("content_id", "concept_id"))
    needs = audit.content_needs(contents, topics, [1, 2])
    got = {r.event_id: [k for k in ("r1", "r2", "r3", "r4") if r[k]] for r in audit.eligibility(events, users, contents, seen, needs).collect()}
    # event 2: nothing was seen before; event 3: a bounced event marks nothing; event 4: concepts 1 and 2 were seen, 3 not
    assert got == {0: [], 1: [], 2: ["r2", "r3", "r4"], 3: ["r4"], 4: ["r1", "r2", "r4"]}
    pairs = users.select("user_id").crossJoin(contents.select("content_id"))
    allowed = audit.qualifying(pairs, users, contents, seen, needs)
    assert {tuple(r) for r in allowed.collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    pool = {(r.user_id, r.target): (r.tier, r.n_contents) for r in audit.difficulty_pool(allowed.filter("user_id = 1"), pairs, contents).collect()}
    assert pool == {(1, "básico"): (1, 1), (1, "intermedio"): (1, 1), (1, "avanzado"): (2, 1), (2, "básico"): (3, 1), (2, "intermedio"): (3, 1), (2, "avanzado"): (3, 1)}


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    rows = [(u, c, float(rng.random())) for u in range(12) for c in range(6) if (u * 7 + c * 3) % 4]
    users = spark.createDataFrame([(u, "ab"[u % 2]) for u in range(12)], "user_id long, kind string")
    contents = spark.createDataFrame([(c, "xyz"[c % 3]) for c in range(6)], "content_id int, topic string")
    model = scorers.svd_ridge(spark.createDataFrame(rows, "user_id long, content_id int, score double"), users, contents, ["kind"], ["topic"], rank=3)
    pairs = users.select("user_id").crossJoin(contents.select("content_id"))
    got = {(r.user_id, r.content_id): r.predicted for r in factors.scores(pairs, *model).collect()}
    a = np.zeros((12, 6))
    for u, c, s in rows:
        a[u, c] = s
    u_, s_, v_ = np.linalg.svd(a, full_matrices=False)
    dots = (u_[:, :3] * s_[:3]) @ v_[:3]
    x = lambda u, c: [dots[u, c], u % 2 == 0, u % 2 == 1, c % 3 == 0, c % 3 == 1, c % 3 == 2]
    m, y = np.array([x(u, c) for u, c, _ in rows], float), np.array([s for *_, s in rows])
    centred = m - m.mean(0)
    w = np.linalg.solve(centred.T @ centred + np.eye(6), centred.T @ (y - y.mean()))
    want = {(u, c): y.mean() + (np.array(x(u, c), float) - m.mean(0)) @ w for u in range(12) for c in range(6)}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_draws_follow_their_weights(spark):
    u = profiles.coin(4, F.col("id"))
    got = {r.x: r["count"] for r in spark.range(20_000).select(profiles.draw(u, [("a", 0.3), ("b", 0.4), ("c", 0.3)]).alias("x")).groupBy("x").count().collect()}
    assert all(abs(got[k] / 20_000 - w) < 0.01 for k, w in (("a", 0.3), ("b", 0.4), ("c", 0.3)))
    picks = profiles.weighted_pick(spark.range(6_000).crossJoin(spark.createDataFrame([(1, 1.0), (2, 3.0)], "item int, w double")), "id", "item", "w").groupBy("item").count().collect()
    assert abs({r["item"]: r["count"] for r in picks}[2] / 6_000 - 0.75) < 0.04
    named = audit.numbered(spark.range(0, 300_000, 7).withColumnRenamed("id", "k"), "k").filter("number <> k / 7 + 1").count()
    assert named == 0


def test_validation_codes(spark):
    good = '{"tldr": "a text that is long enough", "key_points": ["a", "b"], "quiz": [{"question": "q", "options": ["x", "y"], "correct_index": 1, "explanation": "e", "concept_id": "C99"}]}'
    rows = [("ok", good), ("fenced", f"Here:\n```json\n{good}\n```"), ("broken", good[:50]), ("index", good.replace(": 1,", ": 2,")), ("short", good.replace("a text that is long enough", "tiny")), ("null", None)]
    concepts = spark.createDataFrame([("C1", "one")], "concept_id string, concept_name string")
    got = {r.content_id: r for r in enrich.validate(spark.createDataFrame(rows, "content_id string, response string"), concepts).collect()}
    assert [k for k, r in got.items() if r.ok] == ["ok", "fenced"]
    assert got["ok"].data.quiz[0].concept_id is None
    assert got["index"].errors == ["correct_index"] and got["short"].errors == ["tldr"] and "no json" in got["null"].errors


def test_text_functions(spark):
    row = spark.range(1).select(
        T.titles_match(F.lit(" Hola  Mundo "), F.lit("hola mundo!")).alias("match"), T.titles_match(F.lit(""), F.lit("x")).alias("blank"), T.is_pdf_url(F.lit("https://h/x.PDF?a=1")).alias("pdf"),
        T.loose_date(F.lit("D:20210304120000+02'00'")).alias("date"), T.loose_date(F.lit("2021.03.04")).alias("dots"), T.loose_date(F.lit("p. 12345")).alias("other"), T.loose_date(F.lit(" ")).alias("nothing"),
        T.decoded(F.lit(b"charset=windows-1252 \x80")).alias("euro"), T.decoded(F.lit(b"charset=iso-8859-15 \xa4")).alias("euro15"), T.title_guess(F.lit("12\nab\n3 Guide of x\nA fair title\nSame lengths\nshort one")).alias("title"),
        T.subset(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("sub"), T.subset(F.lit(None).cast("array<int>"), F.array(F.lit(1))).alias("none_needed"), T.first_are_in(F.array(F.lit(1), F.lit(2), F.lit(9)), F.array(F.lit(2), F.lit(1))).alias("two"),
        T.filled(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(""))).alias("map"), T.lenient_timestamp(F.lit("never")).alias("never"), T.loose_date(F.lit("2021-03")).alias("month"), T.is_pdf_body(F.lit(b"%PDF-1.4")).alias("magic"), T.decoded(F.lit('charset=iso-8859-1 "é"'.encode("latin-1"))).alias("text"),
        T.without_page_lines(F.lit("12\nreal line\n3 Guide of x\n\n\n\nend")).alias("lines"),
    ).first()
    assert row.match and not row.blank and row.pdf and row.magic
    assert row.dots == "2021-03-04" and row.other == "p. 12345" and row.nothing is None and row.euro.endswith("€") and row.euro15.endswith("€") and row.title == "A fair title"
    assert row.sub and row.none_needed and row.two and row.map == {"a": "x"} and row.never is None
    assert row.date == "2021-03-04" and row.month == "2021-03" and "é" in row.text and row.lines == "real line\n\nend"


def test_catalog_appends_and_refuses(spark):
    old = spark.createDataFrame([("C1", "a")], "content_id string, title string")
    assert audit.append_new(old, spark.createDataFrame([("C2", "b")], old.schema)).count() == 2
    with pytest.raises(Exception, match="already in catalog"):
        audit.append_new(old, spark.createDataFrame([("C1", "b")], old.schema)).collect()


def test_files_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("C1", 'say "hi", ok', 0.5), ("C2", "línea", None)], "content_id string, title string, score double")
    for quoted in (False, True):
        files.write_csv(frame, path := str(tmp_path / f"csv{quoted}"), quoted)
        back = files.read_csv(spark, path, frame.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))
    files.write_records(frame, path := str(tmp_path / "json"))
    assert spark.read.schema(frame.schema).json(path).count() == 2
    (tmp_path / "ragged.csv").write_text("a,b,c\n1,2\n1,2,3\n1,2,3,4\n")
    assert [tuple(r) for r in files.read_ragged_csv(spark, str(tmp_path / "ragged.csv"), ["a", "b", "c"]).collect()] == [("1", "2", ""), ("1", "2", "3"), ("1", "2", "3,4")]
    (tmp_path / "wide.csv").write_text("user_id,C1,C2\nU1,0.5,1\n")
    assert {tuple(r) for r in files.read_score_matrix(spark, str(tmp_path / "wide.csv")).collect()} == {("U1", "C1", 0.5), ("U1", "C2", 1.0)}


def test_exposure_stream_equals_batch(spark, tmp_path):
    events = log(spark, [(u, c, u + c / 4, 1.0, "viewed" if c % 2 else "disliked") for u in range(4) for c in range(6)])
    events.write.parquet(str(tmp_path / "in"))
    stream = exposure.exposure_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("exposed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("exposed").collect())) == sorted(map(tuple, exposure.exposure_counts(events).collect()))


def test_pages_leave_python_in_stretches(spark):
    """A batch of pages is not held as Python objects whole: parts come out by AT_ONCE characters, a page of more by itself."""
    small = "<main><h1>Title</h1><a href='/x'>a label</a>" + "<p>words</p>" * 2000 + "</main>"
    bodies = [small] * 40 + ["<p>" + "z" * html.AT_ONCE + "</p>", None, small]
    out = list(html._parts(iter([(pa.array(bodies), pa.array(["http://h/"] * len(bodies)))])))
    assert sum(map(len, out)) == len(bodies) and len(out) >= 6
    at = 0
    for part in out:
        assert len(part) == 1 or sum(len(b or "") for b in bodies[at : at + len(part)]) <= html.AT_ONCE
        at += len(part)
    frame = spark.createDataFrame([(i, "http://h/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    rows = {r.page_id: r.parts for r in parsed(frame).collect()}
    assert len(rows) == len(bodies) and rows[0] == rows[42] and rows[41].text == "" and len(rows[40].text) == html.AT_ONCE
    assert [(x.label, x.href, x.main) for x in rows[39].links] == [("a label", "http://h/x", True)]
    counted = {r.classification: r.n for r in pages.class_counts(pages.records(frame)).collect()}
    assert sum(counted.values()) == len(bodies) and counted["fetch_error"] == 1
    assert pages.links(frame).count() == 41 and pages.blocks(pages.records(frame).select("page_id", "text")).select("page_id").distinct().count() == 42
