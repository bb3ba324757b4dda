"""Line dedup, the classifier's columns and the pipeline's stages against plain loops; odd inputs for every stage."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorlens.llm import chosen_path_join, complement_packing, entropy_secrets, hilbert_neighbours, licence_sentences, line_templates, neighbour_toxicity, pareto_mixing, quality_rules_ensemble, risk_controlled_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def loop_dropped(rows):
    """{row: places dropped} of rows [(doc_id, text)] by the rules of the template tree, one line after the other."""
    variable = line_templates.VARIABLE
    mask = lambda x: " ".join(variable if re.search(r"[0-9@]|://", w) else w for w in x.split(" "))
    lines = []
    for row, (doc, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            words = re.split("[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r")) if line.strip(" \t\x0b\f\r") else [""]
            plain, masked = " ".join(words), mask(" ".join(words))
            n_constant = sum(w != variable for w in masked.split(" "))
            if len(words) <= 3 and n_constant < 0.6 * len(words):
                masked = plain
            if len(words) > 3 or len(words) > 1 and re.search(r"[^\W\d_]", masked):
                lines.append((row, pos, masked))
    in_rows = defaultdict(set)
    for row, _, masked in lines:
        in_rows[masked].add(row)
    template = {m: m for m, r in in_rows.items() if len(r) >= 3}
    leaves = defaultdict(set)
    for m in in_rows:
        if m not in template:
            leaves[len(m.split(" ")), tuple(m.split(" ")[:3])].add(m)
    general = {}
    for leaf, texts in leaves.items():
        if len({r for m in texts for r in in_rows[m]}) < 3 or len(texts) < 2:
            continue
        at = defaultdict(set)
        for m in texts:
            for place, w in enumerate(m.split(" ")):
                if w != variable:
                    at[place, w] |= in_rows[m]
        for m in texts:
            seen = [len(at[x]) if len(at.get(x, ())) >= 3 else 0 for x in enumerate(m.split(" "))]
            common = sorted(seen, reverse=True)[math.ceil(0.6 * len(seen)) - 1]
            if common:
                general[m] = (leaf, tuple(w if n and n >= 0.5 * common else variable for w, n in zip(m.split(" "), seen, strict=True)))
    of = defaultdict(set)
    for m, t in general.items():
        of[t] |= in_rows[m]
    template |= {m: t for m, t in general.items() if len(of[t]) >= 3}
    places = defaultdict(list)
    for row, pos, masked in lines:
        if masked in template:
            places[template[masked]].append((rows[row][0], row, pos))
    out = defaultdict(set)
    for found in places.values():
        for _, row, pos in sorted(found)[1:]:
            out[row].add(pos)
    return {row: sorted(x) for row, x in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_line_templates_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    names, fixed = ["anna", "bob", "carla", "dora", "emil"], ["All rights reserved.", "Read more", "a b", "7 8", "Subscribe to our weekly letter now", ""]
    make = [lambda: f"Dear reader please greet {rng.choice(names)} today again", lambda: f"Page {rng.randint(1, 99)} of {rng.choice(names)} begins right here", lambda: rng.choice(fixed), lambda: " ".join(rng.choices("one two three four five".split(), k=rng.randint(1, 7))), lambda: f"call {rng.randint(1, 5)}"]
    rows = [(i, "\n".join(rng.choice(make)() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    got = {r.doc_id: r.lt_drop for r in line_templates.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = loop_dropped(rows)
    assert sum(map(len, want.values())) > 50 and {i: x for i, x in got.items() if x} == want


def loop_features(text):
    """The classifier's statistics of a text, by Python."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if x.strip(" ")]
    n, share = len(words), lambda a, b: a / b if b else 0.0
    count = lambda p: len(re.findall(p, text, re.ASCII))
    upper = sum(c.isupper() for c in text)
    caps = len(re.findall(r"(?<![^\W\d_])[A-Z]{2,}(?![^\W\d_])", text))
    return dict(zip(quality_rules_ensemble.FEATURES, (
        math.log1p(n), share(len(text), n), share(upper, len(text)), share(count(r"[#*$%&|<>{}\[\]=~^_\\]"), len(text)), share(count("[0-9]"), len(text)), share(count(r"[.!?](?=\s|$)"), n), share(len(set(words)), n),
        share(len(lines) - len(set(lines)), len(lines)), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(count(r"[#*$%&]{2,}(?=\s|[.,]|$)"), n), share(caps, n),
        share(count(r"\s\|(?=\s)"), n), math.log1p(len(lines)), share(n, len(lines)), share(count("[!?]"), n), share(count(r"\S{25,}"), n),
    ), strict=True))


def five_grams(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with bad and good texts, near copies, recurring lines, odd rows; and their labels."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(300)]
    prose = lambda: " ".join(rng.choices(words, k=rng.randint(60, 120))).capitalize() + "."
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        text = "!!! ### $$$ BUY | NOW | " * 20 if bad else prose() + "\nSubscribe to our weekly letter now\n" + prose()
        if i % 10 == 3:
            text = rows[-1][1].replace(" ", "  ", 1) + " tail"
        rows.append((i, text, None, ("web", "books", None)[i % 3], len(text)))
        labels.append((i, int(not rows[-1][1].startswith("!!!")), 0))
    rows += [(500, "", None, "web", 0), (501, None, None, "web", None), (None, prose(), None, "books", 5), (502, prose(), "x", "web", 3)]
    rows += [rows[-1], (502, "!!! ### " * 30, None, "web", 3), (503, "x" * 3000 + " " + " " * 3000 + prose(), None, "web", 9)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stages_equal_plain_loops(spark, corpus):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules_ensemble.fit(docs, labels)
    assert model.rules

    def score(text):
        x = loop_features(text or "")
        return 1 / (1 + math.exp(-model.bias - sum(w for rule, w in model.rules if all(x[f] <= c if op == "<=" else x[f] > c for f, op, c in rule))))

    got = {(r.doc_id, r.text): r.score for r in quality_rules_ensemble.with_statistics(docs).select("q_doc.doc_id", "q_doc.text", model.score().alias("score")).collect()}
    assert all(s == pytest.approx(score(text), abs=1e-9) for (_, text), s in got.items())
    kept = stages["quality"](spark, docs, corpus)
    assert plain(kept) == sorted((tuple(r) for r in docs.collect() if score(r.text) >= quality_rules_ensemble.CUTOFF), key=str)
    kept = spark.createDataFrame(kept.collect(), DOCS)

    rows = [(r.doc_id, r.text) for r in kept.filter("doc_id is not null").distinct().orderBy("doc_id", "text").collect()]
    drop = loop_dropped(rows)
    cut = {(doc, text): "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop.get(i, ())) for i, (doc, text) in enumerate(rows) if text is not None}
    after = stages["line_dedup"](spark, kept.filter("doc_id is not null"), corpus)
    want = [cut.get((r.doc_id, r.text), r.text) for r in kept.filter("doc_id is not null").collect() if (r.doc_id, r.text) not in cut or cut[r.doc_id, r.text] == r.text or WORD.search(cut[r.doc_id, r.text])]
    assert sorted((r.text for r in after.collect()), key=str) == sorted(want, key=str)
    after = spark.createDataFrame(after.collect(), DOCS)

    texts = defaultdict(list)
    for r in after.collect():
        texts[r.doc_id].append(five_grams(r.text))
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and len(a & b) >= 0.8 * len(a | b) for a in texts[i] for b in texts[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    single = stages["near_duplicates"](spark, after, corpus)
    assert plain(single.select("doc_id", "text")) == sorted({(r.doc_id, r.text) for r in after.collect() if root(r.doc_id) == r.doc_id}, key=str)
    single = spark.createDataFrame(single.collect(), DOCS)
    assert any(root(i) != i for i in ids)

    mixed = stages["mix_sources"](spark, single, corpus).collect()
    size = lambda t: len(WORD.findall(t or ""))
    of = defaultdict(list)
    for r in single.collect():
        of[r.source].append(r)
    order = sorted(of, key=lambda s: (s is None, s))
    weight, total = dict(zip(order, (3, 1, 2), strict=False)), {s: sum(size(r.text) for r in of[s]) for s in of}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while over := {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * total[s]}:
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    for s in order:
        sure, lean = math.floor(target[s] / total[s]), lambda r: size(r.text) * 1000 // (size(r.text) + 100)
        part = lambda r: min(0.99, (target[s] / total[s] - sure) * (lean(r) * total[s] / sum(lean(x) * size(x.text) for x in of[s])))  # noqa: B023, E731
        u = lambda r: (int(hashlib.md5(f"7|{r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        upto = 0
        for r in of[s]:
            taken[r.doc_id, r.text] += sure
        for r in sorted((r for r in of[s] if part(r) > 0), key=lambda r: u(r) / (1 - u(r)) / (part(r) / (1 - part(r)))):
            if upto + size(r.text) / 2 <= target[s] - sure * total[s]:
                taken[r.doc_id, r.text] += 1
            upto += size(r.text)
    assert Counter((r.doc_id, r.text) for r in mixed) == +taken

    packed = stages["pack"](spark, spark.createDataFrame(mixed, DOCS), corpus).toPandas()
    encode = complement_packing._encoder(complement_packing.VOCABULARY, complement_packing.RANKS)
    pieces = Counter()
    for r in mixed:
        ids = np.array([*encode(r.text or ""), 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        pieces.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(map(tuple, packed[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == pieces
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all() and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_operators_take_odd_rows(spark, corpus):
    """Null and repeated ids, null, empty and very long texts, columns that clash with those the operators add."""
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumns({c: F.lit("own") for c in ("score", "size", "q_words", "lt_n", "sentences", "found", "copies", "kept", "label", "cp_id")})
    n = docs.count()
    assert quality_rules_ensemble.score(docs, quality_rules_ensemble.fit(docs, labels)).count() == n
    assert quality_rules_ensemble.accepted(docs, quality_rules_ensemble.RuleModel(0.0)).columns == docs.columns
    assert {r.doc_id for r in chosen_path_join.near_duplicates(docs).collect()} == {r.doc_id for r in docs.filter("doc_id is not null").collect()}
    assert complement_packing.pack_documents(docs).filter("piece = 0").count() == n
    assert entropy_secrets.secrets(docs).count() == licence_sentences.licences(docs).count() == n
    assert neighbour_toxicity.score(docs, neighbour_toxicity.fit(docs, labels)).count() == n
    assert pareto_mixing.mix(docs).count() == n and pareto_mixing.take(docs).columns == docs.columns
    assert pareto_mixing.take(docs).count() == pareto_mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert line_templates.without_recurring_lines(docs.drop("lt_n")).count() == n
    assert risk_controlled_rules.judge(docs, labels).count() == n
    assert risk_controlled_rules.judge(docs, labels.withColumn("quality", F.lit(0))).filter("kept = base_failed").count() == 0


def test_stages_take_empty_tables(spark, corpus):
    import corpus_pipeline

    none = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus).count() == 0, name


def steps_by_loop(rules, design):
    """The order of steps from design rows themselves: each time all tighter cutoffs of all rules are tried."""
    grid, at, steps = risk_controlled_rules.GRID, {}, []
    above = lambda r, k, label: sum(x[f"r_{r}"] > grid[k] for x, y in design if y == label) if k is not None else 0
    while True:
        tried = []
        for i, r in enumerate(rules):
            for k in range(at.get(r, len(grid))):
                bad, good = (above(r, k, y) - above(r, at.get(r), y) for y in (0, 1))
                if bad > 0:
                    tried.append((-bad / (1 + good), i, -k))
        if not tried:
            return steps
        _, i, k = min(tried)
        at[rules[i]] = -k
        steps.append((rules[i], grid[-k]))


def cutoffs_by_loop(stats, labels, risk, delta):
    rules, strata = risk_controlled_rules.RULES, len(risk_controlled_rules.STRATA)
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(r, labels[r.doc_id]) for r in stats if not r.base_failed and r.doc_id in labels and part(r.doc_id)]
    tests = {s: [r for r, y in known if y == 1 and part(r.doc_id) != 1 and r.stratum == s] for s in range(strata)}
    tail = lambda k, n: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    groups = [[s] for s in range(strata)]
    n_of = lambda g: sum(len(tests[s]) for s in g)
    while len(groups) > 1 and any(n_of(g) == 0 or tail(0, n_of(g)) > delta / strata for g in groups):
        i = min(range(len(groups)), key=lambda i: n_of(groups[i]))
        j = min([j for j in (i - 1, i + 1) if 0 <= j < len(groups)], key=lambda j: n_of(groups[j]))
        groups = [*groups[: min(i, j)], groups[min(i, j)] + groups[max(i, j)], *groups[max(i, j) + 1 :]]
    out = {}
    for g in groups:
        steps = steps_by_loop(rules, [(r, y) for r, y in known if part(r.doc_id) == 1 and r.stratum in g])
        mine = [r for s in g for r in tests[s]]
        for i in range(len(steps)):
            lost = sum(any(r[f"r_{rule}"] > c for rule, c in steps[: i + 1]) for r in mine)
            if not mine or tail(lost, len(mine)) > delta / strata:
                break
            out.update({(s, steps[i][0]): steps[i][1] for s in g})
    return out


@pytest.mark.parametrize("sizes", [(1500, 900, 1100), (1500, 60, 700), (100, 40, 20), (0, 0, 0)])
def test_cutoffs_of_planted_statistics_at_the_query_s_own_risk(spark, sizes):
    """Bad texts repeat and shout; the last stratum's good ones do so seldom, few rows are pooled or have no cutoff."""
    rng, rows, labels = random.Random(sum(sizes)), [], {}
    for s, n in enumerate(sizes):
        for _ in range(n):
            i, good = len(rows), rng.random() < 0.6
            draw = lambda high: min(1.0, rng.betavariate(2, 4 if high else 40))
            rows.append((i, s, rng.random() < 0.05, draw(False), draw(not good and rng.random() < 0.7), draw(rng.random() < 0.01), draw(not good and rng.random() < 0.3), rng.betavariate(8, 8)))
            if rng.random() < 0.9:
                labels[i] = int(good)
    stats = spark.createDataFrame(rows, "doc_id long, stratum int, base_failed boolean, " + ", ".join(f"r_{r} double" for r in risk_controlled_rules.RULES))
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = risk_controlled_rules.choose_cutoffs(stats, risk_controlled_rules.training_labels(marks, "quality"))
    assert got == cutoffs_by_loop(stats.collect(), labels, risk_controlled_rules.RISK, risk_controlled_rules.DELTA)
    assert bool(got) == (sum(sizes) > 500)
    if sizes[0] == 1500:
        held = [r for r in stats.collect() if not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels]
        falls = lambda r: any(s == r.stratum and r[f"r_{rule}"] > c for (s, rule), c in got.items())
        shares = [sum(map(falls, x)) / len(x) for x in ([r for r in held if labels[r.doc_id] == y] for y in (0, 1))]
        assert shares[0] > 0.4 and shares[1] < 0.04


def test_verdicts_follow_the_cutoffs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    risk, delta = 0.1, 0.5
    cutoffs = cutoffs_by_loop(risk_controlled_rules.statistics(docs).collect(), {r.doc_id: r.quality for r in labels.collect()}, risk, delta)
    assert cutoffs
    judged = risk_controlled_rules.judge(docs, labels, risk, delta).collect()
    assert all(r.kept == (not r.base_failed and not any(s == r.stratum and r[f"r_{rule}"] > c for (s, rule), c in cutoffs.items())) for r in judged)


def test_neighbours_take_empty_and_odd_tables(spark):
    frame = spark.createDataFrame([(0, None, "own"), (None, [1.0, 2.0], "own"), (50, [1.0, 0.0], "own")], "vec_id long, embedding array<float>, score string")
    assert hilbert_neighbours.neighbours(frame, F.col("hn_id") % 50 == 0).count() == 0


def test_take_takes_what_mix_takes(spark):
    """Equal rows that the end of a ranking falls between, null ids, sources and texts, and columns named like the operator's."""
    rows = [(7, "x " * 50 + str(i % 3), "q") for i in range(41)] + [(i, "w " * (i % 9), "y") for i in range(30)] * 3 + [(None, "a b", None)] * 2 + [(6, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "mx_rank": F.lit(2), "target": F.lit(3)})
    taken = pareto_mixing.take(docs)
    assert taken.columns == docs.columns
    mixed = pareto_mixing.mix(docs).collect()
    assert Counter(tuple(r) for r in taken.select("doc_id", "source", pareto_mixing.word_count(F.col("text"))).collect()) == sum((Counter({(r.doc_id, r.source, r["size"]): r.copies}) for r in mixed if r.copies), Counter())
