"""Training-data operators against brute force, held-out labels and odd inputs."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tutorlens.llm import chosen_path_join, complement_packing, entropy_secrets, hilbert_neighbours, licence_sentences, line_templates, neighbour_toxicity, pareto_mixing, quality_rules_ensemble, risk_controlled_rules
from tutorlens.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, n_words string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, texts, sources=None):
    """Odd inputs ride along: extra columns that clash with result names, null ids and sources, repeated rows."""
    rows = [(i, t, None, (sources or ["a", "b", None])[i % len(sources or [1, 2, 3])], len(t or ""), None, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n)).replace(" " + vocabulary[5], ".\n" + vocabulary[5])
    base = [make(rng.randint(30, 120)) for _ in range(40)]
    near = []
    for t in base[:12]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, base[0], base[0], base[1].upper(), "", None, " \n\t ", "one", "one", "two words", make(6000)]


def five_grams(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_join_finds_brute_force_links(spark, texts):
    got = {r.doc_id: r for r in chosen_path_join.near_duplicates(docs_of(spark, texts)).collect()}
    sets = [five_grams(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    assert {i: r.links for i, r in got.items() if r.links} == dict(links)


def test_join_keeps_a_large_near_copy_group_together(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    many = [" ".join([*base[:k], "edit%d" % k, *base[k + 1 :]]) for k in range(150)] + ["other words stand in this text"]
    got = chosen_path_join.near_duplicates(docs_of(spark, many)).collect()
    assert {r.class_id for r in got if r.doc_id < 150} == {0}
    assert next(r for r in got if r.doc_id == 150).links == 0


def test_join_keeps_copies_of_one_original_that_resemble_it_only(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    many = []
    for k in range(400):
        copy = list(base)
        for at in rng.sample(range(10, 190), 3):
            copy[at] = f"edit{k}-{at}"
        many.append(" ".join(copy))
    many.insert(200, " ".join(base))
    sets = [five_grams(t) for t in many]
    linked = {i for i, s in enumerate(sets) if len(s & sets[200]) >= 0.8 * len(s | sets[200])}
    got = {r.doc_id: r.class_id for r in chosen_path_join.near_duplicates(docs_of(spark, many)).collect()}
    assert len(linked) > 380 and {got[i] for i in linked} == {0}


def test_join_keeps_links_between_members_that_no_pivot_has_part_in(spark):
    """A group of rings: neighbours on a ring are near copies, but few of them resemble any one member."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    many = []
    for ring in range(3):
        for k in range(90):
            text = list(base)
            for step in range(k, k + 5):
                at = 7 * (step % 40) + 5
                text[at] = f"edit{ring}-{step}"
            many.append(" ".join(text))
    sets = [five_grams(t) for t in many]
    parent = list(range(len(many)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(many)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in chosen_path_join.near_duplicates(docs_of(spark, many)).collect()}
    assert got == {i: root(i) for i in range(len(many))}


def test_join_counts_all_links_of_a_large_near_copy_group(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    many = []
    for k in range(300):
        copy = list(base)
        for at in rng.sample(range(10, 190), k % 3):
            copy[at] = f"edit{k}-{at}"
        many.append(" ".join(copy))
    sets = [five_grams(t) for t in many]
    want = {i: sum(len(s & o) >= 0.8 * len(s | o) for o in sets) - 1 for i, s in enumerate(sets)}
    got = {r.doc_id: r.links for r in chosen_path_join.near_duplicates(docs_of(spark, many)).collect()}
    assert min(want.values()) > 200 and got == want


def test_join_finds_pairs_of_short_texts(spark):
    rng = random.Random(8)
    many = []
    for k in range(500):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(8, 50))]
        near = [*text, "more"] if k % 2 else [*text[1:-1], "end"]
        many += [" ".join(text), " ".join(near)]
    sets = [five_grams(t) for t in many]
    want = {i: int(len(s & sets[i ^ 1]) >= 0.8 * len(s | sets[i ^ 1])) for i, s in enumerate(sets)}
    got = {r.doc_id: r.links for r in chosen_path_join.near_duplicates(docs_of(spark, many)).collect()}
    assert sum(want.values()) > 600 and got == want


def test_packing_places_every_piece_once(spark, texts):
    docs = docs_of(spark, texts)
    got = complement_packing.pack_documents(docs).toPandas()
    encode = complement_packing._encoder(complement_packing.VOCABULARY, complement_packing.RANKS)
    for doc_id, text in enumerate(texts):
        ids = [*encode(text or ""), 2]
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert list(mine.piece) == list(range(len(mine))) and mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 1024).all() and mine.length.max() <= 1024
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    assert complement_packing.pack_documents(docs.limit(0)).count() == 0


def test_ranks_give_the_ids_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(complement_packing.VOCABULARY))
    encode = complement_packing._encoder(complement_packing.VOCABULARY, complement_packing.RANKS)
    for text in ["", "Hola, ¿qué tal?\n\n x  y", "a<|endoftext|>b", "日本語 ünï 12345   ", "Ofthtioninor thswhere's don't", " " * 49_999, " " * 60_000 + "b", "a" * 60_000, " " * 2_000_000]:
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_counts_and_fills_well(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 1023) for _ in range(3000))
    used = Counter()
    plan = complement_packing.plan(counts)
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] += times
    assert used == counts
    gaps = []  # plain best-fit decreasing over single pieces
    for k in sorted(counts.elements(), reverse=True):
        at = bisect.bisect_left(gaps, k)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else 1024) - k)
    assert sum(t for _, t in plan) <= 1.005 * len(gaps)


def naive_entropy(s, width=20):
    return max(-sum(n / width * math.log2(n / width) for n in Counter(s[i : i + width]).values()) for i in range(len(s) - width + 1))


def test_secrets_equal_brute_force(spark):
    key = "Zx9Kq2Lm8Vb4Nc7Tr1Wy5Pd3"
    odd = [f"api_key = '{key}' end", "token: short", f"see {key} here", "AKIA" + "A1" * 9, "deadbeefdeadbeef12 00ff", "example_" + key, "", None, f"é😀 SECRET={key}﷐﷑ x", "ab1" * 10, f"password=secret={key}", "0123456789012345678901234567890", "path/to/some_file-name_2024_final"]
    got = {r.doc_id: r for r in entropy_secrets.secrets(docs_of(spark, odd)).collect()}
    python = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    for i, text in enumerate(odd):
        base = sorted((m.start(), k, n, m.end()) for k, (n, p, g, least) in enumerate(python) for m in re.finditer(p, text or "") if len(m[g]) >= least)
        assert [(s.start, s.order, s.kind, s.end) for s in got[i].found if s.kind != "entropy"] == base
        extra = []
        for m in re.finditer(entropy_secrets.CANDIDATE, text or ""):
            s = m[0]
            limits = entropy_secrets.CLASS_LIMITS
            limit = limits["hex"] if re.fullmatch("[0-9a-fA-F]+", s) else limits["lower"] if re.fullmatch("[a-z0-9/_=+-]+|[A-Z0-9/_=+-]+", s) else limits["mixed"]
            free = not any(a < m.end() and m.start() < b for a, _, _, b in base)
            if free and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and not re.search(entropy_secrets.ALLOWED, s) and naive_entropy(s) >= limit:
                extra.append((m.start(), m.end()))
        assert [(s.start, s.end) for s in got[i].found if s.kind == "entropy"] == extra
    assert [s.kind for s in got[2].found] == ["entropy"] and not got[5].found and [s.kind for s in got[9].found] == ["hex"]
    value = spark.createDataFrame([(key * 3,)], "s string").select(entropy_secrets.highest_entropy(F.col("s"))).first()[0]
    assert value == pytest.approx(naive_entropy(key * 3), abs=1e-9)


def test_entropy_of_a_very_long_candidate(spark):
    rng = random.Random(5)
    s = "".join(rng.choices(entropy_secrets.ALPHABET[:40], k=100_000)) + "98765+/_=-ABCDE" + "z1" * 500
    began = time.time()
    got = {r.doc_id: r for r in entropy_secrets.secrets(docs_of(spark, [f"see {s} here", "z" * 50_000 + "1"])).collect()}
    assert [(x.kind, x.start, x.end) for x in got[0].found] == [("entropy", 4, 4 + len(s))] and not got[1].found and time.time() - began < 60
    value = spark.createDataFrame([(s[-1100:],)], "s string").select(entropy_secrets.highest_entropy(F.col("s"))).first()[0]
    assert value == pytest.approx(naive_entropy(s[-1100:]), abs=1e-9)


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v], None) for i, v in enumerate(rng.normal(size=(600, 16)))]
    rows += [(i, [1.0] * 16, None) for i in range(600, 640)] + [(700, None, 1), (750, [0.0] * 16, 1), (800, [float("nan")] * 16, 1), (850, [1.0, None] * 8, 1), (900, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = hilbert_neighbours.neighbours(frame, F.col("hn_id") % 50 == 0).toPandas()
    vectors = {i: np.array(np.float32(v), float) for i, v, _ in rows[:640]}
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[q if q < 640 else 0]
        order = [int(ids[j]) for j in np.lexsort((ids, -s.round(12))) if ids[j] != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5
        hits += len(set(order) & set(mine.vec_id))
        total += 5
        if q == 600:
            assert list(mine.vec_id) == [601, 602, 603, 604, 605]
    assert hits >= 0.9 * total and set(got.query_id) == {int(i) for i in ids if i % 50 == 0}
    assert hilbert_neighbours.neighbours(frame.limit(0), F.col("hn_id") % 50 == 0).count() == 0


def test_neighbours_that_tie_by_scaling_come_by_id(spark):
    rng = np.random.default_rng(1)
    ray = rng.normal(size=8).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 8)).astype(np.float32))]
    rows += [(i, [float(x) for x in ray * np.float32(2.0 ** (i % 7 - 3))]) for i in range(200, 240)] + [(250, [float(x) for x in ray])] + [(300, [1.0, 2.0]), (301, [2.0, 4.0])]
    got = hilbert_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("hn_id") % 50 == 0).toPandas()
    of = lambda q: list(got[got.query_id == q].sort_values("rank").vec_id)
    assert of(250) == [200, 201, 202, 203, 204] and of(200) == [201, 202, 203, 204, 205] and of(300) == [301]
    assert got[got.query_id == 250].score.values == pytest.approx(1.0, abs=1e-12)


def test_hilbert_key_walks_neighbouring_cells():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_neighbours.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def labelled(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices("the quick brown fox jumps over lazy dogs while many birds sing near old rivers".split(), k=rng.randint(60, 90))) + "."
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = good()
        if bad:
            text = " ".join(w + "###" for w in text.split()) if i % 2 else "spam " * 70
        if i % 4 == 1:
            text += " you idiot scum"
        rows.append(text)
        labels.append((i, int(not bad), int(i % 4 == 1)))
    return [*rows, "", None], labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name, out in (("quality", quality_rules_ensemble.score(docs, quality_rules_ensemble.fit(docs, marks))), ("toxic", neighbour_toxicity.score(docs, neighbour_toxicity.fit(docs, marks)))):
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
        column = 1 if name == "quality" else 2
        held = [(got[x[0]].predicted, x[column]) for x in labels if got[x[0]].held_out]
        assert sum(a == b for a, b in held) >= 0.95 * len(held)
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    nothing = marks.limit(0)
    assert quality_rules_ensemble.score(docs, quality_rules_ensemble.fit(docs, nothing)).filter("score = 0.5").count() == len(rows)
    assert neighbour_toxicity.score(docs, neighbour_toxicity.fit(docs, nothing)).filter("predicted = 0").count() == len(rows)


def test_toxicity_neighbours_are_exact_and_blocks_are_skipped(monkeypatch):
    rng = random.Random(2)
    words = [["awful", "vile", "nasty", "rotten", *(f"bad{i}" for i in range(60))], ["sunny", "kind", "calm", "gentle", *(f"good{i}" for i in range(60))]]
    # examples of one kind stand together, so that bounds differ between blocks
    examples = [(i, Counter(rng.choices(words[i >= 500][(i // 64) * 4 % 32 :][:24], k=rng.randint(8, 60))), int(i < 500)) for i in range(1000)]
    index = neighbour_toxicity.build(examples, {0: 500, 1: 500})
    vectors = [dict(index.vector(c)) for _, c, _ in examples]
    read = Counter()
    monkeypatch.setattr(index, "lists", [type("Seen", (dict,), {"get": lambda self, b: (read.update([b]), dict.get(self, b))[1]})(x) for x in index.lists])
    for k in (1, 15):
        for query in (index.vector(Counter(rng.choices(words[j % 2], k=12))) for j in range(40)):
            every = sorted((-sum(w * v.get(t, 0.0) for t, w in query), e) for e, v in enumerate(vectors))
            got = index.nearest(query, k)
            assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in every[:k] if s < 0]
    assert sum(read.values()) < 0.9 * 80 * 12 * len({b for x in index.lists for b in dict.keys(x)})


def test_mix_targets_and_bounds(spark, texts):
    sources = ["a", "b", "c", None, "Z"]
    got = pareto_mixing.mix(docs_of(spark, texts, sources)).toPandas()
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[sources[i % 5]] += len(WORD.findall(t or ""))
    order = ["Z", "a", "b", "c", None]
    weight = dict(zip(order, (3, 1, 2, 3, 1), strict=True))
    target, free = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s in order:
        mine = got[got.source.isna() if s is None else got.source == s]
        assert mine.target.iloc[0] == pytest.approx(target[s]) and abs(mine.taken.sum() - target[s]) <= mine["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(texts)
    assert pareto_mixing.take(docs_of(spark, texts, sources)).columns == docs_of(spark, texts).columns


def test_line_templates(spark):
    plain = [f"Alpha beta gamma delta epsilon zeta number {i}" for i in range(4)]
    varied = [f"Dear reader please welcome {n} to our weekly letter" for n in ("anna", "bob", "carla", "dora")]
    many = ["\n".join([f"{'abcd'[i] * 3} stands in this text alone", plain[i], varied[i], "end"]) for i in range(4)] + ["", None, "unique words in this line", plain[0] + "\n" + plain[0]]
    got = {r.doc_id: r for r in line_templates.without_recurring_lines(docs_of(spark, many)).collect()}
    assert got[0].lt_drop == [] and got[0].text == many[0]
    assert all(got[i].lt_drop == [1, 2] for i in (1, 2, 3))
    assert got[4].text == "" and got[5].text is None and got[6].lt_drop == [] and got[7].lt_drop == [0, 1] and got[7].text == ""


@pytest.mark.parametrize("n", [30, 10_000])
def test_line_template_is_the_same_in_few_and_many_documents(spark, n):
    word = lambda i: chr(97 + i % 20) * 2 + chr(97 + i // 20)
    many = [f"Dear reader please greet {word(k % 200)} living near {word((k // 200 * 3 + k) % 200)} this week" for k in range(n)]
    got = line_templates.without_recurring_lines(docs_of(spark, many)).collect()
    assert {r.doc_id for r in got if r.lt_drop != [0]} == {0}


def test_line_template_counts_documents(spark):
    many = ["\n".join(["Dear reader please greet anna this week"] * 3)] + [f"Dear reader please greet {n} this week" for n in ("bob", "carla", "dora")]
    got = {r.doc_id: r.lt_drop for r in line_templates.without_recurring_lines(docs_of(spark, many)).collect()}
    assert got == {0: [1, 2], 1: [0], 2: [0], 3: [0]}


def test_short_recurring_lines(spark):
    lines = ["All rights reserved.", "Read more", "Privacy policy", "Page {} of", "call {}", "1 2", "end"]
    many = ["\n".join([f"{'abcd'[i] * 3} stands in this text alone", *(x.format(i) for x in lines)]) for i in range(4)]
    got = {r.doc_id: r.lt_drop for r in line_templates.without_recurring_lines(docs_of(spark, many)).collect()}
    assert got == {0: [], 1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4]}


def test_licence_rules(spark):
    bsd = [licence_sentences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is")]
    many = [". ".join(bsd) + ".", ". ".join(bsd[:3]) + ".", "Released under the MIT License.", "x.\nLicensed under the Apache\nLicense, Version 2.0. More", "no such thing", "", None, "text\nLicensed under CC BY-NC 4.0.\ntext"]
    got = {r.doc_id: r.found for r in licence_sentences.licences(docs_of(spark, many)).collect()}
    assert [got[i] for i in range(8)] == [["BSD-3-Clause"], ["BSD-2-Clause"], ["MIT"], ["Apache-2.0"], [], [], [], ["CC-BY-NC-4.0"]]
    assert all(re.search(licence_sentences.CUE, s) for s in licence_sentences.SENTENCES.values())


def test_licences_of_long_and_mixed_texts(spark):
    line = {k: v + ".\n" for k, v in licence_sentences.SENTENCES.items()}
    mixed = "".join(line[k] for k in ("apache-notice", "mit-notice", "apache-use", "apache-copy", "bsd-grant", "apache-basis", "bsd-source", "bsd-binary", "bsd-as-is"))
    many = [line["mit-notice"] * 20_000, (line["mit-notice"] + line["cc-by"]) * 5_000, mixed, "".join(line[k] for k in ("bsd-grant", "bsd-binary", "bsd-source"))]
    got = {r.doc_id: r for r in licence_sentences.licences(docs_of(spark, many)).collect()}
    assert len(got[0].sentences) == 20_000 and [sorted(got[i].found) for i in range(4)] == [["MIT"], ["CC-BY-4.0", "MIT"], ["Apache-2.0", "BSD-2-Clause", "MIT"], []]
    assert got[2].sentences == ["apache-notice", "mit-notice", "apache-use", "apache-copy", "bsd-grant", "apache-basis", "bsd-source", "bsd-binary", "bsd-as-is"]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind} as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind} for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_licence_headers_as_published(spark):
    """Public headers, wrapped as usual, plain and behind comment marks."""
    headers = [
        (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"),
        (GNU.format(what="program", mark=":", comma=",", kind="General Public License", version=3), "GPL-3.0"), (GNU.format(what="program", mark=";", comma=";", kind="General Public License", version=2), "GPL-2.0"),
        (GNU.format(what="library", mark=";", comma=";", kind="Lesser General Public License", version="2.1"), "LGPL-2.1"), (GNU.format(what="library", mark=":", comma=",", kind="Lesser General Public License", version=3), "LGPL-3.0"),
        (GNU.format(what="program", mark=":", comma=",", kind="Affero General Public License", version=3), "AGPL-3.0"),
    ]
    many, want = [], []
    for text, name in headers:
        for before in ("", "# ", "// ", " * ", "REM ", "dnl "):
            many.append("first line\n" + "\n".join((before + line).rstrip() for line in text.split("\n")) + "\nlast line")
            want.append([name])
    many += ["It is compatible with the Apache License, version 2.0, in our view.", "This is not licensed under the MIT license.", "The MIT License (MIT)\n\nCopyright"]
    want += [[], [], ["MIT"]]
    got = {r.doc_id: r for r in licence_sentences.licences(docs_of(spark, many)).collect()}
    assert [got[i].found for i in range(len(many))] == want
    assert got[1].sentences == ["apache-notice", "apache-use", "apache-copy", "apache-basis"]


def test_statistics_equal_brute_force(spark, texts):
    many = [*texts, "a b c a b c", "x\nx\n\n\nx \nx", "# $ % & | < > *", "a a a a a", "é\x0bé é"]
    got = {r.doc_id: r for r in risk_controlled_rules.statistics(docs_of(spark, many)).collect()}
    for i, t in enumerate(many):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t
        assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_binomial_bound_and_cutoffs(spark):
    for k, n, risk in ((0, 100, 0.05), (3, 400, 0.02), (9, 200, 0.1)):
        tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        assert risk_controlled_rules.refuted(k, n, risk, tail * 1.001) and not risk_controlled_rules.refuted(k, n, risk, tail * 0.999)
    assert not risk_controlled_rules.refuted(0, 0, 0.05, 0.5)
    rows, labels = labelled(spark)
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = risk_controlled_rules.judge(docs, marks, risk=0.9, delta=0.5).collect()
    assert not any(r.kept for r in out if r.doc_id < 300 and r.doc_id % 6 == 3) and all(not r.kept for r in out if r.base_failed)
    assert risk_controlled_rules.judge(docs, marks.limit(0)).filter(F.col("kept") == F.col("base_failed")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert got[columns].sort_values("doc_id").astype(str).values.tolist() == want[columns].sort_values("doc_id").astype(str).values.tolist()


def test_empty_documents(spark):
    none = docs_of(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert chosen_path_join.near_duplicates(none).count() == 0
    assert entropy_secrets.secrets(none).count() == 0
    assert pareto_mixing.mix(none).count() == 0
    assert line_templates.without_recurring_lines(none).count() == 0
    assert licence_sentences.licences(none).count() == 0
    assert risk_controlled_rules.judge(none, labels).count() == 0
    assert quality_rules_ensemble.score(none, quality_rules_ensemble.fit(none, labels)).count() == 0
    assert neighbour_toxicity.score(none, neighbour_toxicity.fit(none, labels)).count() == 0


def test_pipeline_runs_and_keeps_document_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_sha_of_no_span(spark):
    row = QUERIES["op4_secret_scan"](spark, DATA).filter("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
