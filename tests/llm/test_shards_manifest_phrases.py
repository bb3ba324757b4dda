"""Sharding, manifest and phrase mining against plain loops, with odd rows, copies, long texts and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import DATA

from tutorlens.llm import jump_shards, merkle_manifest, phrase_mining
from tutorlens.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, rank string, n string, grp string, digest string"


def docs_of(spark, rows):
    """rows (doc_id, text, lang, source); columns whose names the operators make themselves ride along."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "x", None, "x", "x", None) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 3))) for _ in range(30)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ", "]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["en", "fr", None, "und"]), rng.choice(["a", "b", "b", None, "", "é"])) for i in range(90)]
    rows += [(7, None, "en", "a"), (7, "", "en", "a"), (7, rows[7][1], "en", "b"), (None, "null id", None, None), (None, "null id", None, None), (None, None, None, None)]
    rows += [(2**53 + 1, "big id\n", "en", "b"), (-5, "negative\nid", "en", "b"), (91, text(30000), "en", "c"), (92, "X" * 70000, "en", "c"), (93, "\n \t.", "en", "c")]
    return rows + [(500, "Copy Of A Copy\n", "en", "b")] * 9000


def jump_in_whole_numbers(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = np.array([0, 1, 2**60 - 1, 12345678901234567, *range(1000, 1400)], np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert jump_shards.jump(keys, n).tolist() == [jump_in_whole_numbers(int(k), n) for k in keys]


def test_shards_of_odd_rows(spark, odd):
    got = jump_shards.assign(docs_of(spark, odd), 24).collect()
    key = lambda i: int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump_in_whole_numbers(key(i), 24), jump_in_whole_numbers(key(i), 25)) for i, t, _, _ in odd)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = jump_shards.assign(docs_of(spark, odd[::-1]).repartition(7), 24).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_appended_shards_take_their_share_only(spark):
    docs = docs_of(spark, [(i, "", "en", "a") for i in range(5000)])
    moved = jump_shards.moves(docs, 24, 30).collect()
    assert all(24 <= r.grown_shard < 30 for r in moved) and abs(len(moved) / 5000 - 6 / 30) < 0.03
    sizes = Counter(r.shard for r in jump_shards.assign(docs, 24).collect())
    assert len(sizes) == 24 and max(sizes.values()) < 1.4 * 5000 / 24


def test_shard_files_hold_every_row(spark, odd, tmp_path):
    jump_shards.write_shards(docs_of(spark, odd), str(tmp_path / "out"), 6, files_a_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd) and {p.name for p in Path(tmp_path / "out").glob("shard=*")} <= {f"shard={i}" for i in range(6)}
    assert set(back.columns) == set(docs_of(spark, odd[:1]).columns)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Levels of digests, and the path (siblings before and after, level by level) of every leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            i //= 3
        paths.append(path)
    return levels, paths


def told(i, s, lang, n, t):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, lang, n, t)))


def manifest_by_loop(rows):
    groups = defaultdict(list)
    for i, t, lang, s in rows:
        n = None if t is None else len(t)
        other = told(i, s, lang, n, t.replace("\n", "")) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else None
        groups[s].append((i is not None, i or 0, told(i, s, lang, n, t), other, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: (sorted(groups[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])])) for s in order}
    tops, top_paths = tree([built[s][1][-1][0] for s in order])
    for at, s in enumerate(order):
        members, levels, paths = built[s]
        for (_, _, leaf, other, i), path in zip(members, paths, strict=True):
            path = path + top_paths[at]
            h = other or leaf
            for before, after in path:
                h = sha(before + h + after)
            yield i, leaf, levels[-1][0], tops[-1][0], sha("".join(a + b for a, b in path)), h, h == tops[-1][0]


def manifest(docs):
    F = merkle_manifest.F
    out = merkle_manifest.proofs(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x.before, x.after)), ""), 256).alias("proof")
    fold = merkle_manifest.folded(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("fold")
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.fold, r.fold == r.root) for r in out.select("doc_id", "leaf", "subroot", "root", proof, fold).collect()]


def test_manifest_of_odd_rows(spark, odd):
    got, want = Counter(manifest(docs_of(spark, odd).repartition(3))), Counter(manifest_by_loop(odd))
    assert got == want and len({x[-1] for x in got}) == 2


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [27], [28], [26, 1, 730], [3] * 40])
def test_manifest_of_sizes_around_buckets(spark, sizes):
    rows = [(1000 * s + i, f"text\n{i}", "en", f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    assert Counter(manifest(docs_of(spark, rows))) == Counter(manifest_by_loop(rows))


def test_manifest_nodes_cover_their_leaves(spark):
    leaves = merkle_manifest.ranked(docs_of(spark, [(i, "t", "en", "a") for i in range(100)]).selectExpr("'g' AS grp", "doc_id", "sha2(string(doc_id), 256) AS digest"), ["doc_id"])
    bands = merkle_manifest.build(leaves.selectExpr("grp", "total", "rank AS lo", "rank + 1 AS hi", "digest"), 100, [])
    got = Counter((r.level, r.lo, r.hi, r.digest) for r in merkle_manifest.nodes(bands).collect())
    levels, _ = tree([sha(str(i)) for i in range(100)])
    want = Counter((k, i * 3**k, min(100, (i + 1) * 3**k), d) for k, level in enumerate(levels) for i, d in enumerate(level))
    assert got == want


def phrases_by_loop(rows, threshold, top):
    f, n = Counter(), Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= threshold:
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), p, left, right))
    for lang, held in found.items():
        kept = [x for x in held if not any(len(y[3]) > len(x[3]) and x[3] in (y[3][:2], y[3][1:]) and 100 * -y[1] >= 50 * -x[1] for y in held)]
        for rank, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top], 1):
            yield lang, rank, " ".join(p), -a, left, right, n[lang], -s


@pytest.mark.parametrize(("threshold", "top"), [(10, 2000), (2, 7)])
def test_phrases_of_odd_rows(spark, odd, threshold, top, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLICE_BYTES", 2000)
    monkeypatch.setattr(phrase_mining, "BUFFER", 500)
    rows = [*odd, (600, "Émile Zola\x0bémile ÉMILE x y\x1fz a b c. A B C! a  b\tc", None, "a")] * 2
    got = Counter(map(tuple, phrase_mining.collocations(docs_of(spark, rows), threshold, top).collect()))
    assert got == Counter(phrases_by_loop(rows, threshold, top)) and got


def test_summaries_keep_what_is_frequent_in_any_pieces():
    rng = np.random.default_rng(3)
    stream = np.concatenate([np.repeat(np.arange(200, dtype=np.uint64), 10), rng.integers(1000, 10**6, 20000).astype(np.uint64)])
    rng.shuffle(stream)
    for pieces in (1, 7, 60):
        summary = phrase_mining.MisraGries(len(stream) // 10 + 1)
        for piece in np.array_split(stream, pieces):
            summary.add(*[[x] for x in phrase_mining.merged([piece], [np.ones(len(piece), np.int64)])])
            assert len(summary.keys) <= summary.capacity
        assert summary.taken < 10 and set(range(200)) <= set(summary.at_least(10).tolist()) and (pieces == 1 or summary.taken > 0)


def test_sent_summaries_come_back_whole():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 3000, dtype=np.uint64))
    counts = np.arange(1, len(keys) + 1)
    rows = phrase_mining._sent(keys, counts, 77).to_pylist()
    back = [phrase_mining._received(r["keys"], r["counts"]) for r in rows]
    assert np.array_equal(np.concatenate([k for k, _ in back]), keys) and np.array_equal(np.concatenate([c for _, c in back]), counts)
    assert [r["part"] for r in rows] == sorted({int(k) >> 32 for k in keys} and {(int(k) >> 32) * 77 >> 32 for k in keys})


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "", "en", "a")]).limit(0)
    assert jump_shards.assign(none).count() == 0 and manifest(none) == [] and phrase_mining.collocations(none).count() == 0
    assert phrase_mining.collocations(docs_of(spark, [(1, None, None, None)])).count() == 0


@pytest.mark.parametrize("name", ["op11_jump_sharding", "op12_merkle_manifest", "op13_phrase_collocations"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert Counter(map(tuple, got.itertuples(index=False))) == Counter(map(tuple, want.itertuples(index=False))) and len(want)
