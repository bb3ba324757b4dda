"""Close texts by blocks against all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tutorlens.operators import closeness, scorers
from tutorlens.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"p{i}" for i in range(80)], k=20)) for _ in range(60)]
    longer = [" ".join(rng.choices([f"p{i}" for i in range(80)], k=400)) for _ in range(20)]
    near = [" ".join([*base[0].split(), f"own{i}"]) for i in range(30)]
    rows = list(enumerate([*base, *base[:4], *longer, *near, "", "la", "único", "solo", "solo solo"]))
    return spark.createDataFrame(rows, "content_id int, text string")


@pytest.mark.parametrize("size", [200, 1 << 21])
def test_close_texts_equal_all_pairs_above_the_threshold(spark, texts, monkeypatch, size):
    monkeypatch.setattr(closeness, "LEAST", size)
    own = texts.groupBy("text").agg(F.min("content_id").alias("content_id"))
    every = {(r.a, r.b): r.sim for r in scorers.similarity(scorers.tfidf(own)).filter("a < b").collect()}
    for least in (0.3, 0.9):
        got = closeness.close_texts(texts, least)
        assert dict(got.dtypes) == {"a": "int", "b": "int", "sim": "double"}
        found, want = {(r.a, r.b): r.sim for r in got.collect()}, {k: v for k, v in every.items() if v >= least}
        assert found.keys() == want.keys() and want and all(abs(found[k] - want[k]) < 1e-9 for k in want)
        assert got.count() == len(want)


def test_rows_met_in_stretches_come_once(spark, texts, monkeypatch):
    """A row whose meetings pass what is held at once is asked in several stretches; each of its pairs is summed once."""
    made = []
    monkeypatch.setattr(closeness, "staged", lambda frame, name, of=closeness.staged: made.append((name, of(frame, name))) or made[-1][1])
    want = closeness.close_texts(texts, 0.3).collect()
    row = dict(made)["blocks"].collect()
    block = closeness._Block({c: closeness._unpacked(closeness.pa.py_buffer(bytes(row[0][c])), kind) for c, kind in closeness._BLOCK.items()}, dict(made)["first"].count())
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(closeness, "MEETINGS", most)
        got = [(x["a"], x["b"]) for part in closeness._met(block, block, 0.3) for x in part.to_pylist()]
        assert len(row) == 1 and len(got) == len(set(got)) and set(got) == {(r.a, r.b) for r in want}


def _sent(spark) -> int:
    """Rows that all stages so far gave to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_are_not_shuffled(spark, tmp_path):
    """400 texts that all meet, of which few are close: what is shuffled and staged grows with the texts, not with their 79,800 pairs."""
    rng = random.Random(6)
    base = rng.choices([f"p{i}" for i in range(300)], k=40)
    copies = [(i, " ".join([*base, *rng.choices([f"q{j}" for j in range(500)], k=8)])) for i in range(400)]
    spark.createDataFrame(copies, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = _sent(spark)
    close = QUERIES["j16_close_texts"](spark, str(tmp_path)).count()
    assert close < 79_800 and 400 < _sent(spark) - before < 5_000


def test_query_matches_sql_on_odd_rows(spark, tmp_path):
    """Ids of several texts, texts of several ids, nulls and texts without words."""
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    words = [f"wort{i}" for i in range(30)]
    rows = [(i, " ".join(words[i % 5 : i % 5 + 20])) for i in range(10)] + [(3, " ".join(words[2:30])), (3, "anders ganz"), (3, None), (None, "ohne nummer"), (20, None), (21, ""), (22, "la el"), (23, "Ñandú ñandú 12 x"), (24, "ñandú 12 ñandú"), (25, " ".join(words[2:29])), (26, "anders ganz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r.a, r.b): r.sim for r in QUERIES["j16_close_texts"](spark, str(tmp_path)).collect()}
    want = {(a, b): s for a, b, s in con.sql(ORACLES["j16_close_texts"]).select("a", "b", "sim").fetchall()}
    assert got == pytest.approx(want, abs=1.1e-6) and want
