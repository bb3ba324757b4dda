"""The requirement stream against the batch rules: files in turn, restarts, late and odd events."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pyarrow as pa
from tutorlens.operators import audit
from tutorlens.sources import fixtures as fx
from tutorlens.streaming import requirements

EVENTS = "event_id long, user_id long, content_id int, ts timestamp, score double, event string"
START = dt.datetime(2024, 1, 1)


def world(spark):
    contents = spark.createDataFrame([(c, c % 14, ["básico", "intermedio", "avanzado"][c % 3], c % 2 == 0) for c in range(28)], "content_id int, topic int, difficulty string, is_investment_related boolean")
    users = spark.createDataFrame([(u, [None, "bajo", "alto"][u % 3], [None, "ninguna", "básica"][u % 3]) for u in range(8)], "user_id long, level string, experience string")
    topics = fx.topic_concepts(spark)
    return users, contents, topics, audit.content_needs(contents, topics, fx.INVESTMENT_CONCEPTS)


def batch(events, users, contents, topics, needs):
    seen = audit.first_seen(events, contents.join(topics, "topic").select("content_id", "concept_id"))
    return {tuple(r) for r in audit.eligibility(events, users, contents, seen, needs).collect()}


def drawn(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user, at = rng.choice([0, 1, 2, 3, 3, 3, 3, 99, None]), START + dt.timedelta(seconds=rng.randrange(0, 4 * 86400, 97), microseconds=rng.choice([0, 1]))
        rows.append((i, user, rng.choice([*range(28), 777, None]), at, 0.5, rng.choice(["viewed", "viewed", "completed", "disliked", None])))
    return rows


def tables_in_turn(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/part{k}")


def test_stream_equals_batch_with_files_in_turn(spark, tmp_path):
    """Time moves from file to file, so state is read back between batches; ties in time, repeated pairs, unknown users and
    contents, null users and events of no kind are among the rows."""
    rows = sorted(drawn(900, 1), key=lambda r: (r[3], r[0]))
    tables_in_turn(spark, tmp_path, [rows[k : k + 225] for k in range(0, 900, 225)])
    facts = world(spark)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    got = requirements.replay(stream, lambda e: requirements.facts(e, *facts, lateness="1 second"), str(tmp_path / "out")).collect()
    assert len(got) == len({r.event_id for r in got})
    assert {tuple(r) for r in got} == batch(spark.createDataFrame(rows, EVENTS), *facts) and any(r.r4 for r in got) and not all(r.r4 for r in got)


def test_shuffled_events_wait_for_their_turn(spark, tmp_path):
    rows = drawn(400, 2)
    tables_in_turn(spark, tmp_path, [rows])
    facts = world(spark)
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/part*")
    got = requirements.replay(stream, lambda e: requirements.facts(e, *facts), str(tmp_path / "out")).collect()
    assert {tuple(r) for r in got} == batch(spark.createDataFrame(rows, EVENTS), *facts)


def test_late_events_are_left_out_and_change_nothing(spark, tmp_path):
    """A restart between the files: what was told stands, an event behind the watermark is dropped."""
    at = lambda days: START + dt.timedelta(days=days)
    early = [(1, 1, 0, at(1), 0.5, "viewed"), (2, 1, 14, at(3), 0.5, "viewed")]
    late = [(3, 1, 1, at(0.5), 0.5, "viewed"), (4, 1, 17, at(4), 0.5, "viewed")]
    timeless = [(5, 1, 2, None, 0.5, "viewed")]
    tables_in_turn(spark, tmp_path, [early, late + timeless])
    facts = world(spark)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    got = requirements.replay(stream, lambda e: requirements.facts(e, *facts), str(tmp_path / "out")).collect()
    assert {tuple(r) for r in got} == batch(spark.createDataFrame(early + late[1:], EVENTS), *facts)


def test_neighbouring_users_share_a_key_and_nothing_else(spark, tmp_path):
    """200 users in turn hold four keys of state. Users of one key meet the same concepts at different times; ids that doubles
    cannot hold, negative ids and null users are among them."""
    base = 2**60 + 1  # not a multiple of 64
    users = [*range(base, base + 200), -1, -64, -65, 2**62, None]
    rng = random.Random(3)
    rows = [(i, users[i % len(users)], rng.randrange(28), START + dt.timedelta(minutes=rng.randrange(4 * 1440)), 0.5, rng.choice(["viewed", "viewed", "disliked", None])) for i in range(4 * len(users))]
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    tables_in_turn(spark, tmp_path, [rows[::2], rows[1::2]])
    known = spark.createDataFrame([(u, [None, "bajo", "alto"][u % 3], [None, "ninguna", "básica"][u % 3]) for u in users[:-2]], "user_id long, level string, experience string")
    facts = known, *world(spark)[1:]
    keys = {r.key for r in requirements.facts(spark.createDataFrame(rows, EVENTS).filter(f"user_id between {base} and {base + 199}"), *facts).select("key").distinct().collect()}
    assert keys == {u >> 6 for u in range(base, base + 200)} and len(keys) == 4
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/part*")
    got = requirements.replay(stream, lambda e: requirements.facts(e, *facts, lateness="10 days"), str(tmp_path / "out")).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == batch(spark.createDataFrame(rows, EVENTS), *facts)


def test_first_meetings_and_lacks_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    concepts = [-(2**31), -1, 0, 5, 2**31 - 1]
    rows = [(int(rng.integers(0, 70)), bool(rng.random() < 0.9), int(rng.integers(0, 50)), [concepts[j] for j in rng.integers(0, 5, rng.integers(0, 4))], [concepts[j] for j in rng.integers(0, 5, rng.integers(0, 2))]) for _ in range(300)]
    table = pa.table({"user": [r[0] for r in rows], "known": [r[1] for r in rows], "at": [r[2] for r in rows], "need3": pa.array([r[3] for r in rows], pa.list_(pa.int32())), "gives": pa.array([r[4] if r[1] else [] for r in rows], pa.list_(pa.int32()))})
    met = {}
    for user, known, at, _, gives in rows:
        for c in gives if known else []:
            met[user % 64, c] = min(at, met.get((user % 64, c), at))
    got = requirements.first_meetings(*requirements.listed(table, "gives"))
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [(*k, met[k]) for k in sorted(met)]
    assert requirements.lacks(table, "need3", got).tolist() == [any(not known or met.get((user % 64, c), at) >= at for c in need) for user, known, at, need, _ in rows]
    none = tuple(c[:0] for c in got)
    assert requirements.lacks(table, "need3", none).tolist() == [len(r[3]) > 0 for r in rows]
