"""Lists walked only as far as needed against the ranking of every user with every content."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tutorlens.operators import graph, metrics, scorers, walk
from tutorlens.sources.files import staged


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    frame = lambda rows, kind: staged(spark.createDataFrame(rows, kind), "world")
    users = frame([(u,) for u in range(12)], "user_id long")
    contents = frame([(c, c % 3, "básico") for c in [*range(0, 60, 3), 500, 501]], "content_id int, topic int, difficulty string")
    ids = [*range(0, 60, 3), 500, 501]
    train = frame([(rng.choice(range(9)), rng.choice(ids[: rng.choice([3, 22])]), rng.random()) for _ in range(150)] + [(9, c, 0.9) for c in ids] + [(0, 0, 0.7)] * 5, "user_id long, content_id int, score double")
    test = frame([(rng.choice(range(12)), rng.choice(ids), rng.random()) for _ in range(60)] + [(11, 3, 0.1)], "user_id long, content_id int, score double")
    required = frame([(c, r) for c in ids for r in rng.sample(range(6), rng.choice([0, 0, 1, 2]))], "content_id int, required_concept_id int")
    mastered = frame([(u, c) for u in range(0, 12, 2) for c in rng.sample(range(6), 3)] + [(9, c) for c in range(6)], "user_id long, concept_id int")
    texts = frame([(c, " ".join(rng.choices(["uno", "dos", "tres", "cuatro", "cinco", "seis", "la", f"solo{c}"], k=12))) for c in ids for _ in range(2)], "content_id int, text string")
    return {"users": users, "contents": contents, "train": train, "test": test, "required": required, "mastered": mastered, "texts": texts}


def rows(frame):
    names = sorted(frame.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else sorted(v) if isinstance(v, list) else v
    return sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=str)


def both(w, scores, walked, seen):
    """per_user() of the ranked grid and of the walked lists."""
    columns = ["user_id", "raw_hits", "raw_dcg", "raw_n", "raw_bad", "post_hits", "post_dcg", "post_n", "walked", "rejected", "shown", "n_rel"]
    grid = metrics.per_user(scores, w["train"] if seen else None, w["test"], w["required"], w["mastered"])
    return rows(grid.select(columns)), rows(walk.per_user(walked).select(columns))


def states(w, seen=True):
    return walk.states(w["users"], w["train"] if seen else None, w["mastered"], w["test"]), walk.catalog(w["contents"], w["required"])


@pytest.mark.parametrize("stretch", [1, 3, 8, 100])
@pytest.mark.parametrize("seen", [True, False])
def test_popular_walk_equals_the_grid(world, stretch, seen):
    w = world
    users, items = states(w, seen)
    walked = walk.walk_shared(users, scorers.popular_items(w["train"], items), stretch=stretch)
    # user 9 has seen everything and has no candidate: no row in the grid, an empty list here
    want, got = both(w, scorers.popularity(w["train"], w["users"], w["contents"]), walked, seen)
    assert [r for r in got if seen is False or r[columns_at("walked")] or r[columns_at("post_n")]] == want


def columns_at(name):
    return sorted(["user_id", "raw_hits", "raw_dcg", "raw_n", "raw_bad", "post_hits", "post_dcg", "post_n", "walked", "rejected", "shown", "n_rel"]).index(name)


def test_own_rankings_equal_the_grid(world):
    w = world
    users, items = states(w)
    for scores, ranked in (
        (scorers.random_topk(w["users"], w["contents"], w["train"]), scorers.random_rankings(users, items)),
        (scorers.tfidf_scores(w["train"], w["users"], w["contents"], w["texts"]), scorers.tfidf_rankings(users, w["train"], items, w["texts"])),
    ):
        want, got = both(w, scores, walk.walk_own(ranked), True)
        assert [r for r in got if r[columns_at("walked")]] == want


def test_recommended_lists_equal_the_grid(world):
    w = world
    users, items = states(w)
    walked = walk.walk_shared(users, scorers.popular_items(w["train"], items), stretch=4)
    want = metrics.recommend(scorers.popularity(w["train"], w["users"], w["contents"]), w["train"], w["required"], w["mastered"], w["contents"])
    assert rows(walk.recommended(walked, w["contents"])) == rows(want)


def test_no_user_and_no_content(world, spark):
    w = world
    users, items = states(w)
    none = walk.walk_shared(users.limit(0), scorers.popular_items(w["train"], items), stretch=2)
    assert none.count() == 0
    bare = walk.walk_shared(users, scorers.popular_items(w["train"], items.limit(0)))
    assert {len(r.walked) for r in bare.collect()} == {0} and bare.count() == 12


def test_similarity_matrix_equals_the_join(world, monkeypatch):
    monkeypatch.setattr(scorers, "CHUNK", 2)
    weights = scorers.tfidf(world["texts"])
    ids = sorted(r.content_id for r in world["contents"].collect())
    at = weights.join(world["contents"].sparkSession.createDataFrame(list(enumerate(ids)), "at int, content_id int"), "content_id")
    got = {(ids[r.a], ids[r.b]): r.sim for r in scorers.similarity_matrix(at, len(ids)).collect()}
    want = {(r.a, r.b): r.sim for r in scorers.similarity(weights).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(ValueError):
        scorers.similarity_matrix(at, scorers.MOST_DENSE + 1)


def test_close_pairs_equal_all_pairs_above_the_threshold(world, spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"p{i}" for i in range(80)], k=20)) for _ in range(30)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*base, *base[:4], base[0] + " extra", "", "la", "único"])], "content_id int, text string")
    weights = scorers.tfidf(texts)
    for least in (0.3, 0.7, 0.95):
        got = {(r.a, r.b): r.sim for r in scorers.close_pairs(weights, least).collect()}
        want = {(r.a, r.b): r.sim for r in scorers.similarity(weights).filter((F.col("a") < F.col("b")) & (F.col("sim") >= least)).collect()}
        assert got.keys() == want.keys() and got and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_close_pairs_in_many_blocks_move_few_rows(spark, monkeypatch):
    """Copies that differ in a word and texts that share one rare word only: all close pairs come, pairs that a bound rules out
    are not summed, and a row goes to blocks, not to each of its pairs."""
    monkeypatch.setattr(scorers, "ROUGH", 400)
    monkeypatch.setattr(scorers, "EXACT", 100)
    rng, tables = random.Random(3), {}
    base = rng.choices([f"p{i}" for i in range(300)], k=40)
    copies = [" ".join([*base, f"own{i}"]) for i in range(40)]
    others = [" ".join([f"shared{i % 4}", *rng.choices([f"q{j}" for j in range(3000)], k=30)]) for i in range(80)]
    weights = staged(scorers.tfidf(spark.createDataFrame(list(enumerate([*copies, *others])), "content_id int, text string")), "test")
    monkeypatch.setattr(scorers, "staged", lambda frame, name: tables.setdefault((name, len(tables)), staged(frame, name)))
    got = {(r.a, r.b): r.sim for r in scorers.close_pairs(weights, 0.8).collect()}
    want = {(r.a, r.b): r.sim for r in scorers.similarity(weights).filter("a < b and sim >= 0.8").collect()}
    assert got.keys() == want.keys() and len(want) == 780 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    count = {}
    for (name, _), table in tables.items():
        count.setdefault(name, []).append(table)
    assert count["near"][0].count() == 780 and count["pairs"][0].count() < 1500
    for placed in count["placed"]:
        cells = placed.selectExpr("low", "high", "explode(array(a, b)) as id").distinct()
        assert cells.select("low", "high").distinct().count() > 1 and cells.count() < placed.count()


def test_model_table_makes_each_scenario_once(spark, monkeypatch):
    """Ten models share two splits, two tables of states and two catalogs."""
    from conftest import DATA

    from tutorlens.plans import registry

    made, states = [], []
    monkeypatch.setattr(registry, "staged", lambda frame, name: made.append(name) or staged(frame, name))
    monkeypatch.setattr(registry.walk, "states", lambda *a, of=walk.states: states.append(1) or of(*a))
    monkeypatch.setattr(registry, "_figures", lambda users: users.agg(F.count("*").alias("users_all")))
    for rank in ("_popular", "_random", "_similar", "_told", "_ridge", "_ridge_new", "_machine", "_machine_new"):
        monkeypatch.setattr(registry, rank, lambda users, items, train, w: users)
    rows = registry.QUERIES["g14_model_table"](spark, DATA).collect()
    assert len(rows) == 10 and len({(r.model, r.scenario) for r in rows}) == 10 and all(r.users_all > 0 for r in rows)
    assert made.count("split") == 2 and made.count("states") == 2 and len(states) == 2
