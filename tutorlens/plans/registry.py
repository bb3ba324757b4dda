"""All registered queries of the reference's own operators and their DuckDB forms, by name. Names carry the ids of
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, closeness, enrich, factors, graph, metrics, pages, profiles, scorers, split, walk
from ..sources import fixtures as fx
from ..sources.files import staged
from ..streaming import exposure, requirements

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql follows the fixture tables in a WITH clause."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {fx.CTES}{sql}"
        return f

    return add


# ---- splits, graph, evaluation ------------------------------------------------------------------------------------
SPLIT = """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, content_id ORDER BY ts, event_id) AS rn FROM interactions) WHERE rn = 1),
split AS (SELECT event_id, user_id, content_id, ts, score, event, CASE WHEN n > 1 AND late <= greatest(1, round(n * 0.2)) THEN 'test' ELSE 'train' END AS side FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS late FROM firsts)),
cold_users AS (SELECT DISTINCT user_id FROM interactions WHERE (user_id * 618034 + 42 * 104729) % 1000003 < 100000),
csplit AS (SELECT i.*, CASE WHEN c.user_id IS NULL THEN 'pool' ELSE 'test' END AS side FROM interactions i LEFT JOIN cold_users c USING (user_id)),
required AS (SELECT DISTINCT content_id, prerequisite_concept_id AS required_concept_id FROM ccm JOIN prerequisites USING (concept_id)),
train AS (SELECT * FROM {table} WHERE side = '{train}'), test AS (SELECT * FROM {table} WHERE side = 'test'),
mastered AS (SELECT DISTINCT user_id, concept_id FROM train JOIN ccm USING (content_id) WHERE event IN ('completed', 'quiz_passed')),
asked AS ({asked})"""
WARM = SPLIT.format(table="split", train="train", asked="SELECT user_id FROM users")
COLD = SPLIT.format(table="csplit", train="pool", asked="SELECT user_id FROM cold_users")
EVAL = """, unseen AS (SELECT s.* FROM scores s {seen}),
missing AS (SELECT DISTINCT u.user_id, u.content_id FROM unseen u JOIN required r USING (content_id) WHERE NOT EXISTS (SELECT 1 FROM {known} m WHERE m.user_id = u.user_id AND m.concept_id = r.required_concept_id)),
qualified AS (SELECT u.*, m.user_id IS NULL AS q FROM unseen u LEFT JOIN missing m USING (user_id, content_id)),
ranked AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(q::INT) OVER (PARTITION BY user_id ORDER BY score DESC, content_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM qualified WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, content_id)),
rel AS (SELECT DISTINCT user_id, content_id FROM test WHERE score >= 0.5),
flagged AS (SELECT r.*, CASE WHEN q THEN qb + 1 END AS prn, e.user_id IS NOT NULL AS hit FROM ranked r LEFT JOIN rel e USING (user_id, content_id)),
stats AS (SELECT user_id, count(*) FILTER (rn <= 5 AND hit) rh, coalesce(sum(1 / log2(rn + 1)) FILTER (rn <= 5 AND hit), 0) rd, count(*) FILTER (rn <= 5) rl, count(*) FILTER (rn <= 5 AND NOT q) rb,
  count(*) FILTER (prn <= 5 AND hit) ph, coalesce(sum(1 / log2(prn + 1)) FILTER (prn <= 5 AND hit), 0) pd, count(*) FILTER (prn <= 5) pl, count(*) FILTER (qb < 5) wk, count(*) FILTER (qb < 5 AND NOT q) rj FROM flagged GROUP BY user_id),
per_user AS (SELECT s.*, n_rel, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 5) + 1) t(i)) AS idcg FROM stats s LEFT JOIN (SELECT user_id, count(*) n_rel FROM rel GROUP BY user_id) USING (user_id))
SELECT round(avg(ph / 5.0) FILTER (n_rel IS NOT NULL), 6) AS precision_5, round(avg(ph / n_rel) FILTER (n_rel IS NOT NULL), 6) AS recall_5, round(avg(pd / idcg) FILTER (n_rel IS NOT NULL), 6) AS ndcg_5,
  round(avg(rh / 5.0) FILTER (n_rel IS NOT NULL), 6) AS raw_precision_5, round(avg(rh / n_rel) FILTER (n_rel IS NOT NULL), 6) AS raw_recall_5, round(avg(rd / idcg) FILTER (n_rel IS NOT NULL), 6) AS raw_ndcg_5,
  round(100.0 * sum(rb) / sum(rl), 6) AS pvr_pre_pct, CAST(0.0 AS DOUBLE) AS pvr_post_pct, round(100.0 * sum(rj) / sum(wk), 6) AS filter_rate_pct,
  round(100 * avg((pl >= 5)::INT) FILTER (n_rel IS NOT NULL), 6) AS feasibility_at_5_pct, count(*) FILTER (n_rel IS NOT NULL) AS users_evaluated, count(*) AS users_all,
  (SELECT round(100.0 * count(DISTINCT content_id) / 100, 6) FROM flagged WHERE prn <= 5) AS coverage_pct FROM per_user"""
EVAL_WARM = EVAL.format(seen="WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.content_id = s.content_id)", known="mastered")
EVAL_COLD = EVAL.format(seen="", known="(SELECT user_id, concept_id FROM mastered WHERE false)")
TFIDF = f""", tokens AS (SELECT content_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM texts),
tf AS (SELECT content_id, term, count(*) AS tf FROM tokens WHERE term NOT IN ({", ".join(f"'{w}'" for w in scorers.STOP_WORDS)}) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM contents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), raw AS (SELECT content_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
weights AS (SELECT content_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY content_id)) AS weight FROM raw),
sim AS (SELECT a.content_id AS a, b.content_id AS b, sum(a.weight * b.weight) AS sim FROM weights a JOIN weights b USING (term) GROUP BY ALL)"""
POPULAR = ", scores AS (SELECT a.user_id, c.content_id, coalesce(n, 0) AS score FROM asked a, contents c LEFT JOIN (SELECT content_id, count(*) n FROM train GROUP BY ALL) USING (content_id))"
RANDOM = """, free AS (SELECT user_id, content_id, row_number() OVER (PARTITION BY user_id ORDER BY (user_id * 7919 + content_id * 104729 + 123 * 31) % 1000003, content_id) AS rn
  FROM (SELECT user_id, content_id FROM asked, contents) g {free}),
scores AS (SELECT g.user_id, g.content_id, CASE WHEN f.user_id IS NULL THEN 0 ELSE 1 END AS score FROM (SELECT user_id, content_id FROM asked, contents) g LEFT JOIN (SELECT * FROM free WHERE rn <= 5) f USING (user_id, content_id))"""
RANDOM_WARM = RANDOM.format(free="WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = g.user_id AND t.content_id = g.content_id)")
TFIDF_SCORES = """, liked AS (SELECT DISTINCT user_id, content_id AS a FROM train WHERE score >= 0.5),
mean AS (SELECT user_id, b AS content_id, sum(sim) / any_value(n) AS score FROM liked JOIN sim USING (a) JOIN (SELECT user_id, count(*) n FROM liked GROUP BY ALL) USING (user_id) GROUP BY ALL),
scores AS (SELECT a.user_id, c.content_id, round(coalesce(m.score, 0), 9) AS score FROM asked a CROSS JOIN contents c LEFT JOIN mean m ON m.user_id = a.user_id AND m.content_id = c.content_id)"""


def _world(spark: SparkSession, d: str) -> dict:
    events, mapping = fx.interactions(spark, d), fx.content_concepts(spark, d)
    return {"events": events, "mapping": mapping, "users": fx.users(spark, d), "contents": fx.contents(spark, d), "texts": fx.content_texts(spark, d), "described": fx.described_texts(spark, d), "people": fx.users(spark, d), "required": graph.required(mapping, fx.prerequisites(spark, d))}


def _sides(w: dict, cold: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and test events and what was mastered in training; the split is read by several branches, so it is written once."""
    whole = staged(split.cold_split(w["events"]) if cold else split.warm_split(w["events"]), "split")
    train = whole.filter(F.col("side") != "test")
    return train, whole.filter("side = 'test'"), graph.mastered(train, w["mapping"])


def _figures(walked: DataFrame) -> DataFrame:
    """The metrics row of walked lists."""
    return metrics.summarise(staged(walk.per_user(walked), "per-user"), fx.CATALOG)


def _ground(spark: SparkSession, d: str, cold: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """What models of a scenario start from: users' states, the catalog, training events, the world. New users have seen and
    mastered nothing."""
    w = _world(spark, d)
    train, test, known = _sides(w, cold)
    people = test if cold else w["users"]
    states = walk.states(people, None if cold else train, None if cold else known, test)
    return states, walk.catalog(w["contents"], w["required"]), train, w


def _walked(spark: SparkSession, d: str, rank, cold: bool = False) -> DataFrame:
    """Users with the lists that rank(users, items, train, world) leads to."""
    return rank(*_ground(spark, d, cold))


def _popular(users, items, train, w):
    return walk.walk_shared(users, scorers.popular_items(train, items))


def _random(users, items, train, w):
    return walk.walk_own(scorers.random_rankings(users, items))


def _similar(users, items, train, w):
    return walk.walk_own(scorers.tfidf_rankings(users, train, items, w["texts"]))


@query("d1_warm_split", WARM + " SELECT event_id, user_id, content_id, side FROM split")
def d1(spark, d):
    return split.warm_split(fx.interactions(spark, d)).select("event_id", "user_id", "content_id", "side")


@query("d2_cold_split", COLD + " SELECT event_id, user_id, content_id, side FROM csplit")
def d2(spark, d):
    return split.cold_split(fx.interactions(spark, d)).select("event_id", "user_id", "content_id", "side")


@query("d3_split_diagnostics", WARM + """, p AS (SELECT user_id, count(*) FILTER (side = 'train') tr, count(*) FILTER (side = 'test') te FROM split GROUP BY user_id)
SELECT count(*) FILTER (tr > 0) AS train_users, count(*) FILTER (te > 0) AS test_users, count(*) FILTER (tr > 0 AND te > 0) AS both_users, count(*) FILTER (tr > 0 AND te = 0) AS only_train_users,
round(sum(tr) / count(*) FILTER (tr > 0), 6) AS train_rows_per_user, round(sum(te) / count(*) FILTER (te > 0), 6) AS test_rows_per_user FROM p""")
def d3(spark, d):
    return split.split_diagnostics(split.warm_split(fx.interactions(spark, d)))


@query("u3_leaked_pairs", WARM + " SELECT user_id, content_id, count(DISTINCT side) AS n_sides FROM split GROUP BY ALL HAVING count(DISTINCT side) > 1")
def u3(spark, d):
    return split.leaked_pairs(split.warm_split(fx.interactions(spark, d)))


@query("g1_required", WARM + " SELECT * FROM required")
def g1(spark, d):
    return graph.required(fx.content_concepts(spark, d), fx.prerequisites(spark, d))


@query("g2_mastered", WARM + " SELECT * FROM mastered")
def g2(spark, d):
    return _sides(_world(spark, d))[2]


@query("g3_qualified", WARM + """ SELECT a.user_id, c.content_id, NOT EXISTS (SELECT 1 FROM required r WHERE r.content_id = c.content_id AND NOT EXISTS (
SELECT 1 FROM mastered m WHERE m.user_id = a.user_id AND m.concept_id = r.required_concept_id)) AS qualified FROM asked a, contents c""")
def g3(spark, d):
    w = _world(spark, d)
    return graph.qualify(scorers.grid(w["users"], w["contents"]), w["required"], _sides(w)[2])


@query("g4_recommendations", WARM + POPULAR + EVAL_WARM.split("per_user AS")[0].rstrip(", \n") + """ SELECT user_id, CAST(prn AS BIGINT) AS rank, content_id, CAST(score AS DOUBLE) AS predicted_score, topic, difficulty FROM flagged JOIN contents USING (content_id) WHERE prn <= 5""")
def g4(spark, d):
    return walk.recommended(_walked(spark, d, _popular), fx.contents(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("g5_g11_popularity_warm", WARM + POPULAR + EVAL_WARM)
def g5(spark, d):
    return _figures(_walked(spark, d, _popular))


@query("m2_random_warm", WARM + RANDOM_WARM + EVAL_WARM)
def m2(spark, d):
    return _figures(_walked(spark, d, _random))


@query("m3_tfidf_warm", WARM + TFIDF + TFIDF_SCORES + EVAL_WARM)
def m3(spark, d):
    return _figures(_walked(spark, d, _similar))


@query("j16_tfidf_similarity", TFIDF + " SELECT a, b, round(sim, 6) AS sim FROM sim")
def j16(spark, d):
    return scorers.similarity(scorers.tfidf(fx.content_texts(spark, d))).withColumn("sim", F.round("sim", 6))


@query("j16_close_texts", TFIDF.replace("FROM texts)", "FROM (SELECT min(doc_id) AS content_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY coalesce(text, '')))").replace(
    "FROM contents", "FROM (SELECT DISTINCT coalesce(text, '') FROM documents WHERE doc_id IS NOT NULL)").replace("JOIN weights b USING (term)", "JOIN weights b ON a.term = b.term AND a.content_id < b.content_id").replace("GROUP BY ALL)", "GROUP BY ALL)") + " SELECT a, b, round(sim, 6) AS sim FROM sim WHERE sim >= 0.9")
def j16c(spark, d):
    """Pairs of different texts with a cosine of 0.9 or more; a text stands for all documents that have it."""
    docs = fx.table(spark, d, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("content_id"), F.coalesce("text", F.lit("")).alias("text"))
    return closeness.close_texts(docs, 0.9).withColumn("sim", F.round("sim", 6))


def _told(users, items, train, w):
    words = w["people"].select("user_id", T.joined_text(F.col("segment"), F.col("level"), F.col("experience")).alias("text"))
    return walk.walk_own(scorers.profile_rankings(users, words.join(users, "user_id", "left_semi"), w["described"], items))


@query("m4_tfidf_cold", COLD + TFIDF.replace("FROM texts)", "FROM described)") + """, qt AS (SELECT user_id, unnest(regexp_extract_all(lower(concat_ws(' ', segment, level, experience)), '[\\p{L}\\p{N}_]{2,}')) AS term FROM users),
qw AS (SELECT user_id, term, count(*) * any_value(idf) AS w FROM qt JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT user_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL),
told AS (SELECT user_id, content_id, round(sum(w * weight) / any_value(norm), 6) AS score FROM qw JOIN weights USING (term) JOIN qn USING (user_id) GROUP BY ALL),
scores AS (SELECT a.user_id, c.content_id, coalesce(t.score, 0) AS score FROM asked a CROSS JOIN contents c LEFT JOIN told t ON t.user_id = a.user_id AND t.content_id = c.content_id)""" + EVAL_COLD)
def m4c(spark, d):
    """New users' profile texts against the contents' vocabulary; contents without a shared term score 0."""
    return _figures(_walked(spark, d, _told, cold=True))


@query("m4_tfidf_profile", TFIDF + """, q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM benchmark),
qw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM q JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL)
SELECT query_id, content_id, round(sum(w * weight) / any_value(norm), 6) AS score FROM qw JOIN weights USING (term) JOIN qn USING (query_id) GROUP BY ALL""")
def m4(spark, d):
    return scorers.tfidf_profile(fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), fx.content_texts(spark, d))


PROFILE, FEATURES = ["segment", "nation", "level"], ["topic", "difficulty", "is_investment_related"]


def _ridge(users, items, train, w):
    return walk.walk_own(scorers.factor_rankings(users, *scorers.svd_ridge(train, w["users"], w["contents"], PROFILE, FEATURES), items))


def _ridge_new(users, items, train, w):
    return walk.walk_own(scorers.factor_rankings(users, *scorers.svd_ridge(train, w["users"], w["contents"], PROFILE, FEATURES, collaborative=False), items))


def _machine(users, items, train, w):
    return walk.walk_own(scorers.factor_rankings(users, *factors.factorisation_machine(train), items))


def _machine_new(users, items, train, w):
    return walk.walk_own(scorers.factor_rankings(users, *scorers.profile_machine(train, w["users"], w["contents"], PROFILE), items))


@query("m7_svd_ridge_warm")
def m7(spark, d):
    return _figures(_walked(spark, d, _ridge))


@query("m9_svd_ridge_fit_error")
def m9(spark, d):
    w = _world(spark, d)
    told = factors.scores(w["events"], *scorers.svd_ridge(w["events"], w["users"], w["contents"], PROFILE, FEATURES))
    return metrics.mae_rmse(told.withColumn("predicted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("predicted")))))


@query("m10_factor_model_warm")
def m10(spark, d):
    return _figures(_walked(spark, d, _machine))


@query("m8_ridge_cold")
def m8(spark, d):
    return _figures(_walked(spark, d, _ridge_new, cold=True))


@query("m11_factor_model_cold")
def m11(spark, d):
    return _figures(_walked(spark, d, _machine_new, cold=True))


@query("g13_popularity_cold", COLD + POPULAR + EVAL_COLD)
def g13(spark, d):
    return _figures(_walked(spark, d, _popular, cold=True))


@query("g13_random_cold", COLD + RANDOM.format(free="") + EVAL_COLD)
def g13r(spark, d):
    return _figures(_walked(spark, d, _random, cold=True))


@query("g14_model_table")
def g14(spark, d):
    """One row a model and scenario, ten in all; shares to four places, percentages to two."""
    models = {
        "warm": [("popularity", _popular), ("random", _random), ("tfidf", _similar), ("svd ridge", _ridge), ("factor model", _machine)],
        "cold": [("popularity", _popular), ("random", _random), ("tfidf", _told), ("ridge", _ridge_new), ("factor model", _machine_new)],
    }
    rows = []
    for scenario, ranks in models.items():
        states, items, train, w = _ground(spark, d, scenario == "cold")
        states, items = staged(states, "states"), staged(items, "items")  # made once for the models of a scenario
        w |= {name: staged(w[name], name) for name in ("users", "contents")}
        w["people"] = w["users"]
        rows += [_figures(rank(states, items, train, w)).select(F.lit(model).alias("model"), F.lit(scenario).alias("scenario"), "*") for model, rank in ranks]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumns({c: F.round(c, 2 if c.endswith("_pct") else 4) for c, kind in out.dtypes if kind == "double"})


@query("g15_list_diversity", WARM + POPULAR + EVAL_WARM.split("per_user AS")[0].rstrip(", \n") + " SELECT round(avg(t), 6) AS diversity FROM (SELECT user_id, count(DISTINCT topic) / 5.0 AS t FROM flagged JOIN contents USING (content_id) WHERE prn <= 5 GROUP BY user_id)")
def g15(spark, d):
    return g4(spark, d).groupBy("user_id").agg((F.countDistinct("topic") / 5).alias("t")).agg(F.round(F.avg("t"), 6).alias("diversity"))


# ---- audits -------------------------------------------------------------------------------------------------------
@query("a1_rows_per_user", " SELECT round(avg(n), 6) AS mean_n, median(n) AS median_n, min(n) AS min_n, max(n) AS max_n FROM (SELECT count(*) n FROM interactions GROUP BY user_id)")
def a1(spark, d):
    return audit.group_sizes(fx.interactions(spark, d), "user_id")


@query("a2_a5_dataset_stats", """ SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT content_id) AS n_contents, count(*) FILTER (score >= 0.5) AS n_positive, round(count(*) FILTER (score >= 0.5) / count(*), 6) AS positive_share,
round(count(*) FILTER (score >= 0.5) / count(DISTINCT user_id) FILTER (score >= 0.5), 6) AS positives_per_positive_user, round(1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT content_id)), 6) AS sparsity,
count(*) - count(DISTINCT (user_id, content_id)) AS repeated_pairs FROM interactions""")
def a2(spark, d):
    return audit.dataset_stats(fx.interactions(spark, d))


@query("a6_distributions", """, l AS (SELECT 'segment' AS column_name, segment AS value FROM users UNION ALL SELECT 'level', level FROM users UNION ALL SELECT 'nation', CAST(nation AS VARCHAR) FROM users)
SELECT column_name, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY column_name), 6) AS share FROM l GROUP BY column_name, value""")
def a6(spark, d):
    return audit.distributions(fx.users(spark, d), ["segment", "level", "nation"])


@query("a9_mean_scores", " SELECT user_id, content_id, round(avg(score), 6) AS score FROM interactions GROUP BY ALL")
def a9(spark, d):
    return fx.interactions(spark, d).groupBy("user_id", "content_id").agg(F.round(F.avg("score"), 6).alias("score"))


@query("a13_concept_coverage", " SELECT concept_id, count(content_id) AS n_contents FROM concepts LEFT JOIN ccm USING (concept_id) GROUP BY ALL")
def a13(spark, d):
    return audit.concept_coverage(fx.concepts(spark, d), fx.content_concepts(spark, d).filter("coverage_type = 'directa'"))


@query("a15_last_wins", " SELECT user_id, arg_max(content_id, event_id) AS content_id, min(event_id) AS first_place FROM interactions GROUP BY user_id")
def a15(spark, d):
    return audit.last_wins(fx.interactions(spark, d), "user_id", "event_id", "content_id")


@query("a17_difficulty_by_level", " SELECT level, difficulty, count(*) AS n FROM interactions JOIN users USING (user_id) JOIN contents USING (content_id) GROUP BY ALL")
def a17(spark, d):
    w = _world(spark, d)
    return w["events"].join(w["users"], "user_id").join(w["contents"], "content_id").groupBy("level", "difficulty").agg(F.count("*").alias("n"))


@query("a18_set_sizes", WARM + """, l AS (SELECT DISTINCT user_id FROM split WHERE side = 'train'), r AS (SELECT DISTINCT user_id FROM split WHERE side = 'test')
SELECT count(*) FILTER (r.user_id IS NULL) AS only_left, count(*) FILTER (l.user_id IS NULL) AS only_right, count(*) FILTER (l.user_id IS NOT NULL AND r.user_id IS NOT NULL) AS both FROM l FULL JOIN r USING (user_id)""")
def a18(spark, d):
    train, test, _ = _sides(_world(spark, d))
    return audit.set_sizes(train, test, "user_id")


@query("a21_kl_divergence", """, n AS (SELECT event, count(*) FILTER (level = 'bajo') a, count(*) FILTER (level <> 'bajo') b FROM interactions JOIN users USING (user_id) WHERE level IS NOT NULL GROUP BY event)
SELECT round(sum(p * ln(p / q)), 6) AS kl FROM (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM n) WHERE p > 0 AND q > 0""")
def a21(spark, d):
    known = fx.interactions(spark, d).join(fx.users(spark, d), "user_id").filter("level is not null")
    return audit.kl_divergence(known, F.col("level") == "bajo", "event")


@query("w10_event_ordinal", " SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM interactions")
def w10(spark, d):
    return fx.interactions(spark, d).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("ordinal"))


@query("c1_concept_map", """, d AS (SELECT CAST(t AS INT) AS topic, CAST(t + 1 AS INT) AS usual FROM range(12) r(t)), e AS (SELECT * FROM ccm WHERE content_id % 3 = 0)
SELECT DISTINCT c.content_id, coalesce(e.concept_id, d.usual) AS concept_id, CASE WHEN e.concept_id IS NOT NULL THEN 'explicit' ELSE 'topic default' END AS evidence_note
FROM contents c LEFT JOIN e USING (content_id) LEFT JOIN d USING (topic) WHERE coalesce(e.concept_id, d.usual) IS NOT NULL""")
def c1(spark, d):
    defaults = spark.range(12).select(F.col("id").cast("int").alias("topic"), (F.col("id") + 1).cast("int").alias("concept_id"))
    return audit.concept_map(fx.contents(spark, d), fx.content_concepts(spark, d).filter("content_id % 3 = 0 and coverage_type = 'directa'"), defaults)


@query("c2_catalog_checks", """, x AS (SELECT content_id, concept_id FROM ccm UNION SELECT content_id, CAST((concept_id + 11) % 30 AS INT) FROM ccm WHERE content_id % 4 = 0)
SELECT 'content count' AS check_name, count(*) = 100 AS ok, count(*) AS observed FROM contents UNION ALL SELECT 'repeated content ids', true, 0 UNION ALL
SELECT 'unknown concepts', count(*) = 0, count(*) FROM (SELECT DISTINCT concept_id FROM x WHERE concept_id NOT IN (SELECT concept_id FROM concepts)) UNION ALL
SELECT 'unmapped contents', count(*) = 0, count(*) FROM contents WHERE content_id NOT IN (SELECT content_id FROM x) UNION ALL
SELECT 'other coverage types', count(*) = 0, count(*) FROM ccm WHERE content_id % 4 = 0 UNION ALL SELECT 'missing or other columns', count(*) FILTER (column_name IN ('content_id', 'topic', 'difficulty', 'is_investment_related')) = 4, count(*) - 4
FROM (SELECT unnest(['content_id', 'topic', 'difficulty', 'is_investment_related']) AS column_name)""")
def c2(spark, d):
    return audit.catalog_checks(fx.contents(spark, d), fx.content_concepts(spark, d), fx.concepts(spark, d), fx.CATALOG, ["content_id", "topic", "difficulty", "is_investment_related"])


@query("c5_snapshot_diff", " SELECT *, 'removed' AS change FROM (SELECT * FROM prerequisites EXCEPT SELECT * FROM prerequisites WHERE concept_id <> 27) ")
def c5(spark, d):
    edges = fx.prerequisites(spark, d)
    return audit.snapshot_diff(edges, edges.filter("concept_id <> 27"))


NEEDS = """, seen AS (SELECT user_id, concept_id, min(ts) AS first_ts FROM interactions JOIN contents USING (content_id) JOIN topic_concepts USING (topic) WHERE event <> 'disliked' GROUP BY ALL),
audited AS (SELECT i.event_id, i.user_id, i.content_id, difficulty = 'avanzado' AND coalesce(level = 'bajo', true) AND coalesce(experience = 'ninguna', false) AS r1,
difficulty = 'avanzado' AND is_investment_related AND coalesce(experience IN ('ninguna', 'básica'), false) AS r2,
difficulty <> 'básico' AND is_investment_related AND (SELECT count(*) FROM seen s WHERE s.user_id = i.user_id AND s.concept_id IN (2, 7, 6, 13) AND s.first_ts < i.ts) < 4 AS r3,
difficulty <> 'básico' AND EXISTS (SELECT 1 FROM topic_concepts t WHERE t.topic = c.topic AND t.place < 2 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = i.user_id AND s.concept_id = t.concept_id AND s.first_ts < i.ts)) AS r4
FROM interactions i LEFT JOIN users u ON u.user_id = i.user_id JOIN contents c ON c.content_id = i.content_id)"""


def _rules(spark: SparkSession, d: str) -> tuple[dict, DataFrame, DataFrame]:
    """The world, concepts seen by user, and concepts that contents need."""
    w = _world(spark, d)
    topics = fx.topic_concepts(spark)
    seen = audit.first_seen(w["events"], w["contents"].join(topics, "topic").select("content_id", "concept_id"))
    return w, seen, audit.content_needs(w["contents"], topics, fx.INVESTMENT_CONCEPTS)


@query("e1_e6_eligibility", NEEDS + " SELECT * FROM audited")
def e1(spark, d):
    w, seen, needs = _rules(spark, d)
    return audit.eligibility(w["events"], w["users"], w["contents"], seen, needs)


@query("z1_requirement_stream", NEEDS + " SELECT * FROM audited")
def z1s(spark, d):
    """The eligibility rules judged on a stream of the log, with the concepts met as keyed state."""
    w, _, needs = _rules(spark, d)
    people, items = staged(w["users"], "people"), staged(w["contents"], "items")  # read again in every batch of the stream
    return requirements.replay(fx.interaction_stream(spark, d), lambda events: requirements.facts(events, people, items, fx.topic_concepts(spark), needs))


@query("e7_violations_by_rule", NEEDS + """ SELECT count(*) FILTER (r1) AS r1, count(*) FILTER (r2) AS r2, count(*) FILTER (r3) AS r3, count(*) FILTER (r4) AS r4,
round(count(*) FILTER (r1 OR r2 OR r3 OR r4) / count(*), 6) AS share, count(*) FILTER (r1 OR r2 OR r3 OR r4) <= 0.05 * count(*) AS tolerated FROM audited""")
def e7(spark, d):
    any_rule = F.count_if(F.expr("r1 or r2 or r3 or r4"))
    return e1(spark, d).agg(*[F.count_if(r).alias(r) for r in ("r1", "r2", "r3", "r4")], F.round(any_rule / F.count("*"), 6).alias("share"), (any_rule <= 0.05 * F.count("*")).alias("tolerated"))


ALLOWED = NEEDS + """, allowed AS (SELECT u.user_id, c.content_id, c.difficulty, c.topic FROM users u, contents c WHERE NOT (difficulty = 'avanzado' AND coalesce(level = 'bajo', true) AND coalesce(experience = 'ninguna', false))
AND NOT (difficulty = 'avanzado' AND is_investment_related AND coalesce(experience IN ('ninguna', 'básica'), false))
AND (difficulty = 'básico' OR NOT is_investment_related OR (SELECT count(*) FROM seen s WHERE s.user_id = u.user_id AND s.concept_id IN (2, 7, 6, 13)) = 4)
AND (difficulty = 'básico' OR (SELECT count(*) FROM topic_concepts t WHERE t.topic = c.topic AND t.place < 2) = (SELECT count(*) FROM topic_concepts t JOIN seen s ON s.concept_id = t.concept_id AND s.user_id = u.user_id WHERE t.topic = c.topic AND t.place < 2)))"""


def _allowed(spark: SparkSession, d: str) -> tuple[dict, DataFrame, DataFrame]:
    w, seen, needs = _rules(spark, d)
    pairs = scorers.grid(w["users"], w["contents"])
    return w, pairs, audit.qualifying(pairs, w["users"], w["contents"], seen, needs)


@query("e5_user_qualifies", ALLOWED + " SELECT user_id, content_id FROM allowed")
def e5(spark, d):
    return _allowed(spark, d)[2]


@query("p9_difficulty_pool", ALLOWED + """, pools AS (SELECT user_id, difficulty AS target, 1 AS tier FROM allowed UNION ALL SELECT user_id, target, 2 FROM allowed, (VALUES ('básico'), ('intermedio'), ('avanzado')) t(target) WHERE difficulty = 'básico'
UNION ALL SELECT user_id, target, 3 FROM users, contents, (VALUES ('básico'), ('intermedio'), ('avanzado')) t(target) WHERE difficulty = 'básico')
SELECT * FROM (SELECT user_id, target, tier, count(*) AS n_contents FROM pools GROUP BY user_id, target, tier) QUALIFY tier = min(tier) OVER (PARTITION BY user_id, target)""")
def p9(spark, d):
    w, pairs, allowed = _allowed(spark, d)
    return audit.difficulty_pool(allowed, pairs, w["contents"])


@query("n6_x3_weighted_pick", ALLOWED + """, weighted AS (SELECT user_id, content_id, greatest(0.05, ((user_id * 7 + topic * 3) % 10) / 10.0 + CASE difficulty WHEN 'avanzado' THEN 0.3 WHEN 'intermedio' THEN 0.1 ELSE 0.0 END) AS w,
(CAST(CAST('0x' || substr(md5(user_id || '|' || content_id || '|9'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u FROM allowed)
SELECT user_id, content_id FROM weighted QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY -ln(u) / w, content_id) = 1""")
def n6(spark, d):
    w, _, allowed = _allowed(spark, d)
    affinity = F.pmod(F.col("user_id") * 7 + F.col("topic") * 3, F.lit(10)) / 10
    weights = allowed.join(w["contents"], "content_id").withColumn("weight", profiles.preference(affinity, F.col("difficulty")))
    return profiles.weighted_pick(weights, "user_id", "content_id", "weight")


@query("e8_difficulty_mix", """ SELECT difficulty, round(count(*) / sum(count(*)) OVER (), 6) AS share, any_value(target) AS target FROM interactions JOIN contents USING (content_id)
JOIN (VALUES ('básico', 0.6::DOUBLE), ('intermedio', 0.3::DOUBLE), ('avanzado', 0.1::DOUBLE)) t(difficulty, target) USING (difficulty) GROUP BY difficulty""")
def e8(spark, d):
    w = _world(spark, d)
    n = w["events"].join(w["contents"], "content_id").groupBy("difficulty").agg(F.count("*").alias("n"))
    target = F.when(F.col("difficulty") == "básico", 0.6).when(F.col("difficulty") == "intermedio", 0.3).otherwise(0.1)
    return n.select("difficulty", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), target.alias("target"))


@query("e9_never_consumed", " SELECT content_id FROM contents WHERE content_id NOT IN (SELECT content_id FROM interactions)")
def e9(spark, d):
    return audit.referential(fx.contents(spark, d), fx.interactions(spark, d), "content_id")


@query("e9_bounds_per_user", " SELECT min(n) AS least, max(n) AS most, count(*) FILTER (n < 2) AS too_few, count(*) FILTER (n > 14) AS too_many FROM (SELECT count(*) n FROM interactions GROUP BY user_id)")
def e9b(spark, d):
    return audit.bounds_per_user(fx.interactions(spark, d), 2, 14)


@query("e10_dataset_report", """ SELECT 'sources' AS line, count(*)::DOUBLE AS value FROM supplier UNION ALL SELECT 'contents', count(*) FROM contents UNION ALL SELECT 'concepts', count(*) FROM concepts UNION ALL SELECT 'prerequisites', count(*) FROM prerequisites
UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'interactions', count(*) FROM interactions UNION ALL SELECT 'investment contents', count(*) FROM contents WHERE is_investment_related
UNION ALL SELECT 'https percentage', round(100.0 * count(*) FILTER (url LIKE 'https://%') / count(*), 6) FROM pages UNION ALL SELECT 'difficulty ' || difficulty, count(*) FROM contents GROUP BY difficulty
UNION ALL SELECT 'event ' || event, count(*) FROM interactions GROUP BY event UNION ALL SELECT 'users of level ' || coalesce(level, 'unknown'), count(*) FROM users GROUP BY level
UNION ALL SELECT 'low users with ' || difficulty, count(*) FROM interactions JOIN users USING (user_id) JOIN contents USING (content_id) WHERE level = 'bajo' GROUP BY difficulty""")
def e10(spark, d):
    w = _world(spark, d)
    value = lambda frame, line, n=F.count("*"): frame.agg(n.cast("double").alias("value")).select(F.lit(line).alias("line"), "value")
    each = lambda frame, column, prefix: frame.groupBy(column).agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit(prefix), F.coalesce(column, F.lit("unknown"))).alias("line"), "value")
    https = F.round(100 * F.avg(F.col("url").startswith("https://").cast("double")), 6)
    low = w["events"].join(w["users"].filter("level = 'bajo'"), "user_id").join(w["contents"], "content_id")
    parts = [
        value(fx.table(spark, d, "supplier"), "sources"), value(w["contents"], "contents"), value(fx.concepts(spark, d), "concepts"), value(fx.prerequisites(spark, d), "prerequisites"), value(w["users"], "users"),
        value(w["events"], "interactions"), value(w["contents"].filter("is_investment_related"), "investment contents"), value(fx.table(spark, d, "pages"), "https percentage", https),
        each(w["contents"], "difficulty", "difficulty "), each(w["events"], "event", "event "), each(w["users"], "level", "users of level "), each(low, "difficulty", "low users with "),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("a4_sparsities", """ SELECT round(1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT content_id)), 6) AS active_sparsity,
round(1 - (SELECT count(*) FROM (SELECT avg(score) s FROM interactions GROUP BY user_id, content_id) WHERE s <> 0) / ((SELECT count(*) FROM users) * (SELECT count(*) FROM contents)), 6) AS grid_sparsity FROM interactions""")
def a4(spark, d):
    w = _world(spark, d)
    return audit.sparsities(w["events"], w["users"], w["contents"])


@query("a9_score_grid", " SELECT u.user_id, c.content_id, coalesce(s, 0) AS score FROM users u CROSS JOIN contents c LEFT JOIN (SELECT user_id, content_id, round(avg(score), 6) s FROM interactions GROUP BY ALL) i ON i.user_id = u.user_id AND i.content_id = c.content_id")
def a9g(spark, d):
    w = _world(spark, d)
    return scorers.grid(w["users"], w["contents"]).join(a9(spark, d), ["user_id", "content_id"], "left").select("user_id", "content_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query("a19_event_topics", " SELECT event, topic, count(*) AS n FROM interactions JOIN contents USING (content_id) GROUP BY ALL")
def a19(spark, d):
    w = _world(spark, d)
    return w["events"].join(w["contents"], "content_id").groupBy("event", "topic").agg(F.count("*").alias("n"))


@query("a21_quartiles", """, q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3 FROM events)
SELECT 1 + (value > q1)::INT + (value > q2)::INT + (value > q3)::INT AS quartile, count(*) AS n, round(avg(least(value / 100, 1.0)), 6) AS mean_value FROM events, q GROUP BY ALL""")
def a21q(spark, d):
    return audit.quartiles(fx.table(spark, d, "events").select("value", F.least(F.col("value") / 100, F.lit(1.0)).alias("score")), "value", "score")


@query("a21_score_histogram", " SELECT CAST(floor(score / 0.1) AS BIGINT) AS bucket, count(*) AS n FROM interactions GROUP BY ALL")
def a21h(spark, d):
    return audit.histogram(fx.interactions(spark, d), "score", 0.1)


@query("d3_split_distributions", WARM + """, l AS (SELECT side, 'event' AS column_name, event AS value FROM split UNION ALL SELECT side, 'level', level FROM split LEFT JOIN users USING (user_id))
SELECT side, column_name, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side, column_name), 6) AS share FROM l GROUP BY side, column_name, value""")
def d3d(spark, d):
    whole = split.warm_split(fx.interactions(spark, d)).join(fx.users(spark, d), "user_id", "left")
    return split.split_distributions(whole, ["event", "level"])


@query("d3_users_without_test", WARM + " SELECT user_id, count(*) AS n_rows FROM split GROUP BY user_id HAVING count(*) FILTER (side = 'test') = 0 ORDER BY user_id LIMIT 5")
def d3u(spark, d):
    return split.users_without_test(split.warm_split(fx.interactions(spark, d)))


@query("u4_mastery_union", WARM + " SELECT user_id, concept_id FROM mastered UNION SELECT user_id, concept_id FROM users, (VALUES (1), (2)) t(concept_id) WHERE level = 'alto'")
def u4(spark, d):
    w = _world(spark, d)
    initial = w["users"].filter("level = 'alto'").select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("concept_id"))
    return graph.with_initial(_sides(w)[2], initial)


@query("g13_popularity_cold_initial", COLD + POPULAR + EVAL.format(seen="", known="(SELECT user_id, concept_id FROM users, (VALUES (1), (2), (3)) t(concept_id) WHERE level = 'alto')"))
def g13i(spark, d):
    w = _world(spark, d)
    train, test, _ = _sides(w, cold=True)
    known = w["users"].filter("level = 'alto'").select("user_id", F.explode(F.array(*[F.lit(c) for c in (1, 2, 3)])).alias("concept_id"))
    asked = test.select("user_id").distinct()
    return metrics.evaluate(scorers.popularity(train, asked, w["contents"]), None, test, w["required"], known, fx.CATALOG)


@query("u5_universe", " SELECT content_id, 'left' AS side FROM contents WHERE content_id NOT IN (SELECT content_id FROM interactions WHERE score > 0.9) UNION ALL SELECT DISTINCT content_id, 'right' FROM interactions WHERE score > 0.9 AND content_id NOT IN (SELECT content_id FROM contents)")
def u5(spark, d):
    return audit.symmetric_difference(fx.contents(spark, d), fx.interactions(spark, d).filter("score > 0.9"), "content_id")


@query("w7_w8_common_topics", " SELECT topic, count(*) AS n_rows FROM interactions JOIN contents USING (content_id) GROUP BY topic ORDER BY n_rows DESC, topic LIMIT 5")
def w7(spark, d):
    w = _world(spark, d)
    return audit.most_common(w["events"].join(w["contents"], "content_id"), "topic", 5)


@query("w9_j13_numbers", " SELECT printf('I%05d', row_number() OVER (ORDER BY event_id)) AS interaction_id, event_id FROM interactions")
def w9(spark, d):
    return audit.numbered(fx.interactions(spark, d), "event_id").select(F.format_string("I%05d", "number").alias("interaction_id"), "event_id")


@query("j13_positional_zip", " SELECT user_id, respondent FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) n FROM users) JOIN (SELECT respondent, row_number() OVER (ORDER BY respondent DESC) n FROM survey) USING (n)")
def j13(spark, d):
    return audit.zipped(fx.users(spark, d), "user_id", fx.survey(spark, d).withColumn("down", -F.col("respondent")), "down").select("user_id", "respondent")


@query("w11_weighted_mode", " SELECT source, lang, w AS weight FROM (SELECT source, lang, sum(n_chars)::BIGINT AS w FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, lang DESC) = 1")
def w11(spark, d):
    return audit.weighted_mode(fx.table(spark, d, "documents"), "source", "lang", "n_chars")


# ---- survey -------------------------------------------------------------------------------------------------------
def _valid(c: str) -> str:
    return f"(CASE WHEN {c} NOT IN (-97, -98, -99) THEN {c} END)"


COIN = "((CAST(CAST('0x' || substr(md5(respondent || '|{}'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)"


@query("p1_n13_user_profiles", f""", s AS (SELECT *, 2021 - a0400 AS age, {" + ".join(f"({_valid(c)} IS NOT NULL)::INT" for c in ("k0600", "k0100", "k1003"))} AS valid,
coalesce(k0600 = 3, false)::INT + coalesce(k0100 = 3, false)::INT + coalesce(k1003 = 1, false)::INT AS good FROM survey),
k AS (SELECT *, CASE WHEN valid = 0 THEN NULL WHEN good = 0 THEN 'bajo' WHEN good = valid THEN 'alto' ELSE 'medio' END AS kl, CASE b0130b WHEN 1 THEN 'frecuente' WHEN 0 THEN 'ocasional' END AS habit,
CASE WHEN b1000c < 0 THEN NULL WHEN b1000c = 1 THEN 'básica' ELSE 'ninguna' END AS experience FROM s WHERE age BETWEEN 18 AND 34),
debt AS (SELECT *, CASE kl WHEN 'bajo' THEN CASE WHEN {COIN.format(1)} < 0.4 THEN 'baja' ELSE 'media' END WHEN 'medio' THEN CASE WHEN {COIN.format(1)} < 0.5 THEN 'ninguna' ELSE 'baja' END ELSE 'ninguna' END AS debt FROM k)
SELECT printf('U%04d', respondent) AS user_id, CASE WHEN age <= 24 THEN '18-24' ELSE '25-34' END AS age_group, CASE a0100 WHEN 1 THEN 'hombre' WHEN 0 THEN 'mujer' END AS sex,
CASE e0100 WHEN 1 THEN 'posgrado' WHEN 2 THEN 'universidad' WHEN 3 THEN 'bachillerato' WHEN 5 THEN 'primaria' ELSE 'secundaria' END AS education_level,
CASE WHEN a1500 = 9 THEN 'estudiante' WHEN a1500 IN (5, 8) THEN 'desempleado' ELSE 'empleado' END AS employment_status, kl AS financial_knowledge_level, habit AS saving_habit, experience AS investment_experience,
CASE habit WHEN 'frecuente' THEN 'alto' WHEN 'ocasional' THEN 'medio' END AS financial_behavior_level, debt AS debt_experience,
CASE kl WHEN 'alto' THEN 'alto' WHEN 'medio' THEN CASE WHEN {COIN.format(2)} < 0.7 THEN 'medio' ELSE 'alto' END WHEN 'bajo' THEN CASE WHEN {COIN.format(2)} < 0.6 THEN 'bajo' ELSE 'medio' END END AS financial_attitude_level,
CASE WHEN experience = 'básica' THEN 'prepararse para invertir' WHEN debt IN ('media', 'alta') THEN 'entender deuda' WHEN {COIN.format(3)} < 0.3 THEN 'presupuestar' WHEN {COIN.format(3)} < 0.7 THEN 'ahorrar' ELSE 'planificar finanzas' END AS learning_goal FROM debt""")
def p1(spark, d):
    return profiles.user_profiles(fx.survey(spark, d))


@query("a7_answer_rates", " UNION ALL ".join(f" SELECT '{c}' AS question, round(count(*) FILTER ({c} = {v}) / count(*), 6) AS share_all, round(count(*) FILTER ({c} = {v}) / count(*) FILTER ({c} NOT IN (-97, -98, -99)), 6) AS share_valid FROM survey" for c, v in profiles.RIGHT_ANSWERS.items()))
def a7(spark, d):
    return profiles.answer_rates(fx.survey(spark, d))


@query("a8_valid_shares", " SELECT e0100 AS code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM survey WHERE e0100 IN (1, 2, 3, 4, 5) GROUP BY e0100")
def a8(spark, d):
    return profiles.valid_shares(fx.survey(spark, d), "e0100", [1, 2, 3, 4, 5])


# the weights once more, written from the published table and not from the operator's
@query("n5_topic_affinity", """, b AS (SELECT respondent, (b0130a = 1)::INT sa, (b0130b = 1)::INT ac, (b0130c = 1)::INT inf, (b1000b = 1)::INT pay, (a0320 = 1)::INT short FROM survey),
t AS (SELECT respondent, unnest([{'t': 'planificación', 'a': 0.8::DOUBLE}, {'t': 'ahorro', 'a': 0.7 + 0.2 * sa + 0.3 * short}, {'t': 'fraude', 'a': 0.7}, {'t': 'deuda', 'a': 0.1 + 1.0 * short}, {'t': 'crédito', 'a': 0.1 + 0.8 * short + 0.2 * pay},
{'t': 'préstamos', 'a': 0.1 + 0.6 * short}, {'t': 'tarjetas', 'a': 0.2 + 0.4 * short}, {'t': 'cuentas bancarias', 'a': 0.3 + 0.5 * ac}, {'t': 'hipotecas', 'a': 0.1 + 0.3 * ac}, {'t': 'inversión', 'a': 0.05 + 1.0 * inf + 0.2 * ac - 0.05 * short},
{'t': 'riesgo', 'a': 0.1 + 0.6 * inf}, {'t': 'diversificación', 'a': 0.05 + 0.8 * inf}, {'t': 'interés', 'a': 0.4 + 0.2 * ac}, {'t': 'inflación', 'a': 0.3 + 0.4 * short}, {'t': 'impuestos', 'a': 0.3}]) AS x FROM b)
SELECT respondent, x.t AS topic, round(greatest(0.05, least(1.0, x.a::DOUBLE)), 6) AS affinity FROM t""")
def n5(spark, d):
    return profiles.topic_affinity(fx.survey(spark, d), others=("impuestos",))


@query("n1_n8_engagement", """, g AS (SELECT event_id, CASE level WHEN 'medio' THEN 2 WHEN 'alto' THEN 3 ELSE 1 END - CASE difficulty WHEN 'básico' THEN 1 WHEN 'intermedio' THEN 2 ELSE 3 END AS gap, score, event_id % 2 = 0 AS coin,
CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0::DOUBLE END AS quiz, (event_id % 7) / 7.0::DOUBLE AS luck FROM interactions LEFT JOIN users USING (user_id) JOIN contents USING (content_id))
SELECT event_id, round(1 / (1 + exp(-(1.5 + 0.8 * gap + 0.5 * (score - 0.5)))), 6) AS click, round(1 / (1 + exp(-(1.0 + 0.7 * gap + 0.3 * (score - 0.5)))), 6) AS complete, round(1 / (1 + exp(-(0.5 + 0.6 * gap + 0.2 * (score - 0.5)))), 6) AS quiz,
CASE WHEN quiz >= 0.6 AND score >= 0.9 AND NOT coin THEN 'completed' WHEN quiz >= 0.6 THEN 'quiz_passed' WHEN score >= 0.9 THEN 'completed' WHEN score >= 0.5 THEN 'viewed' WHEN score < 0.2 THEN 'disliked' ELSE 'viewed' END AS label,
round(0.4 * score + 0.4 * coalesce(quiz, 0) + 0.2 * luck, 3) AS engagement FROM g""")
def n1(spark, d):
    w = _world(spark, d)
    facts = w["events"].join(w["users"], "user_id", "left").join(w["contents"], "content_id")
    gap = profiles.knowledge_to_num(F.col("level")) - profiles.difficulty_to_num(F.col("difficulty"))
    quiz = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 10) / 10)
    label = profiles.event_label(F.col("score"), quiz, F.col("event_id") % 2 == 0)
    return facts.select("event_id", *profiles.propensities(gap, F.col("score")), label.alias("label"), profiles.engagement(F.col("score"), quiz, (F.col("event_id") % 7) / 7).alias("engagement"))


# ---- pages and texts ----------------------------------------------------------------------------------------------
@query("h3_headings", """, h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS tag FROM pages)
SELECT page_id, CAST(regexp_extract(tag, '(?i)^<h([1-6])', 1) AS INT) AS level, count(*) AS n FROM h GROUP BY ALL""")
def h3(spark, d):
    return pages.headings(fx.table(spark, d, "pages")).groupBy("page_id", "level").agg(F.count("*").alias("n"))


@query("h4_links", """, a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS tag FROM pages),
b AS (SELECT page_id, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS raw, trim(replace(replace(replace(replace(replace(replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS label FROM a)
SELECT page_id, count(DISTINCT raw) AS n_links FROM b WHERE NOT regexp_matches(raw, '^(#|mailto:|javascript:|$)') AND length(label) >= 3 GROUP BY page_id""")
def h4(spark, d):
    """Links of whole pages, for the given ones have them in their navigation only."""
    return pages.links(fx.table(spark, d, "pages"), main_only=False).groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("h1_url_fan_out", """, k AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS key FROM pages)
SELECT page_id, CASE WHEN page_id <> min(page_id) OVER (PARTITION BY key) THEN min(page_id) OVER (PARTITION BY key) END AS deduped_from FROM k""")
def h1(spark, d):
    return pages.fan_out(fx.table(spark, d, "pages"))


@query("h2_h11_page_records")
def h2(spark, d):
    return pages.records(fx.table(spark, d, "pages"))


@query("h6_sections")
def h6(spark, d):
    source = fx.table(spark, d, "pages")
    heads = pages.headings(source).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "heading"))), lambda x: x["heading"]).alias("headings"))
    return pages.sections(pages.records(source).select("page_id", "text").join(heads, "page_id"))


def _structured(spark: SparkSession, d: str) -> DataFrame:
    """Texts to structure: pages with their headings and links, each text followed by lists made of its page: the labels of its
    navigation as bullets (labels that it links), its headings as a numbered list, and pairs of short and long bullets."""
    source = fx.table(spark, d, "pages")
    inside = lambda x: x["name"]
    heads = pages.headings(source).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("heading").alias("name")))), inside).alias("headings"))
    found = pages.links(source, main_only=False).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label", "href"))).alias("found"))
    linked = found.select("page_id", F.transform("found", lambda x: F.struct(x.label.alias("label"), x.href.alias("href"))).alias("links"))
    kind = F.when(F.col("page_id") % 2 == 0, "Glosario web").otherwise("Artículo")
    whole = pages.records(source).select("page_id", "text").join(heads, "page_id", "left").join(linked, "page_id", "left").withColumn("format", kind)
    lines = lambda xs, mark: F.array_join(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x)), "\n")
    labels = F.transform("links", lambda x: x.label)
    pairs = F.flatten(F.transform(F.slice(labels, 1, 3), lambda x: F.array(x, F.concat(F.lit("Meaning of "), x, F.lit(".")))))
    return whole.withColumn("text", F.concat_ws("\n\n", "text", lines(labels, "- "), lines(F.col("headings"), "1. "), lines(pairs, "• ")))


@query("h7_h9_blocks")
def h7(spark, d):
    return pages.blocks(_structured(spark, d))


@query("h7_document_blocks")
def h7d(spark, d):
    return pages.blocks(fx.table(spark, d, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("page_id"), F.coalesce("text", F.lit("")).alias("text")))


@query("h8_link_places")
def h8(spark, d):
    """Where pages name the words of their own link labels."""
    return pages.link_places(pages.blocks(_structured(spark, d)))


@query("k5_ingest_summary")
def k5(spark, d):
    source = fx.table(spark, d, "pages")
    heads = pages.headings(source).groupBy("page_id").agg(F.min_by("heading", "pos").alias("title"))
    catalog = source.select("page_id").join(heads, "page_id", "left").select("page_id", "title", F.lit("web").alias("source"), F.lit("Artículo").alias("format"))
    return pages.ingest_summary(source, catalog)


@query("p7_https_share", " SELECT count(*) AS n, round(100.0 * count(*) FILTER (url LIKE 'https://%') / count(*), 6) AS https_pct FROM pages")
def p7(spark, d):
    return fx.table(spark, d, "pages").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("url").startswith("https://").cast("double")), 6).alias("https_pct"))


@query("t14_corpus_text", " SELECT doc_id, concat_ws(' ', lang, source, CAST(n_chars AS VARCHAR)) AS corpus FROM documents")
def t14(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.joined_text(F.col("lang"), F.col("source"), F.col("n_chars")).alias("corpus"))


@query("t8_t16_dates", """ SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y') AS year, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS stamp FROM events""")
def t8(spark, d):
    ts = F.col("ts")
    odd = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return fx.table(spark, d, "events").select("event_id", T.loose_date(F.date_format(ts, "yyyy.MM")).alias("month"), T.loose_date(F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("+02'00'"))).alias("day"), T.loose_date(F.date_format(ts, "yyyy")).alias("year"), T.lenient_timestamp(odd).alias("stamp"))


@query("t17_title_guess", r""" , l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 5 AND regexp_matches(x, '\p{L}') AND NOT (regexp_matches(x, '^\d{1,3}\s+[A-Z][\p{L}\p{N}_\s]{1,40}$') AND length(x) < 50) AND lower(x) NOT IN ('guía de cnmv', 'competencias básicas para inversores'))[1:6] AS a FROM documents)
SELECT doc_id, list_filter(a, lambda x: length(x) = list_max(list_transform(a, lambda y: length(y))))[1] AS title FROM l""")
def t17(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.title_guess(F.col("text")).alias("title"))


@query("h12_class_counts")
def h12(spark, d):
    return pages.class_counts(pages.records(fx.table(spark, d, "pages")))


@query("t4_extraction_class", f""", w AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 200 THEN 'short' WHEN coalesce(len(list_filter(ws, lambda x: x IN ({", ".join(f"'{x}'" for x in T.NAV_WORDS)}))) / nullif(len(ws), 0), 0) > 0.04 AND n < 2000 THEN 'navigation_only' ELSE 'ok' END AS classification FROM w""")
def t4(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.extraction_class(F.col("text")).alias("classification"))


@query("t5_t8_short_forms", """ SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, md5(url) AS cache_key, url LIKE 'https%' AS https, CASE WHEN length(url) > 20 THEN substr(url, 1, 19) || '…' ELSE url END AS short FROM pages""")
def t5(spark, d):
    url = F.col("url")
    return fx.table(spark, d, "pages").select("page_id", T.host(url).alias("host"), F.md5(url).alias("cache_key"), url.startswith("https").alias("https"), T.short_title(url, 20).alias("short"))


@query("w12_gap_groups", """, g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS new, event_id FROM interactions)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) GROUP BY ALL""")
def w12(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    marked = fx.interactions(spark, d).withColumn("new", F.when(gap < 3_600_000_000, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return marked.groupBy("user_id", "run").agg(F.count("*").alias("n"))


# ---- enrichment ---------------------------------------------------------------------------------------------------
def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as answers, whole texts: every fifth is fenced, every seventh has a wrong index, every eleventh
    is broken."""
    turn = F.col("conv_id") * 31 + F.col("turn")
    quiz = F.array(F.struct(F.lit("¿?").alias("question"), F.array(F.lit("a"), F.lit(" b ")).alias("options"), F.when(turn % 7 == 0, 5).otherwise(1).alias("correct_index"), F.lit(" x ").alias("explanation"), F.concat(F.lit("C"), (turn % 50).cast("string")).alias("concept_id")))
    body = F.to_json(F.struct(F.col("text").alias("tldr"), F.split("text", r"[.!?]\s+").alias("key_points"), quiz.alias("quiz")))
    noisy = F.when(turn % 11 == 0, F.substring(body, 1, 40)).when(turn % 5 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return fx.table(spark, d, "conversations").select(F.format_string("%d-%d", "conv_id", "turn").alias("content_id"), noisy.alias("response"))


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    return fx.concepts(spark, d).select(F.concat(F.lit("C"), F.col("concept_id").cast("string")).alias("concept_id"), F.concat(F.lit("concept "), F.col("concept_id").cast("string")).alias("concept_name"))


@query("l1_requests")
def l1(spark, d):
    """A request for every document, whole texts up to the limit of a request."""
    docs = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("content_id"), T.title_guess(F.col("text")).alias("title"), F.col("source").alias("topic"), F.col("lang").alias("subtopic"), F.lit("básico").alias("difficulty"), F.lit(None).cast("string").alias("learning_objective"),
        F.filter(F.split("text", "\n"), lambda x: F.length(x).between(5, 60)).alias("headings"), F.array().cast("array<struct<type:string,entries:array<struct<term:string,definition:string>>>>").alias("blocks"), "text",
    )
    return enrich.requests(docs, _concepts(spark, d))


@query("l2_validation")
def l2(spark, d):
    out = enrich.validate(_responses(spark, d), _concepts(spark, d))
    return out.select("content_id", "ok", F.array_join("errors", ",").alias("errors"), F.size("data.quiz").alias("n_quiz"))


@query("r7_quarantine", r""", c AS (SELECT *, conv_id * 31 + turn AS t FROM conversations), e AS (SELECT conv_id || '-' || turn AS content_id, CASE WHEN t % 11 = 0 THEN 'no object' ELSE concat_ws(',',
  CASE WHEN coalesce(length(trim(text)), 0) < 20 THEN 'tldr' END, CASE WHEN coalesce(len(string_split_regex(text, '[.!?]\s+')), 0) NOT BETWEEN 2 AND 6 THEN 'key_points' END, CASE WHEN t % 7 = 0 THEN 'correct_index' END) END AS reason FROM c)
SELECT content_id, reason FROM e WHERE reason <> ''""")
def r7(spark, d):
    """Responses that are put aside, with the reason."""
    return enrich.quarantine(enrich.checked(_responses(spark, d), _concepts(spark, d))).select("content_id", "reason")


@query("l4_outcome")
def l4(spark, d):
    return enrich.outcome(enrich.validate(_responses(spark, d), _concepts(spark, d)))


@query("l4_errors")
def l4e(spark, d):
    return enrich.error_list(enrich.validate(_responses(spark, d), _concepts(spark, d)))


@query("l5_quiz_by_concept")
def l5(spark, d):
    return enrich.quiz_by_concept(enrich.validate(_responses(spark, d), _concepts(spark, d)))


@query("z1_exposure_windows", " SELECT date_trunc('hour', ts) AS start, event, count(*) AS n, count(*) FILTER (event <> 'disliked') AS engaged FROM interactions GROUP BY ALL")
def z1(spark, d):
    return exposure.exposure_counts(fx.interactions(spark, d))
