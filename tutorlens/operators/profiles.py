"""Survey codes to user profiles, topic affinity and engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Right answers, and topic weights (base; adjustments by behaviour flag) in their published order.
RIGHT_ANSWERS = {"k0600": 3, "k0100": 3, "k1003": 1}
AFFINITY = {
    "planificación": (0.8, {}), "ahorro": (0.7, {"b0130a": 0.2, "a0320": 0.3}), "fraude": (0.7, {}), "deuda": (0.1, {"a0320": 1.0}), "crédito": (0.1, {"a0320": 0.8, "b1000b": 0.2}),
    "préstamos": (0.1, {"a0320": 0.6}), "tarjetas": (0.2, {"a0320": 0.4}), "cuentas bancarias": (0.3, {"b0130b": 0.5}), "hipotecas": (0.1, {"b0130b": 0.3}),
    "inversión": (0.05, {"b0130c": 1.0, "b0130b": 0.2, "a0320": -0.05}), "riesgo": (0.1, {"b0130c": 0.6}), "diversificación": (0.05, {"b0130c": 0.8}), "interés": (0.4, {"b0130b": 0.2}), "inflación": (0.3, {"a0320": 0.4}),
}
OTHER_TOPIC = 0.3


def coin(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the keys (md5, so that SQL engines repeat it)."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def draw(u: Column, options: list[tuple[str, float]]) -> Column:
    """The option that a number in [0, 1) falls on: inverse distribution, the last option takes what is left."""
    out = F.lit(options[-1][0])
    for i in range(len(options) - 2, -1, -1):
        out = F.when(u < round(sum(w for _, w in options[: i + 1]), 9), F.lit(options[i][0])).otherwise(out)
    return out


def answered(c: Column) -> Column:
    """Survey code with the missing codes as null."""
    return F.when(~c.isin(-97, -98, -99), c)


def flag(name: str) -> Column:
    return F.coalesce(answered(F.col(name)) == 1, F.lit(False))


def knowledge_level() -> Column:
    """null without an answer, bajo without a right one, alto if all answered ones are right, else medio."""
    valid = sum((answered(F.col(c)).isNotNull().cast("int") for c in RIGHT_ANSWERS), F.lit(0))
    right = sum((F.coalesce(answered(F.col(c)) == v, F.lit(False)).cast("int") for c, v in RIGHT_ANSWERS.items()), F.lit(0))
    return F.when(valid == 0, None).when(right == 0, "bajo").when(right == valid, "alto").otherwise("medio")


def user_profiles(survey: DataFrame, year: int = 2021) -> DataFrame:
    """Respondents of 18 to 34 years as users; a birth year that is missing leaves the row out. Debt, attitude and goal
    are drawn given the other columns, by coins of the respondent's number."""
    age = year - answered(F.col("a0400"))
    work, schooling, account = answered(F.col("a1500")), answered(F.col("e0100")), answered(F.col("b0130b"))
    known = survey.filter(age.between(18, 34)).select(
        "respondent", F.format_string("U%04d", "respondent").alias("user_id"), F.when(age <= 24, "18-24").otherwise("25-34").alias("age_group"),
        F.when(F.col("a0100") == 1, "hombre").when(F.col("a0100") == 0, "mujer").alias("sex"),
        F.when(schooling == 1, "posgrado").when(schooling == 2, "universidad").when(schooling == 3, "bachillerato").when(schooling == 5, "primaria").otherwise("secundaria").alias("education_level"),
        F.when(work == 9, "estudiante").when(work.isin(5, 8), "desempleado").otherwise("empleado").alias("employment_status"),
        knowledge_level().alias("financial_knowledge_level"), F.when(account == 1, "frecuente").when(account == 0, "ocasional").alias("saving_habit"),
        F.when(answered(F.col("b1000c")).isNull(), None).when(flag("b1000c"), "básica").otherwise("ninguna").alias("investment_experience"),
    )
    level, key = F.col("financial_knowledge_level"), F.col("respondent")
    behaviour = F.when(F.col("saving_habit") == "frecuente", "alto").when(F.col("saving_habit") == "ocasional", "medio")
    debt = F.when(level == "bajo", draw(coin(1, key), [("baja", 0.4), ("media", 0.6)])).when(level == "medio", draw(coin(1, key), [("ninguna", 0.5), ("baja", 0.5)])).otherwise("ninguna")
    attitude = F.when(level == "alto", "alto").when(level == "medio", draw(coin(2, key), [("medio", 0.7), ("alto", 0.3)])).when(level == "bajo", draw(coin(2, key), [("bajo", 0.6), ("medio", 0.4)]))
    goal = F.when(F.col("investment_experience") == "básica", "prepararse para invertir").when(F.col("debt_experience").isin("media", "alta"), "entender deuda")
    return (
        known.withColumn("financial_behavior_level", behaviour).withColumn("debt_experience", debt).withColumn("financial_attitude_level", attitude)
        .withColumn("learning_goal", goal.otherwise(draw(coin(3, key), [("presupuestar", 0.3), ("ahorrar", 0.4), ("planificar finanzas", 0.3)]))).drop("respondent")
    )


def answer_rates(survey: DataFrame) -> DataFrame:
    """(question, share_all, share_valid): right answers over everybody and over those who answered."""
    rows = F.array(*[F.struct(F.lit(c).alias("question"), F.coalesce(answered(F.col(c)) == v, F.lit(False)).alias("right"), answered(F.col(c)).isNotNull().alias("valid")) for c, v in RIGHT_ANSWERS.items()])
    return survey.select(F.explode(rows).alias("x")).select("x.*").groupBy("question").agg(F.round(F.count_if("right") / F.count("*"), 6).alias("share_all"), F.round(F.count_if("right") / F.count_if("valid"), 6).alias("share_valid"))


def valid_shares(survey: DataFrame, column: str, codes: list[int]) -> DataFrame:
    """(code, n, share) of the codes among the rows that have one of them."""
    n = survey.filter(F.col(column).isin(codes)).groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row a code


def topic_affinity(survey: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """(respondent, topic, affinity) in [0.05, 1]; others: topics without weights of their own."""
    weights = AFFINITY | {t: (OTHER_TOPIC, {}) for t in others}
    topics = [F.struct(F.lit(t).alias("topic"), (F.lit(base) + sum((F.when(flag(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in adj.items()), F.lit(0.0))).alias("x")) for t, (base, adj) in weights.items()]
    return survey.select("respondent", F.explode(F.array(*topics)).alias("t")).select("respondent", "t.topic", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("t.x"))), 6).alias("affinity"))


def preference(affinity: Column, difficulty: Column, penalty: Column | float = 0.0) -> Column:
    """Weight of a content: affinity and a boost by difficulty less a penalty, 0.05 at least."""
    boost = F.when(difficulty == "avanzado", 0.3).when(difficulty == "intermedio", 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.05), affinity + boost - penalty)


def weighted_pick(frame: DataFrame, key: str, item: str, weight: str, seed: int = 9) -> DataFrame:
    """(key, item): one row a key, picked by weight (smallest -ln(u) / weight, u a coin of both)."""
    order = F.struct(-F.log(coin(seed, F.col(key), F.col(item))) / F.col(weight), F.col(item))
    return frame.groupBy(key).agg(F.min_by(item, order).alias(item))


def knowledge_to_num(c: Column) -> Column:
    return F.when(c == "medio", 2).when(c == "alto", 3).otherwise(1)


def difficulty_to_num(c: Column) -> Column:
    return F.when(c == "básico", 1).when(c == "intermedio", 2).otherwise(3)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def propensities(gap: Column, affinity: Column) -> list[Column]:
    """Click, completion and quiz propensities from knowledge minus difficulty and affinity."""
    centred = affinity - 0.5
    return [F.round(sigmoid(a + b * gap + c * centred), 6).alias(n) for n, a, b, c in (("click", 1.5, 0.8, 0.5), ("complete", 1.0, 0.7, 0.3), ("quiz", 0.5, 0.6, 0.2))]


def event_label(completion: Column, quiz: Column, coin: Column) -> Column:
    """quiz_passed from quiz 0.6 on (completed instead where completion is 0.9 and the coin does not hold), completed from
    completion 0.9 on, disliked below 0.2, else viewed. A null quiz was not taken."""
    passed = F.coalesce(quiz >= 0.6, F.lit(False))
    return F.when(passed & ((completion < 0.9) | coin), "quiz_passed").when(completion >= 0.9, "completed").when(completion >= 0.5, "viewed").when(completion < 0.2, "disliked").otherwise("viewed")


def engagement(completion: Column, quiz: Column, luck: Column) -> Column:
    return F.round(0.4 * completion + 0.4 * F.coalesce(quiz, F.lit(0.0)) + 0.2 * luck, 3)
