"""Prerequisite graph: required and mastered concepts, qualified candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASTERY_EVENTS = ("completed", "quiz_passed")


def required(content_concepts: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """(content_id, required_concept_id): direct prerequisites of every directly covered concept."""
    direct = content_concepts.filter("coverage_type = 'directa'").select("content_id", "concept_id")
    return direct.join(prerequisites, "concept_id").select("content_id", F.col("prerequisite_concept_id").alias("required_concept_id")).distinct()


def mastered(events: DataFrame, content_concepts: DataFrame) -> DataFrame:
    """(user_id, concept_id) of contents that the user completed or passed."""
    done = events.filter(F.col("event").isin(*MASTERY_EVENTS)).select("user_id", "content_id").distinct()
    return done.join(content_concepts.filter("coverage_type = 'directa'").select("content_id", "concept_id"), "content_id").select("user_id", "concept_id").distinct()


def with_initial(earned: DataFrame, initial: DataFrame) -> DataFrame:
    """Union of earned and initial mastery (user_id, concept_id)."""
    return earned.unionByName(initial).distinct()


def qualify(candidates: DataFrame, required_concepts: DataFrame, mastered_concepts: DataFrame) -> DataFrame:
    """candidates (user_id, content_id, ...) with `qualified`: no required concept is missing."""
    have = mastered_concepts.select("user_id", F.col("concept_id").alias("required_concept_id"))
    missing = candidates.select("user_id", "content_id").join(required_concepts, "content_id").join(have, ["user_id", "required_concept_id"], "left_anti").select("user_id", "content_id").distinct()
    return candidates.join(missing.withColumn("missing", F.lit(True)), ["user_id", "content_id"], "left").withColumn("qualified", F.col("missing").isNull()).drop("missing")
