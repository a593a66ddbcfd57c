"""Store analytics: summary, skill frequency, budget distribution (A1–A3).

All three are single hash aggregations with map-side partial aggregation,
so a skill held by a third of all rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.operators.reads import analytics_jobs

QUERY_NAMES = ("summary", "skills", "jobs", "budgets")


def summary(spark: SparkSession, jobs: DataFrame | None, job_skills: DataFrame | None) -> DataFrame:
    """A1: row counts of both tables; a missing table counts 0.

    One aggregation over the union of both key columns, no join.
    """
    parts = []
    if jobs is not None:
        parts.append(jobs.select(F.lit(1).alias("j"), F.lit(0).alias("s")))
    if job_skills is not None:
        parts.append(job_skills.select(F.lit(0).alias("j"), F.lit(1).alias("s")))
    if not parts:
        parts.append(spark.range(0).select(F.lit(0).alias("j"), F.lit(0).alias("s")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.agg(
        F.coalesce(F.sum("j"), F.lit(0)).cast("long").alias("jobs"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("skills"),
    )


def skill_frequency(job_skills: DataFrame) -> DataFrame:
    """A2: jobs per skill, most frequent first, ties by skill."""
    return (
        job_skills.groupBy("skill")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("skill").asc())
    )


def budget_type() -> F.Column:
    """Fixed if a fixed amount exists, else hourly if a bound exists, else unknown."""
    return (
        F.when(F.col("fixed_amount").isNotNull(), F.lit("fixed"))
        .when(F.col("hourly_min").isNotNull() | F.col("hourly_max").isNotNull(), F.lit("hourly"))
        .otherwise(F.lit("unknown"))
    )


def budgets(jobs: DataFrame) -> DataFrame:
    """A3: count and null-ignoring bounds per budget class."""
    return (
        jobs.groupBy(budget_type().alias("budget_type"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("hourly_min").alias("min_hourly_min"),
            F.max("hourly_max").alias("max_hourly_max"),
            F.min("fixed_amount").alias("min_fixed_amount"),
            F.max("fixed_amount").alias("max_fixed_amount"),
        )
        .orderBy("budget_type")
    )


def run_query(spark: SparkSession, name: str, jobs: DataFrame | None, job_skills: DataFrame | None,
              skill: str | None = None, title: str | None = None, limit: int | None = None,
              exact_casefold: bool = False) -> DataFrame:
    """Analytics dispatcher; an unknown name is a ``ValueError``."""
    if name == "summary":
        return summary(spark, jobs, job_skills)
    if name == "skills":
        return skill_frequency(job_skills)
    if name == "jobs":
        return analytics_jobs(jobs, job_skills, skill=skill, title=title, limit=limit, exact_casefold=exact_casefold)
    if name == "budgets":
        return budgets(jobs)
    raise ValueError(f"unknown analytics query: {name}")
