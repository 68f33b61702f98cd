"""The scorecard of graded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scorecard(grades: DataFrame, good: int = 98, poor: int = 85) -> DataFrame:
    """One row over grades (id, overall): mean, least and most of overall grades other than 0; how many are good or poor.

    A missing grade counts as 0, and so as poor; it is left out of the mean.
    """
    graded = F.nullif(F.col("overall"), F.lit(0))
    o = F.coalesce("overall", F.lit(0))
    return grades.agg(F.count("*").alias("questions"), F.avg(graded).alias("mean_overall"), F.min(graded).alias("min_overall"), F.max(graded).alias("max_overall"), F.count_if(o >= good).alias("good"), F.count_if(o < poor).alias("poor"))


def weighted_overall(grades: DataFrame) -> DataFrame:
    """voice and grounding count twice: (2v + 2g + c + r + u) / 7, beside the grader's own overall grade."""
    return grades.withColumn("weighted", (2 * F.col("voice") + 2 * F.col("grounding") + F.col("citations") + F.col("recency") + F.col("usefulness")) / 7)


def pilot(questions: DataFrame, n: int = 5) -> DataFrame:
    return questions.orderBy("id").limit(n)
