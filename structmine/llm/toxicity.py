"""Toxicity severity: cumulative-link ordinal regression over sparse words.

Severity: 0 not toxic, 1 toxic, 2 toxic and of low quality.  Features are words that pass a score
test, weighted once for all thresholds.  Every text gets its expected severity and the probability of
severity 1 or more, and is marked where that reaches ``least``.

Edge cases: a null or empty text has no features and is judged by the thresholds alone; ratings with
a null mark are left out; with no ratings or one severity only, every text has that severity (0 where
there is none); repeated rows are scored each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import ordinal

#: Few texts are toxic, so the probability of one that is stays below a half where its words are rare.
LEAST = 0.15
DIMENSION = 1 << 18
SCREEN = 5.0
RIDGE = 1e-6


def severities(labels: DataFrame) -> DataFrame:
    quality = F.coalesce(F.col("quality"), F.lit(1))
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(quality == 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> ordinal.OrdinalModel:
    return ordinal.train(docs, severities(labels), "words", sample, DIMENSION, RIDGE, SCREEN)


def score(docs: DataFrame, model: ordinal.OrdinalModel, least: float = LEAST) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, toxic`` for every row."""
    scored = ordinal.score(docs, model, 1, "expected_severity", "p_toxic")
    return scored.withColumn("toxic", F.col("p_toxic") >= least)
