"""Quality classifier: cumulative-link ordinal regression on graded ratings.

Grades: 0 of low quality, 1 of good quality but toxic, 2 good and not toxic.  Every text gets its
expected grade and the probability of grade 1 or more; it is selected where that reaches ``least``.

Edge cases: a null or empty text has no features and gets the grade of the thresholds alone; ratings
with a null are left out (a null toxic mark counts as 0); with no ratings every grade is 0 with tail
probability 0 for grade 1, so ``select`` keeps all (nothing is known against a document); repeated
rows are scored and kept each; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import ordinal

LEAST = 0.5


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from the ``quality`` and ``toxic`` marks."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    grade = F.when(F.col("quality") == 0, 0).when(toxic == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = ordinal.SAMPLE) -> ordinal.OrdinalModel:
    return ordinal.train(docs, grades(labels), "structure", sample)


def score(docs: DataFrame, model: ordinal.OrdinalModel, least: float = LEAST) -> DataFrame:
    """``doc_id, expected_grade, p_good, selected`` for every row."""
    scored = ordinal.score(docs, model, 1, "expected_grade", "p_good")
    known = len(model.grades) > 1
    return scored.withColumn("selected", (F.col("p_good") >= least) if known else F.lit(True))


def select(docs: DataFrame, model: ordinal.OrdinalModel, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that are selected, with their columns.

    Decided row by row in one pass: nothing is joined, so repeated ids keep their own verdicts.
    """
    return ordinal.filtered(docs, model, 1, least) if len(model.grades) > 1 else docs
