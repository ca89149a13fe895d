"""Checks on the inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from payproof.operators.employees import ROWS


def duplicate_attributes(attributes: DataFrame) -> DataFrame:
    """Employees with several attribute rows: their sums would count once per row."""
    return attributes.groupBy("employee_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def attribute_watch(observation: Observation) -> Callable[[DataFrame], DataFrame]:
    """Observes, in the job that computes the rows anyway, the most attribute rows of an employee, and one who has them.

    Maxima only: a sort computes its input twice, once for a sample, and a count would be twice as high.
    """

    def watch(rows: DataFrame) -> DataFrame:
        return rows.observe(observation, F.max(F.struct(ROWS, "employee_id")).alias("most"))

    return watch
