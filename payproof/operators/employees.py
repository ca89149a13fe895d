"""From line sums to employees.

The controls sum lines per employee first, combined before the shuffle, and only then join names, tax ids and
labour attributes. The joins run at employee grain, and an employee with very many lines is one row there.
An employee with several rows on the joined side (two tax ids, two labour rows) counts once per row, as when
the lines themselves were joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.schemas import money

ROWS = "attribute_rows"


def sums_by_employee(lines: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return lines.groupBy("employee_id").agg(*(col.alias(name) for name, col in measures.items()))


def resum(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add up the rows that the joins gave a key. Keys that contain the employee need no new shuffle.

    The cast keeps room for the decimals of later steps, which a 38-digit sum would have to give up. ``watch`` is given the
    result with one more column, ``ROWS``, of how many rows each key had.
    """
    sums = [F.sum(name).cast(money(24)).alias(name) for name in measures]
    if watch is None:
        return df.groupBy(*keys).agg(*sums)
    return watch(df.groupBy(*keys).agg(*sums, F.count("*").alias(ROWS))).drop(ROWS)
