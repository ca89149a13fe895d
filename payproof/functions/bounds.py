"""Small inputs: values of one row, and rows of a parameter sheet, as constants of the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A year of a parameter sheet has a few hundred rows at most.
SHEET_ROWS = 10_000


def with_row(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """``df`` with a struct column ``name`` holding the single row of ``one_row``.

    A scalar subquery: it runs once and its value becomes a constant of the plan, so no join is planned.
    Spark fails the query if there is more than one row.
    """
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def with_sheet(df: DataFrame, name: str, sheet: DataFrame, max_rows: int = SHEET_ROWS) -> DataFrame:
    """``df`` with an array column ``name`` of the rows of ``sheet``: a scalar subquery, as in ``with_row``.

    More than ``max_rows`` rows fail the query, so the constant stays small.
    """
    rows = F.collect_list(F.struct(*sheet.columns))
    too_many = F.raise_error(F.lit(f"{name}: more than {max_rows} rows"))
    # The limit leaves one row too many to raise on; no row of a sheet that is in bounds is left out.
    bounded = sheet.limit(max_rows + 1).agg(F.when(F.count("*") > max_rows, too_many).otherwise(rows).alias(name))
    return df.withColumn(name, bounded.scalar())


def only_match(sheet: Column, condition: Callable[[Column], Column], what: str) -> Column:
    """The one row of an array that fits, or null; raises when several do."""
    found = F.filter(sheet, condition)
    several = F.raise_error(F.lit(f"{what}: several rows of the sheet fit"))
    return F.when(F.size(found) > 1, several).otherwise(F.get(found, F.lit(0)))


def only_value(column: Column, what: str) -> Column:
    """Aggregate: the one distinct value of ``column``; raises when there is none or several."""
    low, high, n = F.min(column), F.max(column), F.count(column)
    return (
        F.when(n == 0, F.raise_error(F.lit(f"{what}: no value for this period")))
        .when(low != high, F.raise_error(F.lit(f"{what}: several values for this period")))
        .otherwise(low)
    )


def with_intervals(
    df: DataFrame, name: str, sheet: DataFrame, group: str, low: str, high: str, max_rows: int = SHEET_ROWS
) -> DataFrame:
    """``df`` with a struct column ``name``: the intervals ``low < x <= high`` of each group of ``sheet``, sorted once.

    A scalar subquery, as in ``with_sheet``, with the groups, the lower ends and the rows, in order of group and lower end.
    Intervals of one group that overlap fail the query; those that no value can lie in are left out.
    """
    following = F.lead(low).over(Window.partitionBy(group).orderBy(low, high))
    rows = sheet.limit(max_rows + 1).where(F.col(low) < F.col(high)).withColumn("overlaps", following < F.col(high))
    in_order = F.sort_array(F.collect_list(F.struct(group, low, high, *(c for c in sheet.columns if c not in (group, low, high)))))
    whole = rows.agg(F.count("*").alias("n"), F.max("overlaps").alias("overlaps"), in_order.alias("rows")).select(
        F.when(F.col("n") > max_rows, F.raise_error(F.lit(f"{name}: more than {max_rows} rows")))
        .when(F.col("overlaps"), F.raise_error(F.lit(f"{name}: intervals overlap")))
        .otherwise(F.struct(F.col(f"rows.{group}").alias("groups"), F.col(f"rows.{low}").alias("lows"), F.col("rows")))
        .alias(name)
    )
    return df.withColumn(name, whole.scalar())


def interval_of(df: DataFrame, name: str, index: str, group: str, value: str, high: str, max_rows: int = SHEET_ROWS) -> DataFrame:
    """``df`` with a struct column ``name``: the row of the interval that ``value`` lies in, null if there is none.

    Bisection in compiled expressions: each step asks whether the interval so many places on still begins below the value, and
    a later step names an earlier one, so none is evaluated twice.
    """
    steps, at = [], "0"
    for bit in reversed(range(max_rows.bit_length())):
        place = f"{at} + {(1 << bit) - 1}"
        before = (
            f"get({index}.groups, {place}) < {group} OR (get({index}.groups, {place}) = {group} AND get({index}.lows, {place}) < {value})"
        )
        steps.append(f"{at} + CASE WHEN {before} THEN {1 << bit} ELSE 0 END AS `{name}_{bit}`")
        at = f"`{name}_{bit}`"
    found = f"get({index}.rows, {at} - 1)"
    fits = f"CASE WHEN {found}.{group} = {group} AND {value} <= {found}.{high} THEN {found} END AS `{name}`"
    return df.selectExpr("*", *steps, fits).select(*df.columns, name)
