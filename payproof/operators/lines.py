"""Settlement lines against the item catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.functions.money import sum_when
from payproof.params import CATEGORY_ORDER, RunParams
from payproof.sources.payroll import to_date

# What the controls read of a classified line.
LINE_GROUP = (
    "employee_id", "settlement_type", "year", "month", "category", "subcategory", "tax_class", "r9",
)


def unparametrized_items(items: DataFrame, parameters: DataFrame) -> DataFrame:
    """Catalogue items without parameters."""
    return items.select("item_id", "name").join(parameters.select("item_id"), "item_id", "left_anti")


def classify(lines: DataFrame, parameters: DataFrame) -> DataFrame:
    """Lines with the seven parameter columns of their item; null where the item has none.

    The catalogue carries no broadcast hint: Spark broadcasts it while it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond, splitting hot items at run time.
    """
    catalog = parameters.select(
        F.col("item_id").alias("catalog_item_id"),
        F.col("name").alias("catalog_item_name"),
        "category",
        "subcategory",
        "tax_class",
        "r4r8",
        "r9",
    )
    return lines.join(catalog, F.col("item_id") == F.col("catalog_item_id"), "left")


def compact_lines(classified: DataFrame, p: RunParams) -> DataFrame:
    """Classified lines summed to employee, month and item class.

    The controls are linear in the amounts, so they give the same result on this table as on the lines
    themselves. Several controls of one run should share it.
    """
    return (
        classified.where(to_date(p))
        .groupBy(*LINE_GROUP)
        .agg(
            sum_when(F.lit(True), "earning").alias("earning"),
            sum_when(F.lit(True), "deduction").alias("deduction"),
        )
    )


def category_rank(category: str = "category") -> Column:
    rank = F.lit(len(CATEGORY_ORDER) + 1)
    for i, name in reversed(list(enumerate(CATEGORY_ORDER, start=1))):
        rank = F.when(F.col(category) == name, i).otherwise(rank)
    return rank


def order_lines(enriched: DataFrame) -> DataFrame:
    """Presentation order. The last keys only break ties, so that one employee's lines can be split."""
    return enriched.withColumn("category_rank", category_rank()).orderBy(
        F.asc_nulls_last("month"),
        F.asc_nulls_last("surname"),
        F.asc_nulls_last("name"),
        F.asc_nulls_last("category_rank"),
        "settlement_id",
        "item_id",
    )
