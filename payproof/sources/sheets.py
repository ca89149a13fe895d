"""Parameter sheets: every column typed, only the rows of the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.params import NO_SUBCATEGORY, RunParams
from payproof.schemas import money


def _in_year(p: RunParams) -> Column:
    return F.year("period") == p.year


def _month_or_final(p: RunParams) -> Column:
    """Rows of the month, plus the rows a leaver's final settlement uses."""
    month = F.month("period")
    kind = F.col("type").cast("int")
    return _in_year(p) & ((month == p.month) | ((month == 12) & (kind == 1)) | (kind == 2))


def item_parameters(sheet: DataFrame) -> DataFrame:
    """How each item counts: category, subcategory, income-tax class, base flags."""
    return sheet.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.col("name").cast("string").alias("name"),
        F.col("category").cast("string").alias("category"),
        F.coalesce(F.col("subcategory").cast("string"), F.lit(NO_SUBCATEGORY)).alias("subcategory"),
        F.col("tax_class").cast("string").alias("tax_class"),
        F.col("r4r8").cast("string").alias("r4r8"),
        F.col("r9").cast("boolean").alias("r9"),
    )


def contribution_caps(sheet: DataFrame, p: RunParams) -> DataFrame:
    """Cap and floor of the contribution base in the month."""
    return sheet.where(_in_year(p) & (F.month("period") == p.month)).select(
        F.col("period").cast("date").alias("period"),
        F.col("cap").cast(money(14)).alias("cap"),
        F.col("floor").cast(money(10)).alias("floor"),
    )


def tax_brackets(sheet: DataFrame, p: RunParams) -> DataFrame:
    """Progressive income-tax scale."""
    return sheet.where(_month_or_final(p)).select(
        F.col("period").cast("date").alias("period"),
        F.col("lower").cast(money(14)).alias("lower"),
        F.col("upper").cast(money(14)).alias("upper"),
        F.col("fixed").cast(money(10)).alias("fixed"),
        F.col("rate").cast("int").alias("rate"),
        F.col("excess").cast(money(10)).alias("excess"),
        F.col("pct_code").cast("int").alias("pct_code"),
        F.col("type").cast("int").alias("type"),
    )


def personal_deduction_params(sheet: DataFrame, p: RunParams) -> DataFrame:
    """Personal allowances: non-taxable income, special, family."""
    amounts = ("gni", "special", "spouse", "child", "disabled_child")
    return sheet.where(_month_or_final(p)).select(
        F.col("period").cast("date").alias("period"),
        *(F.col(name).cast(money(10)).alias(name) for name in amounts),
        F.col("type").cast("int").alias("type"),
    )


def general_deduction_params(sheet: DataFrame, p: RunParams) -> DataFrame:
    """Limits of the general deductions in the year."""
    return sheet.where(_in_year(p)).select(
        F.col("period").cast("date").alias("period"),
        F.col("deduction").cast("string").alias("deduction"),
        F.col("code").cast("int").alias("code"),
        F.col("type").cast("string").alias("type"),
        F.col("cap").cast(money(12)).alias("cap"),
        F.col("pct").cast("int").alias("pct"),
    )
