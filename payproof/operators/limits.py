"""Limits and allowances of the run as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof.functions.bounds import only_value, with_row
from payproof.params import ALLOWANCE_LIMITED, ALLOWANCE_LIMIT_RATE, AMOUNT_LIMITED, DEDUCTION_CODES, RunParams
from payproof.schemas import money


def limit_name(code: int) -> str:
    return f"limit_{DEDUCTION_CODES[code]}"


def family_allowances(personal: DataFrame, p: RunParams) -> DataFrame:
    """Personal allowances of the month: one row."""
    amounts = ("gni", "spouse", "child", "disabled_child")
    of_month = personal.where(
        (F.year("period") == p.year) & (F.month("period") == p.month) & (F.col("type") == 0)
    )
    return of_month.agg(
        *(only_value(F.col(name), f"allowance {name}").cast(money(12)).alias(name) for name in amounts)
    )


def deduction_limits(personal: DataFrame, general: DataFrame, p: RunParams) -> DataFrame:
    """All limits of the run side by side: one row, whatever the sheets hold."""
    by_code = general.where(F.year("period") == p.year).agg(
        *(
            only_value(F.when(F.col("code") == code, F.col("cap")), f"limit of deduction {code}")
            .cast(money(12))
            .alias(limit_name(code))
            for code in AMOUNT_LIMITED
        )
    )
    share = (F.col("gni") * F.lit(ALLOWANCE_LIMIT_RATE)).cast(T.DecimalType(16, 4))
    return with_row(family_allowances(personal, p), "by_code", by_code).select(
        "gni",
        "spouse",
        "child",
        "disabled_child",
        "by_code.*",
        *(share.alias(limit_name(code)) for code in ALLOWANCE_LIMITED),
    )


def single_cap(caps: DataFrame) -> DataFrame:
    """Contribution cap and floor of the month: one row."""
    return caps.agg(
        only_value(F.col("cap"), "contribution cap").alias("cap"),
        only_value(F.col("floor"), "contribution floor").alias("floor"),
    )
