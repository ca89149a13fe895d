"""A payroll landed month by month, with what the reports need of a month computed once, when it is landed.

Next to the lines, a month has two entries in a manifest: the sums of its lines by employee and item, and bitmaps of the
employees that have lines. Both are exact and can be merged: a year is the months added up, and the bitmaps of its months
or-ed. Landing a month computes its own entries and leaves all others, and one commit puts them in place together. The item
parameters are not part of the sums, so a changed sheet does not make them stale.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.functions.money import sum_when
from payproof.params import RunParams
from payproof.sources.payroll import of_type, to_date
from payproof.store.bucketed import BucketedLines, Month, of_months
from payproof.store.manifest import Manifest

SUMS = (
    "employee_id BIGINT, settlement_type STRING, year INT, month INT, item_id BIGINT, lines BIGINT, "
    "earning DECIMAL(24,2), deduction DECIMAL(24,2)"
)
SETTLED = "settlement_type STRING, year INT, month INT, bucket BIGINT, employees BINARY"


def monthly_sums(lines: DataFrame) -> DataFrame:
    """Lines with headers summed to employee, month and item."""
    return lines.groupBy("employee_id", "settlement_type", "year", "month", "item_id").agg(
        F.count("*").alias("lines"),
        sum_when(F.lit(True), "earning").alias("earning"),
        sum_when(F.lit(True), "deduction").alias("deduction"),
    )


def settled_bitmaps(sums: DataFrame) -> DataFrame:
    """The employees of each month as bitmaps of 32768 numbers each, by settlement type."""
    return sums.groupBy("settlement_type", "year", "month", F.bitmap_bucket_number("employee_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("employee_id")).alias("employees")
    )


def bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set: the byte that holds it, and the bit in that byte."""
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def in_bitmaps(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``df`` whose employee is in the bitmaps (bucket, employees; a bucket once)."""
    bits = bitmaps.select(F.col("bucket").alias("own_bucket"), F.col("employees").alias("own_bits"))
    joined = df.join(bits, F.bitmap_bucket_number("employee_id") == F.col("own_bucket"))
    return joined.where(bit_is_set(F.col("own_bits"), F.bitmap_bit_position("employee_id"))).select(*df.columns)


class PayrollStore:
    """Everything below ``path``: bucketed headers and lines, sums and bitmaps by month, and the manifest that names them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self._spark = spark
        self.lines = BucketedLines(spark, posixpath.join(path, "tables"), buckets)
        self.manifest = Manifest(spark, posixpath.join(path, "monthly"))

    @staticmethod
    def _entries(kind: str, months: Iterable[Month]) -> dict[Month, str]:
        return {(year, month): f"{kind}/{year:04d}-{month:02d}" for year, month in months}

    def land(self, settlements: DataFrame, lines: DataFrame, months: Iterable[Month] | None = None) -> None:
        """Land some months, or all. Sums and bitmaps are computed from the landed lines of these months and no others."""
        months = None if months is None else sorted(set(months))
        self.lines.land(settlements, lines, months)
        stale = self.manifest.entries() if months is None else {}
        months = self.lines.months() if months is None else months
        if not months:
            self.manifest.commit({}, stale)
            return
        sums = self._written(monthly_sums(self.lines.joined(of_months(months))), "sums", months, SUMS)
        of_employees = self._spark.read.schema(SUMS).parquet(*sorted(set(sums.values())))
        bitmaps = self._written(settled_bitmaps(of_employees), "settled", months, SETTLED)
        self.manifest.commit(sums | bitmaps, stale)

    def _written(self, rows: DataFrame, kind: str, months: list[Month], schema: str) -> dict[str, str]:
        """Write the rows, a directory for each month, and return the entries. A month without rows gets one as well."""
        folder = self.manifest.new_folder()
        by_month = rows.withColumns({"of_year": F.col("year"), "of_month": F.col("month")})
        by_month.hint("rebalance", "of_year", "of_month").write.partitionBy("of_year", "of_month").parquet(folder)
        found = self._spark.read.schema(f"{schema}, of_year INT, of_month INT").parquet(folder)
        have = {tuple(r) for r in found.select("of_year", "of_month").distinct().collect()}
        none = self.manifest.new_folder()
        if len(have) < len(months):
            self._spark.createDataFrame([], schema).write.parquet(none)
        return {
            name: posixpath.join(folder, f"of_year={month[0]}", f"of_month={month[1]}") if month in have else none
            for month, name in self._entries(kind, months).items()
        }

    def sums(self, p: RunParams) -> DataFrame:
        """Sums of the year up to the month of the run: read by the files of these months."""
        names = self._entries("sums", ((p.year, month) for month in range(1, p.month + 1))).values()
        return self.manifest.read(names, SUMS).where(to_date(p))

    def settled(self, p: RunParams) -> DataFrame:
        """bucket, employees: who has lines in the year of the run."""
        names = self._entries("settled", ((p.year, month) for month in range(1, 13))).values()
        of_year = self.manifest.read(names, SETTLED).where(of_type(p) & (F.col("year") == p.year))
        return of_year.groupBy("bucket").agg(F.bitmap_or_agg("employees").alias("employees"))

    def attributes_of_settled(self, profiles: DataFrame, p: RunParams) -> DataFrame:
        """Profiles of the employees with lines in the year; no line is read for it."""
        return in_bitmaps(profiles, self.settled(p))
