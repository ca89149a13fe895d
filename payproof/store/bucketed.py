"""Headers and lines of settlements, landed so that they join where they lie.

Both are tables by year and month, bucketed by settlement, so a run reads the directories of its months and joins bucket to
bucket, without a shuffle. A settlement of very many lines is dealt to several parts, and its header is in each of them, so
no bucket gets more than a share of one settlement. Landing is the only time that lines are shuffled.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.functions.money import zero
from payproof.params import RunParams
from payproof.schemas import money
from payproof.sources.payroll import line_keys, to_date

#: Lines of one part of a settlement, about.
PART_LINES = 100_000

#: What both tables are bucketed and joined by. The period is part of it, so a settlement that moved to another month
#: meets only the lines that were landed with it.
KEY = ("settlement_id", "settlement_type", "period", "part")
_KEY = "settlement_id BIGINT, settlement_type STRING, period INT, part INT, "
COLUMNS = {
    "headers": _KEY + "employee_id BIGINT, kind INT",
    "lines": _KEY + "item_id BIGINT, quantity DECIMAL(14,2), earning DECIMAL(14,2), deduction DECIMAL(14,2), item_name STRING",
}
PERIOD = ("year", "month")

Month = tuple[int, int]


def of_months(months: Iterable[Month]):
    """Rows of some months."""
    found = F.lit(False)
    for year, month in months:
        found = found | ((F.col("year") == year) & (F.col("month") == month))
    return found


class BucketedLines:
    """Two tables below ``path``. The catalog knows them by names that follow from the path; a session whose catalog does
    not registers them from the files. The number of buckets is that of the first landing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, part_lines: int = PART_LINES):
        self._spark, self._buckets, self._part_lines = spark, buckets, part_lines
        mark = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]
        self._tables = {name: f"payproof_{name}_{mark}" for name in COLUMNS}
        for name, columns in COLUMNS.items():
            table, folder = self._tables[name], posixpath.join(path, name)
            if not spark.catalog.tableExists(table):
                # Makes the directory where there is none; it holds no partition then.
                spark.createDataFrame([], columns).write.mode("ignore").parquet(folder)
                spark.sql(
                    f"CREATE TABLE {table} ({columns}, year INT, month INT) USING parquet PARTITIONED BY (year, month) "
                    f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS "
                    f"LOCATION '{folder}'"
                )
                spark.catalog.recoverPartitions(table)

    def land(self, settlements: DataFrame, lines: DataFrame, months: Iterable[Month] | None = None) -> None:
        """Write the settlements of some months, or of all, with their lines.

        What the tables hold of the same months is replaced, also where nothing is left of it. Other months stay.
        """
        headers = settlements.select("settlement_id", "settlement_type", "employee_id", "kind", *PERIOD)
        if months is not None:
            months = list(months)
            headers = headers.where(of_months(months))
        headers = headers.withColumn("period", F.col("year") * 100 + F.col("month"))
        keys = line_keys(lines)
        hot = (
            lines.select(*keys)
            .join(headers.select(*keys), keys, "left_semi")
            .groupBy(*keys)
            .agg(F.ceil(F.count("*") / self._part_lines).cast("int").alias("parts"))
            .where("parts > 1")
        )
        headers = headers.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        in_parts = headers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        self._write("headers", in_parts, months)
        amounts = [F.coalesce(F.col(name).cast(money(14)), zero(14)).alias(name) for name in ("earning", "deduction")]
        joined = lines.select(*keys, "item_id", "quantity", *amounts, "item_name").join(
            headers.select("settlement_id", "settlement_type", "period", *PERIOD, "parts"), keys
        )
        # The part of a line follows from its columns, so a task that runs again deals it the same way.
        part = F.pmod(F.xxhash64("item_id", "quantity", "earning", "deduction", "item_name"), F.col("parts")).cast("int")
        self._write("lines", joined.withColumn("part", part), months)

    def _write(self, name: str, rows: DataFrame, months: list[Month] | None) -> None:
        """A bucket of a month is written by one task, or by several where it is large."""
        table = self._tables[name]
        columns = [c for c in self._spark.table(table).columns if c not in PERIOD]
        rows = rows.select(*columns, *PERIOD, F.pmod(F.hash(*KEY), F.lit(self._buckets)).alias("bucket"))
        if months is None:
            rows.hint("rebalance", *PERIOD, "bucket").drop("bucket").write.mode("overwrite").insertInto(table)
            return
        for year, month in months:
            # Named partitions, as only these are emptied if no row is left of them.
            of_month = rows.where(of_months([(year, month)])).hint("rebalance", "bucket").select(*columns)
            self._spark.sql(
                f"INSERT OVERWRITE TABLE {table} PARTITION (year = {int(year)}, month = {int(month)}) SELECT * FROM {{rows}}",
                rows=of_month,
            )

    @property
    def settlements(self) -> DataFrame:
        """Every landed settlement once."""
        return self._spark.table(self._tables["headers"]).where("part = 0").drop("part", "period")

    def months(self) -> list[Month]:
        """The months that have settlements."""
        return sorted((r.year, r.month) for r in self.settlements.select(*PERIOD).distinct().collect())

    def joined(self, condition) -> DataFrame:
        """Lines with their headers, where a condition on settlement type, year and month holds.

        The tables join by what they are bucketed by, and by nothing else, as they would be shuffled otherwise.
        """
        headers = self._spark.table(self._tables["headers"]).where(condition)
        lines = self._spark.table(self._tables["lines"]).where(condition).drop(*PERIOD)
        return headers.join(lines, list(KEY)).select(
            "employee_id",
            "settlement_id",
            "kind",
            "settlement_type",
            "year",
            "month",
            "item_id",
            "quantity",
            "earning",
            "deduction",
            "item_name",
        )

    def period_lines(self, p: RunParams) -> DataFrame:
        """Lines of the year up to the month of the run, with their headers."""
        return self.joined(to_date(p))
