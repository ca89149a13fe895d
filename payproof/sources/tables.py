"""Readers for payroll tables, parameter sheets and tax declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof.schemas import DECLARATIONS

BYTE_ORDER_MARK = "\ufeff"
#: Between the declarations of one file: a record separator, which no XML text can hold.
SEPARATOR = "\x1e"


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of the payroll database, read by one task per range of a numeric ``key`` between ``bounds``.

    Filters and column lists of the operators above it are pushed into the database query. The bounds only
    shape the ranges: rows outside them are read too, by the first and the last task.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if key is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs the bounds of its key")
        lower, upper = bounds
        reader = reader.options(
            partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def read_sheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parameter sheet saved as CSV with a header row; a malformed row fails the run."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_headed(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV, every column as text under its heading, in the order of the file."""
    return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """One row per declaration in the ``*.xml`` files of a folder; a file holds one, or several set apart by ``SEPARATOR``."""
    files = spark.read.text(path, lineSep=SEPARATOR, pathGlobFilter="*.xml")
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.ltrim(F.col("value"), F.lit(BYTE_ORDER_MARK)).alias("xml"),
    ).to(DECLARATIONS)
