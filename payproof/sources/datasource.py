"""Tables of the payroll database as a data source of Spark, read through any DB-API module.

A run reads one year. The condition on it is part of every query that the source sends, also for lines, which have no period
of their own; lines of other years never leave the database. With a numeric key the rows are read in ranges
between its least and greatest value among those that pass, one task each.

The condition is an option of the read and is not left to the planner: Spark 4.1 keeps what one query pushed into a Python source for
later queries of the same DataFrame, which would then miss rows.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from payproof.sources.database import KINDS, LINE_TABLE, SETTLEMENT_COLUMNS, SETTLEMENT_KEY, SETTLEMENT_TABLE, table_schema

NAME = "payroll_database"
#: Rows of one fetch.
FETCH_ROWS = 20_000

#: Placeholders of the parameter styles of DB-API that take values in order.
PLACEHOLDERS = {"qmark": "?", "format": "%s", "pyformat": "%s"}

Condition = tuple[str, tuple]


@dataclass
class KeyRange(InputPartition):
    """Rows with a key from ``low`` to below ``high``; open where None, and with null keys where ``low`` is."""

    low: int | None = None
    high: int | None = None


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def year_condition(table: str, year: int) -> Condition | None:
    """What holds for the rows of a year, as text with ``?`` for values; None for tables that have no period."""
    of_year = f"{quoted(SETTLEMENT_COLUMNS['year'])} = ?"
    for kind in KINDS:
        headers = SETTLEMENT_TABLE.format(kind=kind)
        if table == headers:
            return of_year, (year,)
        if table == LINE_TABLE.format(kind=kind):
            key = quoted(SETTLEMENT_KEY)
            return f"{key} IN (SELECT {key} FROM {quoted(headers)} WHERE {of_year})", (year,)
    return None


class PayrollReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self._options = options
        self._schema = schema

    def _connect(self):
        module, _, function = self._options["connect"].partition(":")
        return getattr(importlib.import_module(module), function or "connect")(**json.loads(self._options.get("arguments", "{}")))

    @property
    def _mark(self) -> str:
        module = importlib.import_module(self._options["connect"].partition(":")[0])
        return PLACEHOLDERS[self._options.get("paramstyle") or getattr(module, "paramstyle", "qmark")]

    def query(self, columns: list[str], within: KeyRange | None = None) -> Condition:
        """The text of the query and its values."""
        conditions = [tuple(json.loads(self._options["condition"]))] if "condition" in self._options else []
        if within is not None and (key := self._options.get("key")):
            key = quoted(key)
            if within.high is not None:
                below = f"{key} < ?"
                conditions.append((below if within.low is not None else f"({below} OR {key} IS NULL)", (within.high,)))
            if within.low is not None:
                conditions.append((f"{key} >= ?", (within.low,)))
        where = " WHERE " + " AND ".join(text for text, _ in conditions) if conditions else ""
        values = tuple(v for _, more in conditions for v in more)
        return f"SELECT {', '.join(columns)} FROM {quoted(self._options['table'])}{where.replace('?', self._mark)}", values

    def partitions(self) -> list[KeyRange]:
        key, n = self._options.get("key"), int(self._options.get("partitions", "1"))
        if not key or n <= 1:
            return [KeyRange()]
        connection = self._connect()
        try:
            cursor = connection.cursor()
            cursor.execute(*self.query([f"min({quoted(key)})", f"max({quoted(key)})"]))
            low, high = cursor.fetchone()
        finally:
            connection.close()
        if low is None:
            return [KeyRange()]
        n = min(n, high - low + 1)
        edges = [low + (high - low + 1) * i // n for i in range(1, n)]
        return [KeyRange(a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self._schema)
        connection = self._connect()
        try:
            cursor = connection.cursor()
            cursor.execute(*self.query([quoted(f.name) for f in self._schema.fields], partition))
            while rows := cursor.fetchmany(FETCH_ROWS):
                columns = zip(*rows, strict=True)
                arrays = [_array(list(values), field.type) for values, field in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            connection.close()


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Amounts of databases without decimals come as floating point or text, and are taken by their shortest text."""
    if pa.types.is_decimal(kind) and any(isinstance(v, float | int | str) for v in values):
        return pa.array([None if v is None else str(v) for v in values], pa.string()).cast(kind)
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else bool(v) for v in values], kind)
    if pa.types.is_date(kind) and any(isinstance(v, str) for v in values):
        return pa.array([v and v[:10] for v in values], pa.string()).cast(kind)
    return pa.array(values, kind)


class PayrollDatabase(DataSource):
    """Options: ``connect`` (``module:function`` of a DB-API module), ``arguments`` (JSON), ``table``, ``condition`` (text and
    values, JSON), ``key``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: T.StructType) -> PayrollReader:
        return PayrollReader(dict(self.options), schema)


def read_database(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    connect: str,
    arguments: dict | None = None,
    condition: Condition | None = None,
    key: str | None = None,
    partitions: int = 1,
) -> DataFrame:
    """The rows of a table that meet a condition, by the columns of ``schema``."""
    spark.dataSource.register(PayrollDatabase)
    options = {"connect": connect, "arguments": json.dumps(arguments or {}), "table": table}
    if condition is not None:
        options["condition"] = json.dumps(condition)
    if key is not None:
        options |= {"key": key, "partitions": str(partitions)}
    return spark.read.format(NAME).schema(schema).options(**options).load()


def payroll_database(
    spark: SparkSession, connect: str, arguments: dict | None = None, year: int | None = None, partitions: int = 1
) -> Callable[[str], DataFrame]:
    """Reads a table by name, for ``from_database``: headers and lines in ranges of their settlement, and only those of the
    year if one is given."""

    def table(name: str) -> DataFrame:
        schema = table_schema(name)
        key = SETTLEMENT_KEY if SETTLEMENT_KEY in schema.names else None
        condition = None if year is None else year_condition(name, year)
        return read_database(spark, name, schema, connect, arguments, condition, key, partitions)

    return table
