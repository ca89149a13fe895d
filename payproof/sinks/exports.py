"""Writing what a run produced: one dataset directory per report."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_items(items: DataFrame, path: str) -> None:
    """All catalogue items, or those without parameters."""
    write_csv(items.select("item_id", "name"), path)


def write_lines(lines: DataFrame, path: str, by_type: bool = False, keep_others: bool = False) -> None:
    """Lines as Parquet by period, and by settlement type before that if asked.

    The rebalance gives each period files of a readable size, and splits a period that is too large for a task.
    With ``keep_others`` only the periods that have lines are replaced.
    """
    periods = (["settlement_type"] if by_type else []) + ["year", "month"]
    mode = "dynamic" if keep_others else "static"
    writer = lines.hint("rebalance", *periods).write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(*periods).parquet(path)


def write_reports(reports: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Each report in its own directory under ``path``, as Parquet or CSV; returns the directories."""
    written = {}
    for name, df in reports.items():
        written[name] = posixpath.join(path, name)
        if fmt == "csv":
            write_csv(df, written[name])
        else:
            df.write.mode("overwrite").format(fmt).save(written[name])
    return written
