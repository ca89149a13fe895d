"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins carry no hints; size and skew are decided at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Join lines to headers by hash where each part of the headers fits in memory: the lines stay unsorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Split a hot key also where the split costs one more shuffle of the joined rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Sums must raise on overflow rather than turn into null, which would hide a failed control.
    "spark.sql.ansi.enabled": "true",
    # The JVM does not compile methods beyond 8000 bytes; the widest projections of the income tax run
    # twice as fast when Spark splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The income tax alone compiles a hundred classes; a cache of that size is emptied by each run and filled again.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # Plans are built of thousands of columns; noting the line of code of each takes a third of the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
