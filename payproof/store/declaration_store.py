"""Tax declarations, parsed once: only files that are new or changed since the last time are read and parsed.

A file holds one declaration, or several set apart by ``SEPARATOR``, and is known by its path, length and time of
modification. What was parsed stays in batches, named by a manifest, each with the files it was parsed from and the records
of these. The entries of a folder are the records of the files that are in it now, so those of removed files drop out.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.sources import declarations
from payproof.sources.tables import BYTE_ORDER_MARK, SEPARATOR
from payproof.store.manifest import Manifest

FILE = ("path", "length", "modificationTime")
FILES = "path STRING, length BIGINT, modificationTime TIMESTAMP"
#: Small files are read many to a task, large ones by their bytes.
TASK_FILES, TASK_BYTES = 1000, 2**24
RECORDS = FILES + ", tax_id STRING, " + ", ".join(
    f"{name} {kind}" for name, _, kind in declarations.DEPENDANT_COLUMNS + declarations.DEDUCTION_COLUMNS
)


class DeclarationStore:
    """What was parsed of the files of one folder, below ``path``."""

    def __init__(self, spark: SparkSession, folder: str, path: str, pattern: str = "*.xml"):
        self._spark, self._folder, self._pattern = spark, folder, pattern
        self.manifest = Manifest(spark, path)

    def _listed(self) -> DataFrame:
        """The files of the folder. Spark deals files to tasks by what it costs to open them; the listing opens none."""
        files = self._spark.read.format("binaryFile").option("pathGlobFilter", self._pattern).load(self._folder)
        return files.select(*FILE, F.col("_metadata.file_path").alias("uri")).coalesce(self._tasks())

    def _tasks(self, files: int = 0, size: int = 0) -> int:
        """Into how many tasks to gather the reading of so many files, of so many bytes in all."""
        return max(4 * self._spark.sparkContext.defaultParallelism, files // TASK_FILES + size // TASK_BYTES)

    def _landed(self, kind: str, schema: str) -> DataFrame:
        return self.manifest.read([name for name in self.manifest.entries() if name.startswith(f"{kind}/")], schema)

    def ingest(self) -> int:
        """Parse the files that are new or changed, and return how many these were.

        The listing opens no file, and of the others only those in the same span of time are read, declaration by declaration.
        A file that cannot be parsed fails the run, and nothing of the batch is kept.
        """
        # No anti join: that would be moved below the listing's gathering into few tasks.
        landed = self._landed("files", FILES).withColumn("landed", F.lit(True))
        fresh = self._listed().join(landed, list(FILE), "left").where("landed IS NULL").drop("landed")
        batch = self.manifest.new_folder()
        files = posixpath.join(batch, "files")
        fresh.write.parquet(files)
        fresh = self._spark.read.schema(f"{FILES}, uri STRING").parquet(files)
        time = F.col("modificationTime")
        span = fresh.agg(
            F.count("*").alias("n"), F.sum("length").alias("size"), F.min(time).alias("a"), F.max(time).alias("b")
        ).first()
        if span.n == 0:
            return 0
        read = self._spark.read.text(self._folder, lineSep=SEPARATOR, pathGlobFilter=self._pattern).select(
            F.col("value").cast("binary").alias("content"),
            F.col("_metadata.file_path").alias("uri"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_modification_time").alias("modificationTime"),
        )
        texts = (
            read.where(time.between(F.lit(span.a), F.lit(span.b)))
            .coalesce(self._tasks(span.n, span.size))
            .join(fresh, ["uri", "length", "modificationTime"])
            .select(*FILE, F.ltrim(F.decode("content", "UTF-8"), F.lit(BYTE_ORDER_MARK)).alias("xml"))
        )
        records = posixpath.join(batch, "records")
        declarations.f572_entries(texts, keep=FILE).write.parquet(records)
        name = posixpath.basename(batch)
        self.manifest.commit({f"files/{name}": files, f"records/{name}": records})
        return span.n

    def entries(self) -> DataFrame:
        """Dependants and deductions of the files that are in the folder now, as of their last ingestion."""
        now = self._listed().select(*FILE)
        return self._landed("records", RECORDS).join(now, list(FILE), "left_semi").drop(*FILE)
