"""Extraction over folders that files keep arriving in.

A file is extracted on its own, so no state and no watermark are needed: every
micro-batch is an ordinary extraction.  A batch's rows go to a folder of its
number, written over if the batch is run again, so that each file counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.extract import Extraction

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (doc_id, content) of the folder's files, old and new."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return found.select(F.col("path").alias("doc_id"), "content")


def stream_docs(files: DataFrame, **options) -> DataFrame:
    """A stream of the documents' rows, errors included."""
    return Extraction(files, **options).docs()


def write_stream(files: DataFrame, output: str, checkpoint: str, tables=("docs", "lines"), trigger=None, **options):
    """Starts a query that writes tables of every batch below ``output``; returns it."""

    def batch(df, number):
        found = Extraction(df, keep=len(tables) > 1, **options)
        for t in tables:
            getattr(found, t)().write.mode("overwrite").parquet(f"{output}/{t}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
