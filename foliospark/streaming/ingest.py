"""Continuous ingest: new files become rows of pages. The engine keeps no state between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.documents import pdf_pages


def page_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of pages of the files that arrive in a folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.pdf")
        .option("maxFilesPerTrigger", files_a_trigger)
        .load(folder)
    )
    return pdf_pages(files.select(F.col("path").alias("doc_id"), "content"))
