"""Incremental ingestion: new or changed text files of a folder, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def watch(spark: SparkSession, folder: str, checkpoint: str, on_pages, once: bool = True):
    """Call on_pages(pages, batch_id) with source, page, text of the files that came; returns the streaming query."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    pages = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.lit(1).alias("page"), F.col("value").alias("text"))

    def run(batch: DataFrame, batch_id: int) -> None:
        on_pages(batch, batch_id)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
