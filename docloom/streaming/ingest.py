"""Incremental ingest and arrival statistics as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.chunking import chunk_documents, clean_documents


def first_deliveries(documents: DataFrame, late: str = "7 days", time: str = "loaded_at") -> DataFrame:
    """Documents delivered again unchanged within ``late`` count once; a corrected page comes out again. Older state is forgotten."""
    told = documents.withColumn("__told", F.xxhash64("title", "text", F.to_json("blocks")))
    return told.withWatermark(time, late).dropDuplicatesWithinWatermark(["source_path", "crate", "__told"]).drop("__told")


def chunk_stream(documents: DataFrame, late: str = "7 days", time: str = "loaded_at") -> DataFrame:
    """Clean chunks of a stream of documents (source_path, crate, title, text, blocks and a time)."""
    fresh = first_deliveries(documents, late, time)
    return chunk_documents(clean_documents(fresh.select("source_path", "crate", "title", "text", "blocks")), strict=False)


def write_chunks(documents: DataFrame, folder: str, checkpoint: str, late: str = "7 days", time: str = "loaded_at") -> StreamingQuery:
    """Appends chunks to a folder, exactly once by the file sink's log, and ends when all that is there is read."""
    return chunk_stream(documents, late, time).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrivals(hits: DataFrame, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """(start, mode, hits, mean_score) by windows of the search time; what arrives later than ``late`` after a window is left out by the watermark."""
    counted = hits.withWatermark("searched_at", late).groupBy(F.window("searched_at", width), "mode")
    return counted.agg(F.count(F.lit(1)).alias("hits"), F.avg("score").alias("mean_score")).select(F.col("window.start").alias("start"), "mode", "hits", "mean_score")
