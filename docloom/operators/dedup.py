"""Exact duplicates: one canonical row for each group, chosen by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.ids import chunk_id, document_id
from docloom.functions.text import text_hash
from docloom.operators.ranking import ranked
from docloom.runtime import unused_name


def keep_canonical(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark limits each task to one row a group before the shuffle (WindowGroupLimit), so a group that holds a third of all rows leaves a task as one row."""
    rank = unused_name(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def path_order(source_path: Column) -> list[Column]:
    """Shallow paths first, then short ones."""
    path = F.replace(source_path, F.lit("\\"), F.lit("/"))
    return [F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), F.length(path), path]


def dedup_documents(documents: DataFrame) -> DataFrame:
    """Documents (crate, source_path, item_path, text) with one of each (crate, normalised text).

    Null crates form one group, null texts count as empty, ties beyond path and item path go by all columns' hash."""
    slashes, length, path = path_order(F.col("source_path"))
    order = [slashes, length, F.length(F.coalesce("item_path", F.lit(""))), path, F.xxhash64(*documents.columns)]
    return keep_canonical(documents, [F.col("crate"), text_hash(F.coalesce("text", F.lit("")))], order)


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (crate, source_path, chunk_index, text, start_offset, end_offset, section_path) with one of each (crate, hash).

    A document that would lose all its chunks gets its best one back. Indexes are renumbered from 0 in each document and
    document_id, id and text_hash are derived again. Null texts count as empty, null paths as one document. Neither a
    hash nor a document that holds a third of all rows meets in one task: canonical rows are chosen with a limit before
    the shuffle, and only the names of documents are compared."""
    path = F.replace("source_path", F.lit("\\"), F.lit("/"))
    slashes, length, _ = path_order(F.col("source_path"))
    joined = F.length(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), "::"))
    ref = F.concat(path, F.lit(":"), F.col("chunk_index").cast("string"))
    hashed = chunks.withColumn("source_path", F.coalesce("source_path", F.lit(""))).withColumn("text_hash", text_hash(F.coalesce("text", F.lit(""))))
    kept = keep_canonical(hashed, [F.col("crate"), F.col("text_hash")], [slashes, length, joined, ref, F.col("start_offset"), F.xxhash64(*[c for c in hashed.columns])])
    bare = hashed.select("source_path").distinct().join(kept.select("source_path").distinct(), "source_path", "left_anti")
    best = [F.col("chunk_index"), F.length("text"), F.col("start_offset"), path, F.xxhash64(*[c for c in hashed.columns])]
    restored = keep_canonical(hashed.join(bare, "source_path", "left_semi"), [F.col("source_path")], best)
    return reindex(kept.unionByName(restored))


#: Chunks of one document are ranked in stretches of this many characters, or of indexes where they have no offset.
STRETCH_CHARS, STRETCH_ROWS = 1 << 20, 4096


def reindex(chunks: DataFrame) -> DataFrame:
    """chunk_index from 0 by (start, end, old index) in each document; ids follow. Ranks are taken in stretches of a document and raised by the counts of the stretches before, so a document of any size is spread over tasks."""
    stretch = F.when(F.col("start_offset").isNull(), F.struct(F.lit(0).alias("known"), F.floor(F.col("chunk_index") / STRETCH_ROWS).alias("at"))).otherwise(
        F.struct(F.lit(1).alias("known"), F.floor(F.col("start_offset") / STRETCH_CHARS).alias("at"))
    )
    numbered = ranked(chunks.withColumn("source_path", F.coalesce("source_path", F.lit(""))), ["source_path"], stretch, ["start_offset", "end_offset", "chunk_index"], "__rank")
    numbered = numbered.withColumn("chunk_index", F.col("__rank").cast("int")).withColumn("document_id", document_id(F.col("source_path")))
    return numbered.withColumn("id", chunk_id(F.col("document_id"), F.col("chunk_index"))).select(*chunks.columns, *[c for c in ("document_id", "id") if c not in chunks.columns])
