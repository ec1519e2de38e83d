"""The registered queries of this subpackage, each (spark, directory) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import canonical, garble, leaks, lines, mainbody, neardup, neighbours, packing, split
from docloom.runtime import read_table, scratch


#: The statement of the task's data for problem 1: three words, similarity 0.7.
NEAR = neardup.Settings(shingle=3, threshold=Fraction(7, 10))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "document_record", "pk", "text_content")
    return neardup.near_pairs(documents, read_table(spark, directory, "chunk_record", "pk", "text"), NEAR)


def p1_groups(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "document_record", "pk", "text_content")
    return neardup.near_groups(documents, read_table(spark, directory, "chunk_record", "pk", "text"), NEAR)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    points = read_table(spark, directory, "vector_point").selectExpr("chunk_id AS id", "vector")
    probes = read_table(spark, directory, "probe_point").selectExpr("chunk_id AS id")
    return neighbours.search(points, probes).selectExpr("query AS chunk_id", "neighbour AS neighbour_id")


def p2_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The neighbours of the chunks whose pk is divisible by 100, among all points."""
    points = read_table(spark, directory, "vector_point").selectExpr("chunk_id AS id", "vector")
    asked = read_table(spark, directory, "chunk_record", "pk", "id").filter("pk % 100 = 0").select("id")
    return neighbours.search(points, asked).selectExpr("query AS chunk_id", "neighbour AS neighbour_id", "round(similarity, 5) AS similarity", "rank")


def _pages(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "document_record").selectExpr("pk AS doc", "crate AS source", "text_content AS text")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    _, occurrences = lines.boilerplate(_pages(spark, directory))
    return occurrences.selectExpr("doc AS pk", "line_no").distinct()


def p3_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """The boilerplate blocks of each crate: which lines the graph's edges join."""
    blocks, _ = lines.boilerplate(_pages(spark, directory))
    return lines.joined_blocks(blocks).selectExpr("source AS crate", "block_line", "lines", "members", "strongest")


def p3_cleaned(spark: SparkSession, directory: str) -> DataFrame:
    pages = _pages(spark, directory)
    _, occurrences = lines.boilerplate(pages)
    return lines.cleaned(pages, occurrences).selectExpr("doc AS pk", "text", "removed")


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "document_record").selectExpr("'document_record' AS kind", "pk AS item", "0 AS start_offset", "text_content AS text")
    chunks = read_table(spark, directory, "chunk_record").selectExpr("'chunk_record' AS kind", "pk AS item", "start_offset", "text")
    return split.split_texts(documents.unionByName(chunks)).withColumnsRenamed({"kind": "rec_table", "item": "pk"})


def p4_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Of every oversized text: whether its pieces are small enough, numbered from 0, cover it from end to end with overlaps of at most 150, and stand where their offsets say."""
    order = Window.partitionBy("rec_table", "pk").orderBy("piece_no")
    rows = p4_pieces(spark, directory).withColumn("before", F.lag("piece_end").over(order)).withColumn("next_no", F.coalesce(F.lag("piece_no").over(order) + 1, F.lit(0)))
    joined = F.col("before").isNull() | F.col("piece_start").between(F.col("before") - 150, F.col("before"))
    good = joined & (F.col("piece_no") == F.col("next_no")) & (F.length("text") == F.col("piece_end") - F.col("piece_start")) & (F.length("text") <= 1400)
    shifted = F.col("start_offset").isNull() | (F.col("end_offset") - F.col("start_offset") == F.length("text"))
    return rows.groupBy("rec_table", "pk").agg(F.max("piece_end").alias("chars"), ((F.min("piece_start") == 0) & F.every(good & shifted)).alias("whole"))


def p4_ranges(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces of the page texts, worked on in ranges of 4,096 code points, so that most texts are cut by several workers."""
    documents = read_table(spark, directory, "document_record").selectExpr("'document_record' AS kind", "pk AS item", "0 AS start_offset", "text_content AS text")
    pieces = split.split_texts(documents, split.Limits(span=4096))
    return pieces.selectExpr("item AS pk", "piece_no", "piece_start", "piece_end", "md5(text) AS text_md5")


def p4_files(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces of the table's documents as files: one for each crate, written to the shared folder and cut by byte ranges of 64 KB."""
    documents = read_table(spark, directory, "documents", "doc_id", "text", "crate").filter("text IS NOT NULL")
    folder = scratch(spark, "p4-files")
    documents.selectExpr("coalesce(crate, 'none') AS crate", "text").hint("rebalance", "crate").write.partitionBy("crate").text(folder)
    pieces = split.split_files(spark, folder, "*.txt", split.Limits(file_span=64 << 10))
    return pieces.selectExpr("split(path, '/p4-files-')[1] AS file", "piece_no", "start_offset", "end_offset", "length(text) AS chars")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return p4_pieces(spark, directory).filter("piece_no > 0").select("rec_table", "pk").distinct()


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return mainbody.boilerplate_blocks(read_table(spark, directory, "document_record", "pk", "crate", "parsed_content"))


def p5_main_body(spark: SparkSession, directory: str) -> DataFrame:
    return mainbody.main_body(read_table(spark, directory, "document_record", "pk", "crate", "parsed_content"))


def p5_decisions(spark: SparkSession, directory: str) -> DataFrame:
    return mainbody.decisions(read_table(spark, directory, "document_record", "pk", "crate", "parsed_content"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return canonical.hidden_copies(read_table(spark, directory, "chunk_record", "pk", "text"))


def p7_packed(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents").selectExpr("doc_id AS doc", "text")
    return packing.pack(documents).withColumnRenamed("doc", "doc_id")


def p7_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How full the containers are: containers, tokens, the fewest containers that the tokens could need, and the share of the space that is used."""
    packed = p7_packed(spark, directory).filter("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = packed.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.selectExpr("containers", "tokens", "fullest", "ceil(tokens / 2048) AS least_containers", "round(tokens / (containers * 2048), 5) AS fill")


def p7_whole(spark: SparkSession, directory: str) -> DataFrame:
    """Of every document: whether its parts stand in containers, in order and without gaps, and are several only where each but the last is full."""
    order = Window.partitionBy("doc_id").orderBy("part")
    rows = p7_packed(spark, directory).withColumn("at", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("last", F.lead("part").over(order).isNull())
    good = (F.col("start_token") == F.col("at")) & (F.col("last") | (F.col("tokens") == 2048)) & (F.col("tokens") <= 2048) & (F.col("container").isNotNull() | (F.col("tokens") == 0))
    return rows.groupBy("doc_id").agg((F.sum("tokens") > 0).alias("placed"), F.every(good).alias("whole"))


def p8_leaks(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents").selectExpr("doc_id AS doc", "text")
    passages = read_table(spark, directory, "eval_passage").selectExpr("item_id AS item", "passage AS text")
    return leaks.leaks(documents, passages).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return p8_leaks(spark, directory).filter("longest >= 12").select("doc_id", "item_id")


def p9_restored(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents").selectExpr("doc_id AS doc", "text")
    return garble.find(documents).selectExpr("doc AS doc_id", "restored AS text", "restored <> text AS changed")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return p9_restored(spark, directory).select("doc_id").distinct()


def p9_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    """How many held-out misreadings of the corpus's own tokens are found and restored, and how many clean tokens would be changed."""
    return garble.accuracy(read_table(spark, directory, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_blocks": p3_blocks,
    "p3_cleaned": p3_cleaned,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_coverage": p4_coverage,
    "p4_ranges": p4_ranges,
    "p4_files": p4_files,
    "p5_found": p5_found,
    "p5_main_body": p5_main_body,
    "p5_decisions": p5_decisions,
    "p6_found": p6_found,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_whole": p7_whole,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
    "p9_accuracy": p9_accuracy,
}
