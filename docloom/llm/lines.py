"""Problem 3: lines repeated across one source's documents, found in a weighted graph of consecutive lines.

Nodes are (source, normalised line), weighted with the number of documents that hold the line; edges join lines that
follow each other in a document, weighted likewise. Nodes and edges of high support stay, the connected components of
what stays are the boilerplate blocks, and every occurrence of a block's line is deleted from its document.

Nodes are counted by 64-bit hashes with map-side aggregation, each line once a document, so a source that holds a third
of all documents is spread over all tasks, and texts never enter a shuffle. A line is kept only if a fixed share of its
source's documents hold it: a source with d distinct lines a document keeps at most d / share lines, whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.runtime import materialize


@dataclass(frozen=True)
class Support:
    """A line counts from ``characters`` on, in ``documents`` documents at least and in ``share`` of those of its source."""

    characters: int = 15
    documents: int = 8
    share: float = 0.05


def normal_line(line: Column) -> Column:
    """Trimmed, runs of blanks and tabs as one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, "[ \t]+", " ")))


def _lines(documents: DataFrame) -> DataFrame:
    """(doc, source, line_no, line) of every line of (doc, source, text)."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return documents.select("doc", "source", F.posexplode(split).alias("line_no", "raw")).select("doc", "source", F.col("line_no").cast("long").alias("line_no"), "raw", normal_line(F.col("raw")).alias("line"))


def boilerplate(documents: DataFrame, support: Support = Support()) -> tuple[DataFrame, DataFrame]:
    """(blocks, occurrences) of ``documents`` (doc, source, text).

    blocks: source, node, line, support, block. occurrences: doc, source, line_no, block, one row for each.

    Defined cases: a null text is an empty text, a null source is a source of its own, a row without an id takes no part; a repeated id counts once in all
    counts and gives each occurrence once; lines under the length limit are no nodes but part the lines around them;
    lines that occur twice in a document count once; ties don't matter, since nothing is ranked; an empty table has no
    blocks; other columns aren't read."""
    documents = documents.select("doc", F.coalesce("source", F.lit("\u0000")).alias("source"), "text").filter("doc IS NOT NULL")
    lines = _lines(documents)
    long_enough = F.length("line") >= support.characters
    pages = documents.select("source", "doc").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    # each line once a document; the second aggregation is over distinct rows and combines before its shuffle
    seen = lines.filter(long_enough).select("source", "doc", F.xxhash64("line").alias("node")).distinct()
    counted = seen.groupBy("source", "node").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support.documents)
    kept = counted.join(pages, "source").filter(F.col("support") >= F.col("pages") * support.share)
    kept = materialize(kept.select("source", "node", "support", "pages"), "p3-nodes")

    hashed = lines.select("doc", "source", "line_no", "line", F.when(long_enough, F.xxhash64("line")).alias("node"))
    found = materialize(hashed.join(F.broadcast(kept) if _small(kept) else kept, ["source", "node"]).select("doc", "source", "line_no", "node", "line", "support", "pages").distinct(), "p3-found")
    nxt = found.select("doc", "source", (F.col("line_no") - 1).alias("line_no"), F.col("node").alias("b"))
    pairs = found.select("doc", "source", "line_no", F.col("node").alias("a"), "pages").join(nxt, ["doc", "source", "line_no"]).filter("a <> b")
    # text_content parts its blocks by blank lines: lines two apart are neighbours too
    nxt2 = found.select("doc", "source", (F.col("line_no") - 2).alias("line_no"), F.col("node").alias("b"))
    pairs = pairs.unionByName(found.select("doc", "source", "line_no", F.col("node").alias("a"), "pages").join(nxt2, ["doc", "source", "line_no"]).filter("a <> b"))
    pairs = pairs.select("source", "doc", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "pages").distinct()
    edges = pairs.groupBy("source", "a", "b").agg(F.count(F.lit(1)).alias("support"), F.first("pages").alias("pages"))
    edges = edges.filter((F.col("support") >= support.documents) & (F.col("support") >= F.col("pages") * support.share))
    labels = components(edges, kept, ["source"], "p3")
    texts = found.groupBy("source", "node").agg(F.min("line").alias("line"), F.first("support").alias("support"))
    blocks = texts.join(labels, ["source", "node"])
    occurrences = found.join(labels, ["source", "node"]).select("doc", "source", "line_no", "block")
    return blocks, occurrences


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """(source, block_line, lines, members, strongest): one row for each block of ``blocks`` that edges join of two lines or more: its first line in order, the number of its lines, a hash of all of them in order, and the highest support of a line. Lines that no edge joins to another are blocks of one and don't come out. Of a block only its lines' hashes are gathered, at most as many as a source keeps lines."""
    found = blocks.groupBy("source", "block").agg(F.min("line").alias("block_line"), F.count(F.lit(1)).alias("lines"), F.md5(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("members"), F.max("support").alias("strongest"))
    return found.filter("lines > 1").drop("block")


#: Rows of kept lines up to which they are broadcast; beyond, the join shuffles hashes.
BROADCAST_ROWS = 50_000


def _small(kept: DataFrame) -> bool:
    return kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def cleaned(documents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(doc, text, removed) with the lines of ``occurrences`` deleted; a document whose lines all go has an empty text."""
    gone = occurrences.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    joined = documents.select("doc", "text").dropDuplicates(["doc"]).join(gone, "doc", "left")
    left = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, k: ~F.coalesce(F.array_contains("gone", k.cast("long")), F.lit(False)))
    return joined.select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
