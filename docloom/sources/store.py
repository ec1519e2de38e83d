"""The knowledge base on disk: versioned tables behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.ids import chunk_id, document_id
from docloom.functions.metadata import section_title

TABLES = ("documents", "chunks", "vectors")


class IntegrityError(ValueError):
    """Tables that may not replace the current ones."""


def documents_without_chunks(documents: DataFrame, chunks: DataFrame, key: str = "source_path") -> DataFrame:
    return documents.select(key).distinct().join(chunks.select(key).distinct(), key, "left_anti")


def chunks_without_documents(documents: DataFrame, chunks: DataFrame, key: str = "source_path") -> DataFrame:
    return documents_without_chunks(chunks, documents, key)


def wrong_ids(chunks: DataFrame) -> DataFrame:
    """Chunks (source_path, chunk_index, document_id, id) whose ids aren't those of their path and index."""
    doc = document_id(F.col("source_path"))
    return chunks.filter(~F.col("document_id").eqNullSafe(doc) | ~F.col("id").eqNullSafe(chunk_id(doc, F.col("chunk_index"))))


def repeated_indexes(chunks: DataFrame) -> DataFrame:
    """(source_path, chunk_index) that more than one chunk has."""
    return chunks.groupBy("source_path", "chunk_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check(documents: DataFrame, chunks: DataFrame) -> None:
    """Raises IntegrityError with the first five offenders in order."""
    for name, df in (("documents", documents), ("chunks", chunks)):
        if df.limit(1).count() == 0:
            raise IntegrityError(f"there are no {name}")
    for what, bad in (("documents without chunks", documents_without_chunks(documents, chunks)), ("chunks without documents", chunks_without_documents(documents, chunks)), ("repeated chunk indexes of", repeated_indexes(chunks).select("source_path").distinct()), ("wrong ids in", wrong_ids(chunks).select("source_path").distinct())):
        if first := [r[0] for r in bad.orderBy("source_path").limit(5).collect()]:
            raise IntegrityError(f"{what}: {', '.join(map(str, first))}")


def with_ids(chunks: DataFrame) -> DataFrame:
    """Ids of chunks that have none yet, from their path and index."""
    chunks = chunks.withColumn("document_id", document_id(F.col("source_path")))
    return chunks.withColumn("id", chunk_id(F.col("document_id"), F.col("chunk_index")))


class KnowledgeBase:
    """Documents, chunks and vectors under one folder. ``replace`` writes a new version, checks it and only then turns the pointer, so readers see either the old tables or the new ones; a failed job leaves the old."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        """The current version, null before the first: the last pointer by name."""
        fs, p = self._fs(f"{self.root}/pointer")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return names[-1].split("-", 1)[1] if names else None

    def replace(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, distance: str = "cosine") -> str:
        """Writes and checks a new version, then turns the pointer. With vectors the version keeps their number of dimensions and the distance they are meant for; vectors of different sizes are refused."""
        version = uuid.uuid4().hex
        for name, df in zip(TABLES, (documents, chunks, vectors)):
            if df is not None:
                df.write.parquet(f"{self.root}/{version}/{name}")
        check(self.read("documents", version), self.read("chunks", version))
        if vectors is not None:
            least, most = self.read("vectors", version).agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
            if least != most:
                raise IntegrityError(f"vectors of {least} to {most} numbers")
            self.spark.createDataFrame([(most, distance)], "size int, distance string").coalesce(1).write.json(f"{self.root}/{version}/vector_space")
        fs, p = self._fs(f"{self.root}/pointer/{self._claim():012d}-{version}")
        fs.create(p, False).close()
        return version

    def _claim(self) -> int:
        """The next number of a pointer; of two writers each gets another, as a number's file is created by one only."""
        fs, folder = self._fs(f"{self.root}/claims")
        number = len(fs.listStatus(folder)) if fs.exists(folder) else 0
        while True:
            try:
                fs.create(self._fs(f"{self.root}/claims/{number:012d}")[1], False).close()
                return number
            except Exception:
                if not fs.exists(self._fs(f"{self.root}/claims/{number:012d}")[1]):
                    raise
                number += 1

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a table of the current version; none is no work."""
        rows.write.mode("append").parquet(f"{self.root}/{self.version()}/{name}")

    def read(self, name: str, version: str | None = None) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        if (version := version or self.version()) is None:
            raise IntegrityError("there is no version yet")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def vector_space(self, version: str | None = None) -> tuple[int | None, str]:
        """(numbers of a vector, distance) that a version keeps; the number is null if there are no vectors in it."""
        if (version := version or self.version()) is None:
            raise IntegrityError("there is no version yet")
        row = self.spark.read.schema("size int, distance string").json(f"{self.root}/{version}/vector_space").first()
        return row["size"], row["distance"]

    def document(self, id: str) -> DataFrame:
        """The document with an id; no row if it is unknown."""
        return self.read("documents").filter(document_id(F.col("source_path")) == id)

    def chunk(self, chunk_id: str) -> DataFrame:
        """The chunk with an id and its document's title and url; no row if it is unknown. The id reaches the scan as a filter."""
        documents = self.read("documents").select("source_path", F.col("title").alias("document_title"), "url")
        found = self.read("chunks").filter(F.col("id") == chunk_id)
        return found.withColumn("section_title", section_title(F.col("section_path"))).join(documents, "source_path")
