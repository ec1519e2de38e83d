"""Exact vector search, its hydration from chunk and document tables, and metadata filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize, unused_name

DISTANCES = ("cosine", "dot", "euclid", "manhattan")
#: Queries whose vectors are broadcast at a time.
PASS_ROWS = 8192
#: Words of queries up to which they are broadcast in lexical search, and salts of a word beyond.
BROADCAST_WORDS, WORD_SALTS = 200_000, 64


def scores(queries: np.ndarray, rows: np.ndarray, distance: str) -> np.ndarray:
    """(queries, rows); for euclid and manhattan the distance, which is better when smaller."""
    match distance:
        case "dot":
            return queries @ rows.T
        case "cosine":
            norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(norms > 0, (queries @ rows.T) / norms, 0.0)
        case "euclid":
            return np.sqrt(np.maximum(((queries[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2), 0))
        case "manhattan":
            return np.abs(queries[:, None, :] - rows[None, :, :]).sum(axis=2)
    raise ValueError(f"unknown distance {distance!r}; one of {', '.join(DISTANCES)}")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, distance: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best rows of ``corpus`` (id, vector) for every row of ``queries`` (query_id, vector).

    Queries are broadcast in passes of at most about PASS_ROWS, one after the other: a pass's results are written before the
    next is collected. Every task scores its rows in blocks and sends only its best k for each query. Ties go to the smaller id. Null vectors, vectors with nulls and vectors of another length
    than the query take no part. ``threshold`` keeps scores of at least it (distances: at most). Fewer than k rows give
    fewer; an empty side gives none."""
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance {distance!r}; one of {', '.join(DISTANCES)}")
    spark = corpus.sparkSession
    sign = 1.0 if distance in ("euclid", "manhattan") else -1.0
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    asked = queries.select("query_id", "vector").filter(whole & (F.size("vector") > 0)).distinct()
    rows = corpus.select("id", "vector").filter(whole & F.col("id").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *corpus.schema.fields]}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    order = Window.partitionBy("query_id").orderBy(F.col("score") * sign, "id")
    passes = -(-asked.count() // PASS_ROWS)
    found = None
    for n in range(passes):
        table = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).toArrow()
        by_size: dict[int, list[int]] = {}
        for at, v in enumerate(table.column("vector").to_pylist()):
            by_size.setdefault(len(v), []).append(at)
        groups = {d: (np.array(at), np.array([table.column("vector")[i].as_py() for i in at], np.float64)) for d, at in by_size.items()}
        shared = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors_of = shared.value
            for batch in batches:
                lengths = np.array([len(v) for v in batch.column("vector")])
                for d, (where, vectors) in vectors_of.items():
                    mine = np.flatnonzero(lengths == d)
                    if not len(mine):
                        continue
                    block = batch.column("vector").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    ids = batch.column("id").take(pa.array(mine))
                    place = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"), kind="stable")
                    step = max(1, (1 << 22) // max(1, len(mine) * (d if distance in ("euclid", "manhattan") else 1)))
                    for lo in range(0, len(where), step):
                        s = sign * scores(vectors[lo : lo + step], block, distance)
                        if threshold is not None:
                            s = np.where(s <= sign * threshold, s, np.inf)
                        order = np.lexsort((np.broadcast_to(place, s.shape), s), axis=1)[:, :k]
                        best = np.take_along_axis(s, order, axis=1)
                        q, c = np.nonzero(np.isfinite(best))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(where[q + lo])), ids.take(pa.array(order[q, c])), pa.array(sign * best[q, c])], names=["query_id", "id", "score"])

        part = rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if passes > 1:
            part = materialize(part, "search-pass")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema + ", rank int") if found is None else found


def filtered_top_k(queries: DataFrame, corpus: DataFrame, where: Column, **options) -> DataFrame:
    """Top k among the rows that meet a condition on the payload, which is decided before any scoring and reaches the scan."""
    return top_k(queries, corpus.filter(where), **options)


def payload_map(points: DataFrame, columns: list[str]) -> Column:
    """A map of the payload's values as strings, nulls left out."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def payload_columns(payload: Column, required: list[str], optional: list[str]) -> list[Column]:
    """The columns of a payload map, the inverse of ``payload_map``: a required key that is missing or empty ends the job with its name; ``chunk_index`` is read as a number, and what is none ends it too."""

    def read(name: str, needed: bool) -> Column:
        value = F.element_at(payload, F.lit(name))
        if needed:
            value = F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.raise_error(F.lit(f"payload without {name}")).cast("string"))
        if name == "chunk_index":
            number = F.when(value.rlike(r"^\d{1,9}$"), value.cast("int"))
            value = F.when(value.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("chunk_index is no number: "), value)).cast("int")).otherwise(number)
        return value.alias(name)

    return [*(read(n, True) for n in required), *(read(n, False) for n in optional)]


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, rank, score) with their chunk (id, document_pk, text, section_path, token_count) and document (pk, title, url, source_path, item_path, crate).

    Hits whose chunk or document is gone are dropped. Hits are the small side; whether one is broadcast is left to Spark's
    own size check. Columns of equal names come from hits, then chunks, then documents."""
    c = chunks.select(F.col("id").alias("chunk_id"), "document_pk", "text", "section_path", "token_count").dropDuplicates(["chunk_id"])
    d = documents.select(F.col("pk").alias("document_pk"), "title", "url", "source_path", "item_path", "crate").dropDuplicates(["document_pk"])
    return hits.join(c, "chunk_id").join(d, "document_pk")


def first_hits(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits of each query, cut before missing contexts are dropped, so a query can have fewer."""
    return hits.filter(F.col("rank") <= limit)


def lexical_top_k(queries: DataFrame, corpus: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of ``corpus`` (id, text) that share most different words with each query (query_id, text).

    A join on words, aggregated with map-side combine; the score is the share of the query's words. The queries' words are
    broadcast up to BROADCAST_WORDS, so a word that stands in every row shuffles nothing; beyond, rows are spread over
    WORD_SALTS salts of each word. A repeated id counts once. Rows that share no word don't come out; ties go to the smaller id; null texts have no words."""

    def words(df: DataFrame, key: str) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z0-9_]{3,})"), F.lit(1)))
        return df.select(key, F.size(found).alias("words"), F.explode(found).alias("word"))

    asked = words(queries.dropDuplicates(["query_id"]), "query_id")
    held = words(corpus.dropDuplicates(["id"]), "id").select("id", "word")
    if asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        met = held.join(F.broadcast(asked), "word")
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))))
        met = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(WORD_SALTS)).cast("int")).join(salted, ["word", "salt"])
    shared = met.groupBy("query_id", "id").agg((F.count(F.lit(1)) / F.first("words")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return shared.withColumn(unused_name(shared, "rank"), F.row_number().over(order)).filter(F.col("rank") <= k)
