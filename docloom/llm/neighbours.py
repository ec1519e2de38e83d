"""Problem 2: the most similar vectors, by an inverted file with product-quantised residuals and exact reranking.

Fit (driver, bounded sample): k-means centroids of unit vectors, and for each of ``parts`` slices of the residuals a
codebook of 256 words. Lists are numbered so that close centroids have close numbers. Every usable row is then indexed:
its list is the nearest centroid, its code the nearest words, kept with the length of what the code leaves. The index is
a table range-partitioned and sorted by (list, id), so a list that holds a third of all rows is spread over many files.

Search: a query visits ``spread`` times as many lists, nearest first, as it takes to reach those of its ``k`` best rows
in the fit sample, but at least ``min_probes`` and at most ``max_probes``. Lists grow in number with the root of the rows
(up to ``max_lists``), so the share of rows that a query meets falls as the table grows. Asymmetric distance tables (query
slice times codeword) score the codes of a visited list; a row whose score, with ``slack`` standard deviations of its
quantisation error, can reach the query's bound is reranked by its exact cosine in the same task. The bound is the
similarity of the k-th best row of the fit sample, which the k-th best of all rows can't be below; a query that finds
fewer than k rows over it has missed a list and visits all of them.

Queries are taken in passes of bounded size, those of close lists together. One pass at a time has its vectors on the
driver and broadcast, reads only the stretches of the index that it visits, and writes its results before the next
begins. Only the best ``k`` of each task are shuffled; nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize


@dataclass(frozen=True)
class IndexSettings:
    """``sample``: rows at most, about, on which centroids are fitted (16 a list if that is more), ``book_rows`` of which, about, fit the codebooks; all rows are indexed whatever they are. ``pass_size``: queries at most, about, of one pass; ``stretches``: ranges of lists that one pass reads at most."""

    dim: int = 64
    k: int = 10
    parts: int = 16
    sample: int = 40_000
    book_rows: int = 20_000
    max_lists: int = 8192
    spread: float = 3.0
    min_probes: int = 64
    max_probes: int = 512
    slack: float = 5.0
    query_block: int = 512
    pass_size: int = 32_768
    stretches: int = 32
    rounds: int = 8


@dataclass(frozen=True)
class Codebooks:
    """Size fixed by the settings: at most max_lists * dim and 256 * dim floats."""

    centroids: np.ndarray  # (lists, dim)
    words: np.ndarray  # (parts, 256, dim / parts)

    @property
    def directions(self) -> np.ndarray:
        """Centroids of length 1; queries visit lists in the order of their cosine."""
        return self.centroids / np.maximum(np.linalg.norm(self.centroids, axis=1, keepdims=True), 1e-12)


def usable(vector: Column, dim: int) -> Column:
    """Not null, of the right length, finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from k distinct rows; an empty cluster takes a row at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        label = nearest(x, centres)
        order = np.argsort(label, kind="stable")
        counts = np.bincount(label, minlength=k)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        full = counts > 0
        centres[full] = np.add.reduceat(x[order], starts[full]) / counts[full, None]
        centres[~full] = x[rng.integers(0, len(x), (~full).sum())]
    return centres


def in_order(centroids: np.ndarray) -> np.ndarray:
    """The centroids in an order in which close ones are close: halves along the axis of largest variance, again and again."""
    if len(centroids) <= 2:
        return centroids
    middle = centroids - centroids.mean(axis=0)
    axis = np.linalg.eigh(middle.T @ middle)[1][:, -1]
    order = np.argsort(middle @ axis, kind="stable")
    half = len(order) // 2
    return np.concatenate((in_order(centroids[order[:half]]), in_order(centroids[order[half:]])))


def fit(sample: np.ndarray, lists: int, settings: IndexSettings) -> Codebooks:
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = in_order(kmeans(x, lists, settings.rounds, 1))
    rest = x - centroids[nearest(x, centroids)]
    width = settings.dim // settings.parts
    few = rest[:: max(1, -(-len(rest) // settings.book_rows))]
    return Codebooks(centroids, np.stack([kmeans(few[:, p * width : (p + 1) * width], 256, settings.rounds, 2 + p) for p in range(settings.parts)]))


def encode(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, length of the error) of unit vectors."""
    label = nearest(x, books.centroids)
    rest = x - books.centroids[label]
    width = rest.shape[1] // len(books.words)
    codes, left = [], np.zeros(len(x))
    for p, w in enumerate(books.words):
        part = rest[:, p * width : (p + 1) * width]
        codes.append(nearest(part, w).astype(np.uint8))
        left += ((part - w[codes[-1]]) ** 2).sum(axis=1)
    return label, np.stack(codes, axis=1), np.sqrt(left).astype(np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """float32 rows of a column of binary vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest number first, so that no norm overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables(queries: np.ndarray, books: Codebooks) -> np.ndarray:
    """(parts, queries, 256) asymmetric distance tables: the inner product of each slice of a query with each codeword."""
    width = queries.shape[1] // len(books.words)
    return np.stack([queries[:, p * width : (p + 1) * width] @ w.T for p, w in enumerate(books.words)])


@dataclass(frozen=True)
class Pass:
    """One pass of queries: at most about ``pass_size`` rows."""

    ids: np.ndarray
    vectors: np.ndarray  # (queries, dim) unit, float64
    bound: np.ndarray  # similarity that a result must reach
    reach: np.ndarray  # cosine of the last centroid that a query visits


def _search(settings: IndexSettings, books, queries):
    def batch_hits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked: Pass = queries.value
        cells: Codebooks = books.value
        label = batch.column("list").to_numpy()
        order = np.argsort(label, kind="stable")
        label = label[order]
        rows = _unit(_matrix(batch.column("vector"), settings.dim))[order]
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(order), settings.parts)[order]
        slack = batch.column("error").to_numpy()[order] * np.float32(settings.slack / np.sqrt(settings.dim)) + np.float32(1e-5)
        starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        ends = np.append(starts[1:], len(label))
        lengths = np.maximum(np.linalg.norm(cells.centroids[label[starts]], axis=1), 1e-12).astype(np.float32)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(asked.ids), settings.query_block):
            part = asked.vectors[lo : lo + settings.query_block]
            part32 = part.astype(np.float32)
            bound = asked.bound[lo : lo + settings.query_block]
            coarse = part32 @ cells.centroids[label[starts]].T
            visiting = coarse / lengths >= asked.reach[lo : lo + settings.query_block, None]
            lookup = tables(part32, cells)
            for k in range(len(starts)):
                who = np.flatnonzero(visiting[:, k])
                if not len(who):
                    continue
                s, e = starts[k], ends[k]
                score = np.add.outer(coarse[who, k] - bound[who], slack[s:e])
                for p in range(settings.parts):
                    score += lookup[p][who[:, None], codes[s:e, p][None, :]]
                q, r = np.nonzero(score >= 0)
                if not len(q):
                    continue
                q, r = who[q], r + s
                exact = np.einsum("ij,ij->i", part[q], rows[r])
                good = exact >= bound[q] - 1e-9
                hits.append((q[good] + lo, order[r[good]], exact[good]))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*hits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, r, exact = batch_hits(batch)
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            other = ids[r] != queries.value.ids[q]
            q, r, exact = q[other], r[other], exact[other]
            place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            best = np.lexsort((place[r], -exact, q))
            q, r, exact = q[best], r[best], exact[best]
            keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < settings.k
            yield pa.RecordBatch.from_arrays([pa.array(queries.value.ids[q[keep]], pa.string()), pa.array(ids[r[keep]], pa.string()), pa.array(exact[keep])], names=["query", "neighbour", "similarity"])

    return run


def search(points: DataFrame, queries: DataFrame, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """(query, neighbour, similarity, rank): the ``k`` most similar other points of ``points`` (id string, vector array<float>) for each id of ``queries`` (id).

    Defined cases: unusable vectors (null, of another length, with a null or a number that isn't finite, all zero) take
    no part on either side; a repeated id counts once, with its smallest vector if they differ; a repeated query counts
    once; a query that isn't a point gives no rows; ties go to the smaller id; with fewer than k + 1 points all others
    come out; an empty table gives an empty result; other columns are ignored."""
    spark, dim = points.sparkSession, settings.dim
    points = points.filter(F.col("id").isNotNull() & usable(F.col("vector"), dim)).select("id", "vector")
    total = points.count()
    if not total:
        return spark.createDataFrame([], "query string, neighbour string, similarity double, rank int")
    lists = int(min(settings.max_lists, max(1, 2 ** (round(np.log2(total) / 2) + 1)), total))
    wanted = max(settings.sample, 16 * lists)
    share = int(min(1.0, wanted / total) * ((1 << 62) - 1))
    # repeated deliveries have one hash, so they are in the sample together and are made one there
    sampled = points.filter(F.shiftrightunsigned(F.xxhash64("id"), 2) <= share).groupBy("id").agg(F.min("vector").alias("vector")).select("vector").toArrow()
    sample = _unit(_rows_of(sampled.column("vector").combine_chunks(), dim)).astype(np.float32)
    books = spark.sparkContext.broadcast(fit(sample, lists, settings))
    seen = spark.sparkContext.broadcast((sample, nearest(sample, books.value.centroids)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                rows = _rows_of(part.column("vector"), dim)
                label, codes, error = encode(_unit(rows).astype(np.float32), books.value)
                yield pa.RecordBatch.from_arrays([part.column("id"), _binary(rows), pa.array(label.astype(np.int32)), _binary(codes), pa.array(error)], names=["id", "vector", "list", "codes", "error"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = books.value.directions.astype(np.float32)
        known, where = seen.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = _unit(_matrix(part.column("vector"), dim)).astype(np.float32)
                near = rows @ directions.T
                like = rows @ known.T
                # the query itself may be in the sample, so one more than k
                n = like.shape[1] - settings.k - 1
                if n >= 0:
                    best = np.argpartition(like, n, axis=1)[:, n:]
                    bound = np.take_along_axis(like, best, axis=1).min(axis=1)
                    last = np.take_along_axis(near, where[best], axis=1).min(axis=1)
                    visits = np.clip(np.ceil(settings.spread * (near >= last[:, None]).sum(axis=1)), settings.min_probes, settings.max_probes).astype(int)
                    ranked = -np.sort(-near, axis=1)
                    reach = ranked[np.arange(len(rows)), np.minimum(visits, lists) - 1]
                else:
                    bound, reach = np.full(len(rows), -2.0), np.full(len(rows), -2.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vector"), pa.array((bound - 1e-5).astype(np.float32)), pa.array((reach - 1e-6).astype(np.float32)), pa.array(near.argmax(axis=1).astype(np.int32))],
                    names=["id", "vector", "bound", "reach", "first"],
                )

    vectors = points.groupBy("id").agg(F.min("vector").alias("vector"))
    indexed = vectors.mapInArrow(index, "id string, vector binary, list int, codes binary, error float")
    indexed = materialize(indexed.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), "p2-index")
    asked = indexed.select("id", "vector").join(queries.select("id").distinct(), "id", "left_semi")
    asked = materialize(asked.mapInArrow(ask, "id string, vector binary, bound float, reach float, first int"), "p2-queries")
    found = _best(indexed, asked, books, settings)
    # fewer than k results at or over the bound prove that a list was missed: these queries visit all lists
    full = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(settings.k, total - 1)).select(F.col("query").alias("id"))
    short = materialize(asked.join(full, "id", "left_anti").withColumn("reach", F.lit(-2.0).cast("float")), "p2-short")
    again = _best(indexed, short, books, settings)
    return found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(again)


def _passes(asked: DataFrame, settings: IndexSettings) -> list[Column]:
    """Conditions that cut the queries into passes of about ``pass_size`` by their nearest list; a list with more is cut by a hash of the id. The counts are one row a list."""
    counts = sorted((r[0], r[1]) for r in asked.groupBy("first").count().collect())
    out: list[Column] = []
    low, size = None, 0
    for at, (number, n) in enumerate(counts):
        if low is None:
            low, size = number, 0
        size += n
        if size >= settings.pass_size or at == len(counts) - 1 or counts[at + 1][1] >= settings.pass_size:
            parts = -(-size // settings.pass_size) if size > 2 * settings.pass_size else 1
            mine = F.col("first").between(low, number)
            out += [mine & (F.pmod(F.xxhash64("id"), F.lit(parts)) == k) if parts > 1 else mine for k in range(parts)]
            low = None
    return out


def _stretches(visited: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, last) of at most ``most`` ranges of lists that hold all visited ones, the widest gaps left out."""
    at = np.flatnonzero(visited)
    if not len(at):
        return []
    gaps = np.diff(at)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cuts = cuts[gaps[cuts] > 1]
    return [(int(at[a]), int(at[b])) for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(at) - 1])))]


def _best(indexed: DataFrame, asked: DataFrame, books, settings: IndexSettings) -> DataFrame:
    """(query, neighbour, similarity, rank) over the index, one pass of queries after the other."""
    spark = indexed.sparkSession
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    found = spark.createDataFrame([], "query string, neighbour string, similarity double, rank int")
    for condition in _passes(asked, settings):
        table = asked.filter(condition).orderBy("id").toArrow()
        one = Pass(np.array(table.column("id").to_pylist(), dtype=object), _unit(_matrix(table.column("vector"), settings.dim)), table.column("bound").to_numpy(), table.column("reach").to_numpy())
        visited = np.zeros(len(books.value.centroids), bool)
        directions = books.value.directions.astype(np.float32)
        for lo in range(0, len(one.ids), settings.query_block):
            part = slice(lo, lo + settings.query_block)
            visited |= (one.vectors[part].astype(np.float32) @ directions.T >= one.reach[part, None]).any(axis=0)
        rows = indexed
        if not visited.all():
            ranges = [F.col("list").between(*r) for r in _stretches(visited, settings.stretches)]
            rows = indexed.filter(reduce(lambda a, b: a | b, ranges)) if ranges else indexed.limit(0)
        shared = spark.sparkContext.broadcast(one)
        hits = rows.mapInArrow(_search(settings, books, shared), "query string, neighbour string, similarity double")
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.k)
        found = found.unionByName(materialize(hits, "p2-found"))
        shared.unpersist()
    return found
