"""Problem 8: evaluation texts leaking into training text, by greedy string tiling.

Seeds are runs of ``tile`` words, hashed by a running Karp-Rabin polynomial. Where a document and a passage share
seeds, the longest common run of words is marked as a tile, then the longest among what is left unmarked on both sides,
and so on down to ``tile`` words. A passage has leaked if its longest tile has ``least`` words or if its tiles cover
``coverage`` of it, which catches passages put back in another order.

A passage table of up to ``broadcast_words`` words is broadcast and met in one pass over the documents, without a
shuffle. A larger one is joined on seeds; then only the texts of pairs that share a seed are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words

SCHEMA = "doc long, item long, longest int, tiles int, covered int, words int"


@dataclass(frozen=True)
class LeakSettings:
    tile: int = 6
    least: int = 12
    coverage: float = 0.6
    broadcast_words: int = 4_000_000


def tiles(at_item: np.ndarray, at_doc: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the tiles, longest first, from the positions of all shared seeds of ``tile`` words. Equal lengths go to the earlier place in the passage, then in the document."""
    diagonal = at_doc - at_item
    order = np.lexsort((at_item, diagonal))
    i, j = at_item[order], at_doc[order]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(i)]))
    waiting: dict[int, list[tuple[int, int]]] = {}
    for s, e in zip(starts, ends):
        waiting.setdefault(int(e - s) + tile - 1, []).append((int(i[s]), int(j[s])))
    used_item: list[tuple[int, int]] = []
    used_doc: list[tuple[int, int]] = []

    def free(start: int, length: int, used: list[tuple[int, int]]) -> list[tuple[int, int]]:
        parts = [(start, start + length)]
        for a, b in used:
            parts = [p for x, y in parts for p in ((x, min(y, a)), (max(x, b), y)) if p[0] < p[1]] if parts else parts
        return parts

    out = []
    while waiting:
        length = max(waiting)
        for a, b in sorted(waiting.pop(length)):
            spans = [(x, y) for x, y in free(a, length, used_item)]
            spans = [(x - b + a, y - b + a) for p, q in spans for x, y in free(p - a + b, q - p, used_doc)]
            if spans == [(a, a + length)]:
                out.append((a, b, length))
                used_item.append((a, a + length))
                used_doc.append((b, b + length))
            else:
                for x, y in spans:
                    if y - x >= tile:
                        waiting.setdefault(y - x, []).append((x, x - a + b))
    return out


@dataclass(frozen=True)
class Seeds:
    """All seeds of the passages, sorted by hash, with their item and position, and each item's number of words."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray


def seeds_of(texts: pa.Array, ids: np.ndarray, tile: int) -> Seeds:
    word, text, _, _ = words.words(texts, words.word_class())
    hashes, at = words.shingles(word, text, tile)
    first = np.searchsorted(text, np.arange(len(ids)))
    order = np.argsort(hashes, kind="stable")
    owner = text[at]
    return Seeds(hashes[order], owner[order], (at - first[owner])[order], ids, np.bincount(text, minlength=len(ids)))


def _matches(texts: pa.Array, seeds: Seeds, tile: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, item, positions in the item, positions in the text) of every pair with a shared seed."""
    word, text, _, _ = words.words(texts, words.word_class())
    hashes, at = words.shingles(word, text, tile)
    lo, hi = np.searchsorted(seeds.hashes, hashes, "left"), np.searchsorted(seeds.hashes, hashes, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return
    n = (hi - lo)[hit]
    which = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    place = np.repeat(at[hit], n)
    doc, item, at_item = text[place], seeds.item[which], seeds.place[which]
    at_doc = place - np.searchsorted(text, doc)
    order = np.lexsort((item, doc))
    doc, item, at_item, at_doc = doc[order], item[order], at_item[order], at_doc[order]
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
    for s, e in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(doc)]))):
        yield int(doc[s]), int(item[s]), at_item[s:e], at_doc[s:e]


def _row(doc: int, item: int, n: int, found: list[tuple[int, int, int]]) -> tuple:
    return doc, item, max(t[2] for t in found), len(found), sum(t[2] for t in found), n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc", "item", "longest", "tiles", "covered", "words"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def leaks(documents: DataFrame, passages: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """(doc, item, longest, tiles, covered, words) of every leaked pair of ``documents`` (doc long, text) and ``passages`` (item long, text).

    Defined cases: null and empty texts and passages shorter than a seed match nothing; of a repeated id the rows are
    joined by the largest value of each column, so copies count once; tiles of equal length go to the earlier place;
    a long text is searched as a whole; an empty side gives an empty result; other columns are ignored."""
    documents = documents.select(F.col("doc").cast("long"), F.lower("text").alias("text")).filter("text IS NOT NULL AND doc IS NOT NULL")
    passages = passages.select(F.col("item").cast("long"), F.lower("text").alias("text")).filter("text IS NOT NULL AND item IS NOT NULL").distinct()
    # a word has a character and all but the last a separator
    length = passages.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    found = _by_broadcast(documents, passages, settings) if length <= settings.broadcast_words else _by_join(documents, passages, settings)
    found = found.groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in ("longest", "tiles", "covered", "words")])
    return found.filter((F.col("longest") >= settings.least) | (F.col("covered") >= F.col("words") * settings.coverage))


def _by_broadcast(documents: DataFrame, passages: DataFrame, settings: LeakSettings) -> DataFrame:
    table = passages.orderBy("item", "text").toArrow().combine_chunks()
    text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    shared = documents.sparkSession.sparkContext.broadcast(seeds_of(text, table.column("item").to_numpy(), settings.tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                ids = part.column("doc")
                yield _batch([_row(ids[d].as_py(), int(seeds.ids[i]), int(seeds.lengths[i]), tiles(a, b, settings.tile)) for d, i, a, b in _matches(part.column("text"), seeds, settings.tile)])

    return documents.mapInArrow(run, SCHEMA)


def _by_join(documents: DataFrame, passages: DataFrame, settings: LeakSettings) -> DataFrame:
    """Seeds of either side meet in a shuffle join, each once a text; AQE splits a seed that very many texts share."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                word, text, _, _ = words.words(part.column("text"), words.word_class())
                hashes, at = words.shingles(word, text, settings.tile)
                hashes, owner = words.sets(hashes, text[at])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], names=["id", "seed"])

    mine = passages.select("item", "text").mapInArrow(seed, "id long, seed long").withColumnRenamed("id", "item").distinct()
    theirs = documents.select("doc", "text").mapInArrow(seed, "id long, seed long").withColumnRenamed("id", "doc")
    pairs = theirs.join(mine, "seed").select("doc", "item").distinct()
    both = pairs.join(documents, "doc").join(passages.withColumnRenamed("text", "passage"), "item").select("doc", "item", "text", "passage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                seeds = seeds_of(batch.column("passage").slice(k, 1), np.array([batch.column("item")[k].as_py()]), settings.tile)
                rows += [_row(batch.column("doc")[k].as_py(), int(seeds.ids[0]), int(seeds.lengths[0]), tiles(a, b, settings.tile)) for _, _, a, b in _matches(batch.column("text").slice(k, 1), seeds, settings.tile)]
            yield _batch(rows)

    return both.mapInArrow(run, SCHEMA)
