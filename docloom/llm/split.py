"""Problem 4: splitting oversized items at natural boundaries, by ranges.

A text, or a file, is cut into ranges. A worker sees its range and a halo before it, never the whole. The cut that ends
a range is the best boundary in the last part before the range's end; it depends on the halo only, so both neighbours
find the same one, and no range waits for another. Within its range a worker cuts greedily. The lengths of the ranges
in code points are stitched by a prefix sum, which turns offsets within a range into offsets of the whole.

Boundaries in order of preference: after a blank line, after a line, after a sentence, after blanks. The last boundary
of the best class in the upper half of the allowed length is taken, else the last one of any class in the lower half,
else the piece is cut at the limit. A piece begins at the first boundary among the ``overlap`` code points before the
end of the one before, else exactly ``overlap`` before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[.!?]['\")\]]*\s+|[。！？]")
_BLANK = re.compile(r"\s+")


@dataclass(frozen=True)
class Limits:
    """Pieces of at most ``size`` code points with ``overlap``; texts are worked on in ranges of ``span`` code points, files in ranges of ``file_span`` bytes."""

    size: int = 1400
    overlap: int = 150
    span: int = 1 << 17
    file_span: int = 8 << 20

    def __post_init__(self) -> None:
        if not 0 <= self.overlap * 2 < self.size <= self.span // 2 or self.file_span < 8 * self.size:
            raise ValueError("overlap must be under half the size, and ranges must be larger than pieces")


def _last(pattern: re.Pattern[str], text: str, lo: int, hi: int) -> int:
    found = -1
    for m in pattern.finditer(text, max(lo - 1, 0), hi):
        if lo < m.end() <= hi:
            found = m.end()
    return found


def best_cut(text: str, lo: int, hi: int) -> int:
    """The best boundary in (lo, hi], or -1."""
    if (at := text.rfind("\n\n", max(lo - 1, 0), hi)) >= 0 and at + 2 > lo:
        return at + 2
    if (at := text.rfind("\n", lo, hi)) >= 0:
        return at + 1
    if (at := _last(_SENTENCE, text, lo, hi)) >= 0:
        return at
    return _last(_BLANK, text, lo, hi)


def next_cut(text: str, start: int, end: int, limits: Limits) -> int:
    """Where the piece that begins at ``start`` ends, ``end`` being as far as the text goes."""
    if end - start <= limits.size:
        return end
    top = start + limits.size
    at = best_cut(text, start + limits.size // 2, top)
    if at < 0:
        at = best_cut(text, start + limits.overlap + 1, start + limits.size // 2)
    return at if at > 0 else top


def overlap_start(text: str, end: int, limits: Limits) -> int:
    """Where the piece after one that ends at ``end`` begins."""
    low = max(end - limits.overlap, 0)
    for m in _BLANK.finditer(text, max(low - 1, 0), end):
        if low <= m.end() < end:
            return m.end()
    return low


def range_end(text: str, end: int, limits: Limits) -> int:
    """The cut that ends the range up to ``end``; it looks at half a piece before it."""
    at = best_cut(text, max(end - limits.size // 2, 0), end)
    return at if at > 0 else end


def pieces_of_range(text: str, halo: int, first: bool, last: bool, limits: Limits) -> list[tuple[int, int]]:
    """(start, end) in ``text``, whose first ``halo`` code points lie before the range."""
    start = 0 if first else overlap_start(text, range_end(text[:halo], halo, limits), limits)
    stop = len(text) if last else range_end(text, len(text), limits)
    out = []
    while start < stop:
        end = next_cut(text, start, stop, limits)
        out.append((start, end))
        if end >= stop:
            break
        start = overlap_start(text, end, limits)
    return out


def split_texts(records: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of the texts over the limit among ``records`` (kind string, item long, start_offset int, text string).

    Result: kind, item, piece_no, piece_start, piece_end (in the text), start_offset, end_offset (continuing the
    record's start_offset, null where that is null), text. Texts within the limit, empty and null ones give no rows; a
    repeated id counts once, with its smallest text if they differ; a row without an id takes no part; ties don't arise; an empty table gives an empty result; other columns are ignored. Ranges
    of one giant text are spread over tasks before they are cut."""
    size, span = limits.size, limits.span
    long = records.select("kind", "item", F.col("start_offset").cast("long").alias("base"), "text").filter((F.length("text") > size) & F.col("kind").isNotNull() & F.col("item").isNotNull())
    long = long.groupBy("kind", "item").agg(F.min(F.struct("text", "base")).alias("r")).select("kind", "item", "r.base", "r.text")
    # a rest shorter than a piece belongs to the range before it
    counted = long.withColumn("ranges", F.greatest(F.lit(1), F.floor((F.length("text") - size) / span).cast("int") + 1))
    shape = "kind string, item long, base long, range_no int, ranges int, halo int, at long, text string"

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ranges of giant texts with their halos, by position, in one pass over each text."""
        for batch in batches:
            for r in batch.itertuples():
                for k in range(r.ranges):
                    halo = size if k else 0
                    end = len(r.text) if k == r.ranges - 1 else (k + 1) * span
                    row = (r.kind, r.item, r.base, k, r.ranges, halo, k * span - halo, r.text[k * span - halo : end])
                    yield pd.DataFrame([row], columns=["kind", "item", "base", "range_no", "ranges", "halo", "at", "text"]).astype({"base": "Int64"})

    whole = counted.filter("ranges = 1").select("kind", "item", "base", F.lit(0).alias("range_no"), "ranges", F.lit(0).alias("halo"), F.lit(0).cast("long").alias("at"), "text")
    spread = counted.filter("ranges > 1").mapInPandas(sliced, shape).repartition("kind", "item", "range_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (r.kind, r.item, r.base, r.range_no, k, r.at + a, r.at + b, r.text[a:b])
                for r in batch.itertuples()
                for k, (a, b) in enumerate(pieces_of_range(r.text, r.halo, r.range_no == 0, r.range_no == r.ranges - 1, limits))
            ]
            yield pd.DataFrame(rows, columns=["kind", "item", "base", "range_no", "k", "piece_start", "piece_end", "text"]).astype({"base": "Int64"})

    schema = "kind string, item long, base long, range_no int, k int, piece_start long, piece_end long, text string"
    one = whole.mapInPandas(run, schema).withColumn("before", F.lit(0).cast("long"))
    many = _numbered(spread.mapInPandas(run, schema), ["kind", "item"])
    return one.unionByName(many).select(
        "kind", "item", (F.col("k") + F.col("before")).alias("piece_no"), "piece_start", "piece_end",
        (F.col("base") + F.col("piece_start")).alias("start_offset"), (F.col("base") + F.col("piece_end")).alias("end_offset"), "text",
    )


def _numbered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``before``, the number of pieces in the ranges before, by a prefix sum over one row for each range."""
    counts = pieces.groupBy(*keys, "range_no").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(counts.select(*keys, "range_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), [*keys, "range_no"])


def _read_range(path: str, k: int, size: int, limits: Limits) -> tuple[str, int, bool]:
    """(text of the range with its halo, code points of the halo, whether it is the last). A code point belongs to the range that holds its first byte; bytes that aren't UTF-8 become replacement marks."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
    span = limits.file_span
    last = (k + 1) * span >= size

    def aligned(data: bytes, at: int) -> int:
        for step in range(3):
            if at + step < len(data) and data[at + step] & 0xC0 != 0x80:
                return at + step
        return min(at + 3, len(data))

    begin = max(0, k * span - 4 * limits.size)
    with system.open_input_file(name) as f:
        data = f.read_at(min(size, (k + 1) * span + 3) - begin, begin)
    low = aligned(data, k * span - begin) if k else 0
    high = len(data) if last else aligned(data, (k + 1) * span - begin)
    halo = data[aligned(data, 0) if begin else 0 : low].decode("utf-8", "replace")
    return halo + data[low:high].decode("utf-8", "replace"), len(halo), last


def split_files(spark: SparkSession, folder: str, pattern: str = "*", limits: Limits = Limits()) -> DataFrame:
    """(path, piece_no, start_offset, end_offset, text) of all files of a folder, offsets in code points; files within the limit give one piece, empty ones none.

    Only names and lengths are listed. Workers read byte ranges: a first pass counts the code points of each range, a
    prefix sum stitches them, a second pass emits the pieces with their offsets. No worker holds a whole file."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length").filter("length > 0")
    ranges = listed.withColumn("range_no", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / limits.file_span) - 1).cast("int")))).repartition("path", "range_no")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = []
            for r in batch.itertuples():
                text, halo, _ = _read_range(r.path, r.range_no, r.length, limits)
                lengths.append(len(text) - halo)
            yield batch.assign(n=lengths)

    counted = ranges.mapInPandas(count, "path string, length long, range_no int, n long")
    order = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    stitched = counted.withColumn("at", F.coalesce(F.sum("n").over(order), F.lit(0))).repartition("path", "range_no")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                text, halo, last = _read_range(r.path, r.range_no, r.length, limits)
                # the halo may hold more code points than a cut looks at; all cuts look at the same ones
                spare = max(0, halo - limits.size)
                text, halo = text[spare:], halo - spare
                rows = [(r.path, r.range_no, k, r.at - halo + a, r.at - halo + b, text[a:b]) for k, (a, b) in enumerate(pieces_of_range(text, halo, r.range_no == 0, last, limits))]
                yield pd.DataFrame(rows, columns=["path", "range_no", "k", "start_offset", "end_offset", "text"])

    pieces = stitched.mapInPandas(emit, "path string, range_no int, k int, start_offset long, end_offset long, text string")
    return _numbered(pieces, ["path"]).select("path", (F.col("k") + F.col("before")).alias("piece_no"), "start_offset", "end_offset", "text")
