"""Problem 7: filling containers of fixed capacity, by linear grouping and a configuration program over length counts.

A packing depends only on how many items there are of each length, and lengths are whole numbers up to the capacity. So
the executors count tokens and send one row for each length; the driver plans over these at most ``capacity`` counts,
however many texts there are; and the executors turn (length, rank among equals) into (container, position).

Plan: items over ``small`` of the capacity are sorted and cut into ``groups`` of equal cardinality, lengths rounded up
within a group; column generation finds the best mix of configurations of these few lengths; actual lengths take their
places. Then the rest, small ones last, goes by best fit into the space that is left. Everything is kept as runs of
equal containers, so the work follows the number of different lengths, not of texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.tokens import counter
from docloom.runtime import materialize

@dataclass(frozen=True)
class PackSettings:
    """``tokenizer``: a file of ranks (.tiktoken), a tokenizers file (.json) or a sentencepiece model (.model) that every worker can read."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    capacity: int = 2048
    small: float = 0.25
    groups: int = 128
    rank_rows: int = 500_000


def knapsack(sizes: list[int], values: list[float], capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int32)
    useful = [k for k in range(len(sizes)) if values[k] > 1e-12]
    for k in useful:
        s, v = sizes[k], values[k]
        # copies of one size one after the other: with sizes over an eighth of the capacity there are few
        for _ in range(capacity // s):
            with_one = best[: capacity + 1 - s] + v
            better = with_one > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = with_one[better]
            took[s:][better] = k
    counts, room = [0] * len(sizes), int(capacity)
    total = 0.0
    # walk back over the table; where an entry was improved after it was used, what is found is a valid multiset still
    while room > 0:
        while room > 0 and took[room] < 0:
            room -= 1
        if room <= 0:
            break
        k = int(took[room])
        counts[k] += 1
        total += values[k]
        room -= sizes[k]
    return total, counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """(configuration, how often) of the linear program that covers the demand with the fewest containers, by column generation until no configuration is worth more than 1. A basis that comes again would go round for ever and ends it; what it has is a valid cover."""
    n = len(sizes)
    basis = [[capacity // s if k == j else 0 for j in range(n)] for k, s in enumerate(sizes)]
    amount = np.array([d / (capacity // s) for d, s in zip(demand, sizes)], float)
    seen: set[int] = set()
    while (mark := hash(tuple(sorted(map(tuple, basis))))) not in seen:
        seen.add(mark)
        matrix = np.array(basis, float).T
        dual = np.linalg.solve(matrix.T, np.ones(n))
        value, column = knapsack(sizes, dual.tolist(), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(matrix, np.array(column, float))
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, amount / np.where(rising, step, 1.0), np.inf)
        leaving = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[leaving] * step, 0.0)
        basis[leaving], amount[leaving] = column, ratio[leaving]
    return list(zip(basis, amount.tolist()))


@dataclass(frozen=True)
class Plan:
    """Runs: items of ``size`` with ranks [first, first + count) go to containers [container, container + count), at ``position``."""

    size: np.ndarray
    first: np.ndarray
    count: np.ndarray
    container: np.ndarray
    position: np.ndarray
    containers: int


def plan(histogram: dict[int, int], settings: PackSettings) -> Plan:
    """The packing of ``histogram`` (length -> how many), lengths from 1 to the capacity."""
    capacity = settings.capacity
    left = {s: n for s, n in histogram.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int, int]]] = {}  # free space -> runs of (container, count, items in each)
    rooms: list[int] = []
    opened = 0

    def put_back(free: int, run: tuple[int, int, int]) -> None:
        if free not in room:
            room[free] = []
            insort(rooms, free)
        room[free].append(run)

    def take(size: int, n: int, container: int, position: int) -> None:
        runs.append((size, used[size], n, container, position))
        used[size] += n
        left[size] -= n

    # linear grouping of the large items, longest first
    large = [s for s in sorted(left, reverse=True) if s > settings.small * capacity]
    total = sum(left[s] for s in large)
    groups: list[list[tuple[int, int]]] = []  # (size, how many) in descending order
    if total:
        cuts = sorted({-(-total * k // settings.groups) for k in range(1, settings.groups + 1)})
        seen, mine = 0, []
        for s in large:
            n = left[s]
            while n:
                part = min(n, cuts[len(groups)] - seen)
                mine.append((s, part))
                seen, n = seen + part, n - part
                if seen == cuts[len(groups)]:
                    groups.append(mine)
                    mine = []
    if groups:
        waiting = [list(reversed(g)) for g in groups]
        supply = [sum(n for _, n in g) for g in groups]
        for shape, often in configurations([g[0][0] for g in groups], supply, capacity):
            times = int(often + 1e-9)
            slots = [k for k, c in enumerate(shape) for _ in range(c)]
            if not slots:
                continue
            times = min([times, *(supply[k] // shape[k] for k in set(slots))])
            if times <= 0:
                continue
            free = [(opened, times, capacity)]  # runs of containers of this shape with equal free space
            for position, k in enumerate(slots):
                supply[k] -= times
                fresh = []
                for container, n, space in free:
                    while n:
                        size, have = waiting[k].pop()
                        part = min(n, have)
                        if have > part:
                            waiting[k].append((size, have - part))
                        take(size, part, container, position)
                        fresh.append((container, part, space - size))
                        container, n = container + part, n - part
                free = fresh
            opened += times
            for container, n, space in free:
                put_back(space, (container, n, len(slots)))

    # the rest by best fit, longest first
    for size in sorted(left, reverse=True):
        while left[size]:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(left[size], each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for position in range(k):
                            take(size, n, opened, position)
                        put_back(capacity - k * size, (opened, n, k))
                        opened += n
                break
            free = rooms[at]
            container, n, items = room[free].pop()
            part = min(n, left[size])
            take(size, part, container, items)
            if part < n:
                room[free].append((container + part, n - part, items))
            if not room[free]:
                del room[free]
                rooms.pop(at)
            put_back(free - size, (container, part, items + 1))
    runs.sort()
    columns = [np.array([r[k] for r in runs], np.int64) for k in range(5)]
    return Plan(*columns, opened)


def pack(documents: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """(container, doc, position, part, start_token, tokens) of ``documents`` (doc long, text).

    Only a text over the capacity is divided: into parts that fill a container each and a rest. Defined cases: a null or
    empty text and one without tokens takes no container and comes out with null container and position; a repeated id
    counts once (by the fewest tokens if they differ); a row without an id takes no part; among equal lengths the smaller id comes first within its hash
    bucket; an empty table gives an empty result; other columns are ignored."""
    spark, capacity = documents.sparkSession, settings.capacity

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or counter(settings.tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(tokens([t or "" for t in batch.column("text").to_pylist()]), pa.int64())], names=["doc", "n"])

    counted = documents.select(F.col("doc").cast("long"), "text").filter("doc IS NOT NULL").mapInArrow(count, "doc long, n long")
    lengths = materialize(counted.groupBy("doc").agg(F.min("n").alias("n")), "p7-lengths")
    parts = lengths.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1))))
    items = parts.select("doc", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("tokens"))
    histogram = {r[0]: r[1] for r in items.groupBy("tokens").count().collect()}  # at most capacity + 1 rows
    none = histogram.pop(0, 0)
    shared = spark.sparkContext.broadcast(plan(histogram, settings))
    # ranks among equal lengths, from ranks within hash buckets and the buckets' prefix sums
    salts = max(1, -(-max(histogram.values(), default=1) // settings.rank_rows))
    salted = items.filter("tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc", "part"), F.lit(salts)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc", "part")) - 1)
    if salts > 1:
        sizes = salted.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(sizes.select("tokens", "salt", before.alias("before")), ["tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = shared.value
        key = p.size << np.int64(40) | p.first
        for batch in batches:
            size, rank = batch.column("tokens").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(key, size << np.int64(40) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.container[at] + rank - p.first[at]), batch.column("doc"), pa.array(p.position[at].astype(np.int32)), *(batch.column(c) for c in ("part", "start_token", "tokens"))],
                names=["container", "doc", "position", "part", "start_token", "tokens"],
            )

    schema = "container long, doc long, position int, part int, start_token long, tokens int"
    placed = ranked.select("doc", "part", "start_token", "tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
    if none:
        placed = placed.unionByName(items.filter("tokens = 0").select(F.lit(None).cast("long").alias("container"), "doc", F.lit(None).cast("int").alias("position"), "part", "start_token", "tokens"))
    return placed
