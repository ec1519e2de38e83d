"""Ranks and neighbours inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import unused_name


def ranked(df: DataFrame, keys: list[str], stretch: Column, order: list[Column | str], out: str = "rank") -> DataFrame:
    """Adds ``out``, the rank from 0 of each row in its group by ``order``.

    ``stretch`` cuts a group into parts of bounded size that follow each other in the order: ranks are taken within a part
    and raised by the number of rows in the parts before, so no task holds a group. Null keys form a group."""
    part, count, base = (unused_name(df, n) for n in ("stretch", "stretch_rows", "rows_before"))
    rows = df.withColumn(part, stretch)
    sizes = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"{part}_{k}") for k in keys], F.col(part).alias(f"{part}_of"), F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    same = F.col(part).eqNullSafe(F.col(f"{part}_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{part}_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)) - 1
    joined = rows.withColumn(out, within).join(sizes, same)
    return joined.withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(part, base, f"{part}_of", *[f"{part}_{k}" for k in keys])


def with_neighbours(df: DataFrame, keys: list[str], rank: str, column: str) -> DataFrame:
    """Adds ``before`` and ``after``: ``column`` of the rows whose rank is one less and one more in the group. Joins on (group, rank), which no group can make hot; null keys have no neighbours."""
    at = [*keys, rank]

    def moved(step: int, name: str) -> DataFrame:
        return df.select(*keys, (F.col(rank) + step).alias(rank), F.col(column).alias(name))

    return df.join(moved(1, "before"), at, "left").join(moved(-1, "after"), at, "left")
