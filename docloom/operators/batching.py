"""Batches of rows for model calls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import ranked


def fixed_batches(df: DataFrame, keys: list[str], order: str, size: int, stretch: int = 1 << 16) -> DataFrame:
    """Adds ``batch_no`` from 0: ``size`` rows a batch by the number ``order`` within each key. Ranks are taken in stretches of ``order``, so a key of any size is spread over tasks."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    numbered = ranked(df, keys, F.floor(F.col(order) / stretch), [order], "__rank")
    return numbered.withColumn("batch_no", F.floor(F.col("__rank") / size)).drop("__rank")


def capped(counts: Iterable[int | None], max_items: int, max_tokens: int) -> Iterator[int]:
    """The batch number of each item: a batch ends before an item that would pass either cap; a single item may pass the token cap. An unknown count is 0."""
    batch, items, tokens = 0, 0, 0
    for count in counts:
        n = int(count or 0)
        if items and (items >= max_items or tokens + n > max_tokens):
            batch, items, tokens = batch + 1, 0, 0
        items, tokens = items + 1, tokens + n
        yield batch


def token_batches(df: DataFrame, tokens: str = "token_count", max_items: int = 64, max_tokens: int = 2048) -> DataFrame:
    """Adds ``batch_id``: batches capped by items and tokens, made within each partition in its order, as a model call would meet them. No shuffle; ids are unique, as they begin with the partition's number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, batch in enumerate(batches):
            part = batch.pop("__partition").astype(str)
            numbers = list(capped([None if pd.isna(x) else x for x in batch[tokens]], max_items, max_tokens))
            yield batch.assign(batch_id=[f"{p}-{at}-{n}" for p, n in zip(part, numbers)])

    return df.withColumn("__partition", F.spark_partition_id()).mapInPandas(run, schema + ", batch_id string")


def batch_totals(df: DataFrame, batch: str = "batch_id", tokens: str = "token_count") -> DataFrame:
    """Items and tokens of each batch; the tokens are null if any count is."""
    known = F.count(tokens) == F.count(F.lit(1))
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("items"), F.when(known, F.sum(tokens)).alias("tokens"))
