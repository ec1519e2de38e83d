"""Reranking of candidates by a score of (query, text)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Reranker(Protocol):
    """A model that scores texts for one query; it gets whole batches."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


def overlap_score(query: Column, text: Column) -> Column:
    """The share of the query's different words that the text has; 0 without any."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9_]+)"), F.lit(1)))

    n = F.size(words(query))
    return F.when(n > 0, F.size(F.array_intersect(words(query), words(text))) / n).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, limit: int, reranker: Reranker | None = None, batch_rows: int = 32) -> DataFrame:
    """The best ``limit`` candidates (query_id, query, text, rank, ...) of each query, with ``rerank_score`` and ``rerank_rank``.

    Equal scores keep the order of the candidates. Without a model the native overlap score is used and no Python runs.
    A model's answer must have one number for each text."""
    if reranker is None:
        scored = candidates.withColumn("rerank_score", overlap_score(F.col("query"), F.col("text")))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list[float] = []
                for lo in range(0, len(batch), batch_rows):
                    part = batch.iloc[lo : lo + batch_rows]
                    got = reranker.score(part["query"].fillna("").tolist(), part["text"].fillna("").tolist())
                    if len(got) != len(part) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in got):
                        raise ValueError("the reranker must give one number for each text")
                    out += [float(x) for x in got]
                yield batch.assign(rerank_score=out)

        scored = candidates.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields) + ", rerank_score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= limit)
