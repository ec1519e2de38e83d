"""Embedding of texts through a port; the default is a deterministic hashing model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from docloom.operators.batching import capped


class Embedder(Protocol):
    """A model that turns texts into vectors of ``size`` numbers."""

    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed counts of hashed words, scaled to length 1; a text without words is the zero vector."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        from zlib import crc32

        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in re.findall(r"[a-z0-9_]+", text.lower()):
                h = crc32(word.encode())
                row[h % self.size] += 1 if h & 0x80000000 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()


def embed(df: DataFrame, embedder: Embedder | None = None, text: str = "text", max_items: int = 64, max_tokens: int = 2048) -> DataFrame:
    """Adds ``vector``. Texts go to the model in batches capped by items and words; its answer must have one vector of its size for each text. Null texts count as empty. No shuffle."""
    model = embedder or HashingEmbedder()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", vector array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            numbers = np.fromiter(capped([t.count(" ") + 1 for t in texts], max_items, max_tokens), np.int64, len(texts))
            vectors: list[list[float]] = []
            for n in range(numbers[-1] + 1 if len(numbers) else 0):
                part = [texts[k] for k in np.flatnonzero(numbers == n)]
                got = model.embed(part)
                if len(got) != len(part) or any(len(v) != model.size for v in got):
                    raise ValueError("the embedder must give one vector of its size for each text")
                vectors += got
            yield batch.assign(vector=vectors)

    return df.mapInPandas(run, schema)
