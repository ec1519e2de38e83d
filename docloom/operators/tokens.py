"""Token counts by a public tokenizer's file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The split pattern that belongs to byte-level BPE rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts with a file of ranks (.tiktoken), a tokenizers file (.json) or a sentencepiece model (.model). No special tokens are added, and their strings are ordinary text."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of tokenizer file: {path}")


def with_token_counts(df: DataFrame, path: str, text: str = "text", out: str = "token_count") -> DataFrame:
    """Adds the token count of each text; null counts as empty. The file must be readable by every worker, which loads it once. No shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out) + f", `{out}` int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            yield batch.assign(**{out: count(batch[text].fillna("").tolist())})

    return df.drop(out).mapInPandas(run, schema)
