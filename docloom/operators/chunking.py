"""Cleaning and chunking of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import MIN_DOCUMENT_CHARS, clean_blocks, clean_text, render_blocks
from docloom.operators.chunk_kernel import DEFAULT_LIMIT, Block, ChunkingError, chunk


def clean_documents(documents: DataFrame, min_chars: int = MIN_DOCUMENT_CHARS) -> DataFrame:
    """Documents (crate, text, blocks) with clean blocks, the text rendered from them or, without any, cleaned itself; too short ones go. Null texts count as empty. No shuffle, no Python."""
    blocks = documents.withColumn("blocks", clean_blocks(F.col("blocks"), F.col("crate")))
    text = F.when(F.size("blocks") > 0, render_blocks(F.col("blocks"))).otherwise(clean_text(F.coalesce("text", F.lit("")), F.col("crate")))
    return blocks.withColumn("text", text).filter(F.length("text") >= min_chars)


def _blocks(rows) -> list[Block]:
    return [Block(b["block_type"] or "", b["text"] or "", int(b["list_depth"] or 0), b["code_language"] or "", b["anchor"], tuple(b["section_path"]) if b["section_path"] is not None else ()) for b in (rows if rows is not None else [])]


def chunk_documents(documents: DataFrame, max_chars: int = DEFAULT_LIMIT, min_chars: int = 180, strict: bool = True) -> DataFrame:
    """Chunks of documents (source_path, crate, title, text, blocks): source_path, crate, title, chunk_index, text, start_offset, end_offset, section_path, section_anchor, error.

    A document that can't be cut ends the job if ``strict``; else it gives one row with ``error`` and no text, for a
    table of failures. Null titles, texts and blocks count as empty; a document with an empty text gives no chunk. One
    document in, its chunks out: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch.itertuples():
                text, title, crate = d.text or "", d.title or "", d.crate or ""
                if not text.strip():
                    continue
                try:
                    pieces = chunk(text, title, crate, d.source_path or "", _blocks(d.blocks), max_chars, min_chars)
                except ChunkingError as e:
                    if strict:
                        raise ChunkingError(f"{d.source_path}: {e}") from e
                    rows.append((d.source_path, d.crate, d.title, None, None, None, None, None, None, str(e)))
                    continue
                rows += [(d.source_path, d.crate, d.title, k, text[p.start : p.end], p.start, p.end, list(p.path), p.anchor, None) for k, p in enumerate(pieces)]
            frame = pd.DataFrame(rows, columns=["source_path", "crate", "title", "chunk_index", "text", "start_offset", "end_offset", "section_path", "section_anchor", "error"])
            yield frame.astype({"chunk_index": "Int32", "start_offset": "Int32", "end_offset": "Int32"})

    schema = "source_path string, crate string, title string, chunk_index int, text string, start_offset int, end_offset int, section_path array<string>, section_anchor string, error string"
    return documents.select("source_path", "crate", "title", "text", "blocks").mapInPandas(run, schema)


def split_message(text: str, limit: int = 4000, blank: str = "There is no answer yet.") -> list[str]:
    """A text as messages under a limit, cut at the last line feed or blank past half of it."""
    rest, parts = text.strip(), []
    while len(rest) > limit:
        at = max(rest.rfind("\n", 0, limit), rest.rfind(" ", 0, limit))
        at = at if at >= limit // 2 else limit
        parts.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [p for p in [*parts, rest] if p] or [blank]


def split_messages(df: DataFrame, column: str, limit: int = 4000) -> DataFrame:
    """``df`` with one row for each message of ``column``: message_no from 0 and message."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_message(t or "", limit))

    return df.select("*", F.posexplode(cut(F.col(column))).alias("message_no", "message"))
