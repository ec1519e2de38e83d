"""The ingest as lazy stages, and retrieval and chat over the result."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.metadata import section_title
from docloom.functions.text import token_count
from docloom.operators import search
from docloom.operators.chunking import chunk_documents, clean_documents
from docloom.operators.dedup import dedup_chunks, dedup_documents
from docloom.operators.embed import Embedder, embed
from docloom.operators.parse import documents_of, failures_of, parse_facts, versions_of
from docloom.operators.prompt import prompts, within_budget
from docloom.operators.rerank import Reranker, rerank
from docloom.operators.tokens import with_token_counts
from docloom.runtime import materialize
from docloom.sources.files import crate_scope, discover, first_by_crate, key_pages, scoped_pages
from docloom.sources.store import KnowledgeBase

STAGES = ("discover", "parse", "clean", "dedup", "chunk", "chunk_dedup", "all")
PERSISTED = ("chunk_dedup", "all")


@dataclass(frozen=True)
class Settings:
    max_chunk_chars: int = 1400
    min_chunk_chars: int = 180
    retrieval_limit: int = 20
    reranking_limit: int = 10
    max_query_tokens: int = 1000
    max_context_tokens: int = 2500
    distance: str = "cosine"

    def __post_init__(self) -> None:
        if not 1 <= self.reranking_limit <= self.retrieval_limit <= 100:
            raise ValueError("limits must be from 1 to 100, the reranking limit no more than the retrieval limit")
        if self.distance not in search.DISTANCES:
            raise ValueError(f"unknown distance {self.distance!r}")
        if min(self.max_chunk_chars, self.min_chunk_chars, self.max_query_tokens, self.max_context_tokens) < 1:
            raise ValueError("sizes must be positive")


    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "DOCLOOM_") -> Settings:
        """Settings from variables such as DOCLOOM_RETRIEVAL_LIMIT; a value that isn't of its setting's type is an error that names it."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            if (value := env.get(prefix + f.name.upper())) is None:
                continue
            try:
                found[f.name] = type(f.default)(value)
            except (TypeError, ValueError):
                raise ValueError(f"{prefix}{f.name.upper()}={value!r} is no {type(f.default).__name__}") from None
        return cls(**found)


@dataclass
class Artifacts:
    """A DataFrame for each stage that was asked for. What costs (parsing, unique documents, chunks) is computed once and read from the shared folder by all that follows; ``docloom.runtime.release`` deletes it."""

    stages: dict[str, DataFrame] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {name: df.count() for name, df in self.stages.items()}


def check_options(stage: str, persist: bool, limit: int | None, confirmed: bool) -> None:
    """A stage that doesn't exist, persisting half a pipeline, and replacing everything by a sample without saying so are errors."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; one of {', '.join(STAGES)}")
    if persist and stage not in PERSISTED:
        raise ValueError(f"only {' and '.join(PERSISTED)} can be persisted")
    if persist and limit and not confirmed:
        raise ValueError("a limited ingest would replace the whole store; confirm it")


def ingest(spark: SparkSession, root: str, stage: str = "all", crates: list[str] | None = None, limit: int | None = None, settings: Settings = Settings()) -> Artifacts:
    """Stages up to ``stage``: pages, documents and failures, clean and unique documents, chunks, unique chunks. Files are read and parsed once; the versions come from key pages, which may lie outside of a sample."""
    check_options(stage, False, limit, False)
    out = Artifacts()
    if stage == "discover":
        out.stages["discover"] = discover(spark, root, crates, limit)
        return out
    facts = parse_facts(scoped_pages(spark, root, crates)).filter((F.col("crate") == "std") | F.col("meaningful"))
    facts = materialize(first_by_crate(facts, crates, limit), "ingest-parsed")
    out.stages["discover"] = facts.select("source_path", "crate")
    versions = F.broadcast(versions_of(parse_facts(key_pages(spark, root, crate_scope(crates)))))  # at most one row a crate
    out.stages["parse"], out.stages["failures"] = documents_of(facts, versions), failures_of(facts)
    return ingest_documents(out.stages["parse"], stage, settings, out)


def ingest_documents(documents: DataFrame, stage: str = "all", settings: Settings = Settings(), out: Artifacts | None = None, strict: bool = True) -> Artifacts:
    """The stages after parsing, for documents from any source. A document that can't be cut ends the job if ``strict``; else it is left out of the unique documents, and stage ``uncut`` has its path and the error."""
    out = out or Artifacts()
    wanted = STAGES[STAGES.index("clean") : STAGES.index("chunk_dedup" if stage == "all" else stage) + 1] if stage not in ("discover", "parse") else ()
    if "clean" in wanted:
        out.stages["clean"] = clean_documents(documents)
    if "dedup" in wanted:
        out.stages["dedup"] = materialize(dedup_documents(out.stages["clean"]), "ingest-documents")
    if "chunk" in wanted:
        made = materialize(chunk_documents(out.stages["dedup"], settings.max_chunk_chars, settings.min_chunk_chars, strict), "ingest-chunks")
        out.stages["chunk"] = made.filter("error IS NULL").drop("error")
        if not strict:
            out.stages["uncut"] = made.filter("error IS NOT NULL").select("source_path", "error")
            out.stages["dedup"] = out.stages["dedup"].join(out.stages["uncut"].select("source_path"), "source_path", "left_anti")
    if "chunk_dedup" in wanted:
        out.stages["chunk_dedup"] = materialize(dedup_chunks(out.stages["chunk"]), "ingest-unique")
    return out


def rebuild(base: KnowledgeBase, artifacts: Artifacts, embedder: Embedder | None = None, tokenizer: str | None = None, distance: str = "cosine") -> str:
    """Counts tokens (with a tokenizer's file if one is named), embeds and replaces the store; vectors are made before anything is replaced."""
    chunks = artifacts.stages["chunk_dedup"]
    chunks = with_token_counts(chunks, tokenizer) if tokenizer else chunks.withColumn("token_count", token_count(F.col("text")))
    vectors = embed(chunks.select(F.col("id").alias("chunk_id"), "text"), embedder).drop("text")
    return base.replace(artifacts.stages["dedup"], chunks, vectors, distance)


MAX_QUESTION_CHARS = 1000


def checked_queries(queries: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``queries`` (query_id, question) with the question stripped and ``rejected``: null for a valid one, else blank, too_long (over 1,000 characters) or too_many_tokens (with ``max_tokens``, which only chat has). A null question is blank."""
    text = F.coalesce(F.regexp_replace("question", r"^\s+|\s+$", ""), F.lit(""))
    reason = F.when(F.length("question") == 0, "blank").when(F.length("question") > MAX_QUESTION_CHARS, "too_long")
    if max_tokens is not None:
        reason = reason.when(token_count(F.col("question")) > max_tokens, "too_many_tokens")
    return queries.withColumn("question", text).withColumn("rejected", reason)


def valid_queries(queries: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """The valid ones; ``checked_queries`` tells what is wrong with the others."""
    return checked_queries(queries, max_tokens).filter("rejected IS NULL").drop("rejected")


def retrieve(base: KnowledgeBase, queries: DataFrame, settings: Settings = Settings(), embedder: Embedder | None = None, reranker: Reranker | None = None, use_reranking: bool = True) -> DataFrame:
    """Ranked chunks for each query (query_id, question): vector search, hydration and, if asked for, reranking of what was hydrated. Rows have the chunk's section and its document's title, url and item. Invalid questions give no rows; ``checked_queries`` tells why."""
    asked = embed(valid_queries(queries).select("query_id", F.col("question").alias("text")), embedder)
    corpus = base.read("vectors").withColumnRenamed("chunk_id", "id")
    if (kept := base.vector_space()[1]) != settings.distance:
        raise ValueError(f"the store's vectors are for {kept}, not for {settings.distance}")
    hits = search.top_k(asked.select("query_id", "vector"), corpus, settings.retrieval_limit, settings.distance).withColumnRenamed("id", "chunk_id")
    if not use_reranking:
        hits = search.first_hits(hits, settings.reranking_limit)
    chunks = base.read("chunks").select(F.col("id").alias("chunk_id"), "source_path", "text", "section_path", section_title(F.col("section_path")).alias("section_title"), "section_anchor", "token_count")
    documents = base.read("documents").select("source_path", "title", "url", "item_path", "item_type", "crate", "rust_version")
    found = hits.join(chunks, "chunk_id").join(documents, "source_path")
    if not use_reranking:
        return found
    candidates = found.join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    best = rerank(candidates, settings.reranking_limit, reranker)
    return best.drop("rank", "score", "query").withColumnsRenamed({"rerank_rank": "rank", "rerank_score": "score"})


def chat_prompts(base: KnowledgeBase, queries: DataFrame, settings: Settings = Settings(reranking_limit=5), **ports) -> DataFrame:
    """One row for each query: its prompt from its ranked chunks within the token budget, or null and the reason for which the question was rejected."""
    checked = checked_queries(queries, settings.max_query_tokens)
    fine = checked.filter("rejected IS NULL").drop("rejected")
    made = prompts(fine, within_budget(retrieve(base, fine, settings, **ports), settings.max_context_tokens))
    refused = checked.filter("rejected IS NOT NULL").select("query_id", "question", "rejected")
    return made.unionByName(refused, allowMissingColumns=True)
