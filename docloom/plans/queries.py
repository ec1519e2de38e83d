"""The registered queries of the core operators, each (spark, directory) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import metadata, selection, text
from docloom.functions.ids import chunk_id, document_id
from docloom.operators import batching, dedup, evaluate, prompt, ranking, rerank, search
from docloom.operators.chunking import chunk_documents, clean_documents, split_messages
from docloom.operators.parse import parse_pages
from docloom.plans.pipeline import checked_queries, ingest_documents, rebuild, retrieve
from docloom.runtime import read_table, scratch
from docloom.schemas import BLOCK
from docloom.sources import store
from docloom.streaming.ingest import arrivals

c = F.col


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """document_record, each pk once, with its text and blocks under the engine's names. Repeated deliveries are equal in all but their time."""
    rows = read_table(spark, directory, "document_record").dropDuplicates(["pk"])
    return rows.withColumnsRenamed({"text_content": "text", "parsed_content": "blocks"})


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "chunk_record").dropDuplicates(["pk"])


def chunks_of_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks with the path and crate of their document; those whose document is gone are left out."""
    parents = documents(spark, directory).select(c("pk").alias("document_pk"), "source_path", "crate")
    return chunks(spark, directory).join(parents, "document_pk")


def hits(spark: SparkSession, directory: str) -> DataFrame:
    """Search hits, repeated rows once, with one id for each run (query and mode)."""
    rows = read_table(spark, directory, "search_hit").distinct()
    return rows.withColumn("query_id", F.concat_ws("/", "query_id", "mode"))


def questions(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "eval_case").select(c("id").alias("query_id"), c("question").alias("text"))


def _hydrated(spark: SparkSession, directory: str, found: DataFrame) -> DataFrame:
    """Repeated deliveries are made one by the hydration itself."""
    return search.hydrate(found, read_table(spark, directory, "chunk_record"), read_table(spark, directory, "document_record"))


# texts, ids, metadata


def text_hashes(spark, directory):
    return read_table(spark, directory, "documents", "doc_id", "text").select("doc_id", text.text_hash(c("text")).alias("hash"))


def clean_texts(spark, directory):
    rows = read_table(spark, directory, "documents", "doc_id", "text", "crate")
    return rows.select("doc_id", F.md5(text.clean_text(c("text"), c("crate"))).alias("clean_md5"))


def normal_texts(spark, directory):
    return read_table(spark, directory, "documents", "doc_id", "text").select("doc_id", F.md5(text.normalize_text(c("text"))).alias("normal_md5"))


def clean_code(spark, directory):
    blocks = documents(spark, directory).select("pk", F.posexplode("blocks").alias("block_no", "b")).filter("b.block_type = 'code_block'")
    return blocks.select("pk", c("block_no").cast("long").alias("block_no"), F.md5(text.clean_code(c("b.text"))).alias("code_md5"))


def rendered_blocks(spark, directory):
    return documents(spark, directory).select("pk", F.md5(text.render_blocks(c("blocks"))).alias("text_md5"))


def clean_document_sizes(spark, directory):
    return clean_documents(documents(spark, directory)).select("pk", F.size("blocks").cast("long").alias("blocks"), F.length("text").cast("long").alias("chars"))


def short_documents(spark, directory):
    rows = read_table(spark, directory, "documents", "doc_id", "text", "crate")
    return rows.select("doc_id", (F.length(text.clean_text(c("text"), c("crate"))) < text.MIN_DOCUMENT_CHARS).alias("short"))


def token_counts(spark, directory):
    return chunks(spark, directory).select("pk", text.token_count(c("text")).cast("long").alias("tokens"))


def document_ids(spark, directory):
    return documents(spark, directory).select("pk", document_id(c("source_path")).alias("document_id"))


def chunk_ids(spark, directory):
    rows = chunks_of_documents(spark, directory)
    return rows.select("pk", chunk_id(document_id(c("source_path")), c("chunk_index")).alias("chunk_id"))


def document_urls(spark, directory):
    return documents(spark, directory).select("pk", metadata.document_url(c("source_path"), c("crate")).alias("url"))


def detected_crates(spark, directory):
    return documents(spark, directory).select("pk", metadata.detect_crate(c("source_path")).alias("crate"))


def item_paths(spark, directory):
    none = F.array().cast("array<string>")
    return documents(spark, directory).select("pk", metadata.item_path(c("source_path"), c("crate"), c("title"), none).alias("item_path"))


def item_types(spark, directory):
    none = F.array().cast("array<string>")
    return documents(spark, directory).select("pk", metadata.item_type(c("source_path"), c("crate"), c("title"), c("text"), none).alias("item_type"))


def section_titles(spark, directory):
    return chunks(spark, directory).select("pk", metadata.section_title(c("section_path")).alias("section_title"))


def selected_paths(spark, directory):
    return documents(spark, directory).filter(selection.path_selected(c("source_path"), c("crate"))).select("pk")


def page_flags(spark, directory):
    rows = read_table(spark, directory, "documents", "doc_id", "text")
    return rows.select("doc_id", selection.is_redirect(c("text")).alias("redirect"), selection.is_legacy(c("text")).alias("legacy"))


def block_codec(spark, directory):
    kind = f"array<{BLOCK}>"
    rows = documents(spark, directory).select("pk", "blocks", F.from_json(F.to_json("blocks"), kind).alias("again"))
    return rows.select("pk", F.coalesce(F.size("again"), F.lit(-1)).cast("long").alias("blocks"), c("again").eqNullSafe(c("blocks")).alias("same"))


# pages


def _as_html(blocks):
    """A page that holds the blocks as elements."""

    def escaped(x):
        return F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def one(b):
        body = escaped(b["text"])
        return (
            F.when(b["block_type"] == "heading", F.concat(F.lit("<h"), b["heading_level"].cast("string"), F.lit(">"), body, F.lit("</h"), b["heading_level"].cast("string"), F.lit(">")))
            .when(b["block_type"] == "list_item", F.concat(F.lit("<ul><li>"), body, F.lit("</li></ul>")))
            .when(b["block_type"] == "code_block", F.concat(F.lit("<pre><code>"), body, F.lit("</code></pre>")))
            .when(b["block_type"] == "definition_term", F.concat(F.lit("<dl><dt>"), body, F.lit("</dt></dl>")))
            .when(b["block_type"] == "definition_desc", F.concat(F.lit("<dl><dd>"), body, F.lit("</dd></dl>")))
            .otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
        )

    return F.array_join(F.transform(blocks, one), "\n")


def parsed_pages(spark, directory):
    """Blocks of each type in pages made from the stored blocks and parsed again, noise around them."""
    rows = documents(spark, directory)
    html = F.concat(F.lit("<html><head><title>"), F.trim("title"), F.lit("</title></head><body><nav><p>menu</p></nav><main>"), _as_html(c("blocks")), F.lit("</main><footer><p>end</p></footer></body></html>"))
    pages = rows.select(F.concat(F.lit("std/"), c("pk").cast("string")).alias("source_path"), F.lit("std").alias("crate"), html.alias("html"))
    parsed, _ = parse_pages(pages)
    block = parsed.select(F.substring_index("source_path", "/", -1).cast("long").alias("pk"), F.explode("blocks").alias("b"))
    return block.groupBy("pk", c("b.block_type").alias("block_type")).agg(F.count(F.lit(1)).alias("blocks"))


# duplicates


def unique_documents(spark, directory):
    return dedup.dedup_documents(documents(spark, directory).select("pk", "crate", "source_path", "item_path", "text")).select("pk")


def duplicate_groups(spark, directory):
    rows = read_table(spark, directory, "documents", "crate", "text").select("crate", text.text_hash(c("text")).alias("hash"))
    return rows.groupBy("crate", "hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unique_chunks(spark, directory):
    rows = chunks_of_documents(spark, directory).select("pk", "crate", "source_path", "chunk_index", "text", "start_offset", "end_offset", "section_path")
    return dedup.dedup_chunks(rows).select("pk", c("chunk_index").cast("long").alias("chunk_index"), "id", "text_hash")


def renumbered_chunks(spark, directory):
    rows = chunks_of_documents(spark, directory).select("pk", "source_path", "chunk_index", "start_offset", "end_offset")
    return dedup.reindex(rows).select("pk", c("chunk_index").cast("long").alias("chunk_index"))


# chunk filters and folds


def low_value_chunks(spark, directory):
    return chunks(spark, directory).select("pk", text.is_low_value(c("text")).alias("low_value"))


def changelog_stubs(spark, directory):
    rows = chunks_of_documents(spark, directory)
    return rows.select("pk", text.is_changelog_stub(c("text"), c("crate"), c("source_path"), c("section_path")).alias("stub"))


def lone_headings(spark, directory):
    rows = chunks(spark, directory).select("pk", "document_pk", "chunk_index", "section_path", text.is_heading_only(c("text"), c("section_path")).alias("lone"))
    rows = ranking.ranked(rows, ["document_pk"], F.floor(c("chunk_index") / 4096), ["chunk_index", "pk"])
    rows = ranking.with_neighbours(rows, ["document_pk"], "rank", "section_path")
    near = F.coalesce(c("before") == c("section_path"), F.lit(False)) | F.coalesce(c("after") == c("section_path"), F.lit(False))
    return rows.select("pk", F.coalesce("lone", F.lit(False)).alias("lone"), near.alias("near"))


def block_sections(spark, directory):
    blocks = documents(spark, directory).select("pk", F.posexplode("blocks").alias("block_no", "b")).select("pk", "block_no", (c("b.block_type") == "heading").cast("int").alias("heading"))
    order = Window.partitionBy("pk").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("pk", c("block_no").cast("long").alias("block_no"), F.sum("heading").over(order).cast("long").alias("section"))


def chunk_stats(spark, directory):
    """Chunks of the clean, unique documents by crate."""
    rows = dedup.dedup_documents(clean_documents(documents(spark, directory)))
    made = chunk_documents(rows, strict=False)
    return made.groupBy("crate").agg(
        F.countDistinct("source_path").alias("documents"), F.count("chunk_index").alias("chunks"), F.count("error").alias("failures"), F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 3).alias("mean_chars")
    ).orderBy("crate")


def document_chunks(spark, directory):
    rows = clean_documents(documents(spark, directory))
    return chunk_documents(rows, strict=False).select("source_path", "chunk_index", "start_offset", "end_offset", "section_path", "section_anchor", F.md5("text").alias("text_md5"), "error")


def message_parts(spark, directory):
    rows = read_table(spark, directory, "documents", "doc_id", "text")
    return split_messages(rows, "text").select("doc_id", "message_no", F.length("message").alias("chars"))


def numbered_batches(spark, directory):
    rows = chunks_of_documents(spark, directory).select("pk", "document_pk")
    return batching.fixed_batches(rows, ["document_pk"], "pk", 32).select("pk", "batch_no")


def token_capped_batches(spark, directory):
    rows = chunks(spark, directory).select("pk", "token_count")
    return batching.batch_totals(batching.token_batches(rows))


def message_coverage(spark, directory):
    """Whether the messages of a text are short enough and hold all of it but blanks."""
    rows = read_table(spark, directory, "documents", "doc_id", "text")
    parts = split_messages(rows, "text").groupBy("doc_id", "text").agg(F.max(F.length("message")).alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_no", "message"))), lambda m: m["message"]), "").alias("all"))
    bare = lambda x: F.regexp_replace(x, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085\x1c-\x1f]", "")
    return parts.select("doc_id", (c("longest") <= 4000).alias("short"), (bare(c("all")) == bare(c("text"))).alias("whole"))


def batch_coverage(spark, directory):
    """Whether batches hold every chunk, and how many break a limit; the tokens of a batch with an unknown count are unknown."""
    totals = token_capped_batches(spark, directory)
    broken = (c("items") > 64) | ((c("tokens") > 2048) & (c("items") > 1))
    return totals.agg(F.sum("items").alias("items"), F.count(F.when(broken, 1)).alias("broken"))


# vectors


def _vector_query(distance):
    def query(spark, directory):
        rows = read_table(spark, directory, "embeddings", "vec_id", "embedding").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
        asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
        return search.top_k(asked, rows, 10, distance).select("query_id", "id", F.round("score", 5).alias("score"), c("rank").cast("long").alias("rank"))

    return query


def vector_threshold(spark, directory):
    rows = read_table(spark, directory, "embeddings", "vec_id", "embedding").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
    asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return search.top_k(asked, rows, 50, "cosine", 0.2).select("query_id", "id", c("rank").cast("long").alias("rank"))


def vector_filtered(spark, directory):
    rows = read_table(spark, directory, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
    asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return search.filtered_top_k(asked, rows, c("label") < 5, k=10).select("query_id", "id", c("rank").cast("long").alias("rank"))


def point_payloads(spark, directory):
    names = ["crate", "document_id", "item_path", "item_type", "rust_version", "section_title", "source_path", "text_hash"]
    rows = read_table(spark, directory, "vector_point", "chunk_id", *names).distinct()
    payload = search.payload_map(rows, names)
    return rows.select("chunk_id", F.array_join(F.array_sort(F.map_keys(payload)), ",").alias("keys"), F.array_join(F.map_values(payload), "|").alias("payload"))


def decoded_payloads(spark, directory):
    """Payloads written as maps and read back into columns."""
    rows = read_table(spark, directory, "vector_point", "chunk_id", "document_id", "crate", "item_path", "section_title", "chunk_index").distinct()
    payload = search.payload_map(rows, ["document_id", "crate", "item_path", "section_title", "chunk_index"])
    return rows.select("chunk_id", payload.alias("p")).select("chunk_id", *search.payload_columns(c("p"), ["document_id", "crate"], ["item_path", "section_title", "chunk_index"]))


# retrieval


def hydrated_hits(spark, directory):
    found = _hydrated(spark, directory, hits(spark, directory))
    return found.select("query_id", c("rank").cast("long").alias("rank"), "chunk_id", "source_path", "title", "crate")


def first_hits(spark, directory):
    found = _hydrated(spark, directory, search.first_hits(hits(spark, directory), 10))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.max("rank").cast("long").alias("last_rank"))


def _candidates(spark, directory):
    texts = read_table(spark, directory, "chunk_record", "id", "text")
    return search.lexical_top_k(questions(spark, directory), texts, 20)


def lexical_hits(spark, directory):
    return _candidates(spark, directory).select("query_id", "id", F.round("score", 6).alias("score"), c("rank").cast("long").alias("rank"))


def reranked_hits(spark, directory):
    texts = chunks(spark, directory).select("id", "text")
    found = _candidates(spark, directory).join(texts, "id").join(questions(spark, directory).withColumnRenamed("text", "query"), "query_id")
    best = rerank.rerank(found, 10)
    return best.select("query_id", "id", F.round("rerank_score", 6).alias("score"), c("rerank_rank").cast("long").alias("rank"))


def context_prefix(spark, directory):
    found = _hydrated(spark, directory, hits(spark, directory))
    kept = prompt.within_budget(found.dropDuplicates(["query_id", "rank"]), 2500)
    return kept.select("query_id", c("rank").cast("long").alias("rank"), c("context_tokens").cast("long").alias("context_tokens"))


def prompt_texts(spark, directory):
    found = _hydrated(spark, directory, _candidates(spark, directory).withColumnRenamed("id", "chunk_id"))
    asked = questions(spark, directory).withColumnRenamed("text", "question")
    made = prompt.prompts(asked, prompt.within_budget(found, 2500))
    return made.select("query_id", F.md5("prompt").alias("prompt_md5"), c("blocks").cast("long").alias("blocks"), c("answer").isNotNull().alias("unanswered"))


# evaluation


def _ranks(spark, directory, hits_of):
    cases = read_table(spark, directory, "eval_case")
    found = _hydrated(spark, directory, hits_of(spark, directory).withColumnRenamed("id", "chunk_id"))
    return evaluate.first_ranks(cases, found.withColumnRenamed("query_id", "case_id"))


def eval_ranks(spark, directory):
    return _ranks(spark, directory, lexical_hits).select("case_id", c("rank").cast("long").alias("rank"), "top_source_path")


def eval_summary(spark, directory):
    out = evaluate.summary(_ranks(spark, directory, lexical_hits))
    return out.select("total", "matched", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"), (c("hit_rate") >= 0.8).alias("passed"))


def eval_weak_cases(spark, directory):
    return evaluate.weak_cases(_ranks(spark, directory, lexical_hits)).select("case_id", c("rank").cast("long").alias("rank"))


def eval_comparison(spark, directory):
    out = evaluate.compare(_ranks(spark, directory, lexical_hits), _ranks(spark, directory, reranked_hits))
    return out.select("case_id", c("rank_a").cast("long").alias("rank_a"), c("rank_b").cast("long").alias("rank_b"), "change")


def hit_latency(spark, directory):
    ms = (F.unix_micros(c("received_at").cast("timestamp")) - F.unix_micros(c("searched_at").cast("timestamp"))) / 1000
    rows = read_table(spark, directory, "search_hit").distinct()
    return rows.groupBy("mode").agg(F.round(F.avg(ms), 2).alias("average_latency_ms"), F.count(F.lit(1)).alias("hits"))


def hit_arrivals(spark, directory):
    return arrivals(read_table(spark, directory, "search_hit").distinct()).select("start", "mode", "hits", F.round("mean_score", 6).alias("mean_score"))


# integrity


def documents_without_chunks(spark, directory):
    """Documents without a chunk beyond the fourth."""
    left, right = documents(spark, directory).select("pk"), chunks(spark, directory).filter("chunk_index > 3").select(c("document_pk").alias("pk"))
    return store.documents_without_chunks(left, right, "pk")


def chunks_without_documents(spark, directory):
    left, right = documents(spark, directory).select("pk"), chunks(spark, directory).select(c("document_pk").alias("pk"))
    return store.chunks_without_documents(left, right, "pk")


def path_difference(spark, directory):
    """Paths of documents that no search hit leads to."""
    ours = documents(spark, directory).select("source_path").distinct()
    return ours.subtract(_hydrated(spark, directory, hits(spark, directory)).select("source_path"))


def vectors_of_lost_chunks(spark, directory):
    points = read_table(spark, directory, "vector_point", "chunk_id").distinct()
    return points.join(chunks(spark, directory).select(c("id").alias("chunk_id")), "chunk_id", "left_anti")


def stage_counts(spark, directory):
    """Rows of each stage of the ingest of the table's documents."""
    stages = ingest_documents(documents(spark, directory), "dedup").stages
    out = None
    for name, df in stages.items():
        one = df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _stored(spark, directory):
    """A store in the shared folder, rebuilt from the table's documents; those that can't be cut are left out."""
    base = store.KnowledgeBase(spark, scratch(spark, "store"))
    rows = documents(spark, directory).select("source_path", "title", "text", "crate", "url", "item_path", "item_type", "rust_version", "blocks")
    rebuild(base, ingest_documents(rows, strict=False))
    return base


def stored_chunks(spark, directory):
    """What a version of the store holds, by crate, and whether every chunk stands in its document as its offsets say, has the id of its path and index, and a vector."""
    base = _stored(spark, directory)
    made = base.read("chunks").join(base.read("documents").select("source_path", c("text").alias("whole")), "source_path")
    made = made.join(base.read("vectors").select(c("chunk_id").alias("id"), F.size("vector").alias("numbers")), "id", "left")
    exact = F.substring("whole", c("start_offset") + 1, c("end_offset") - c("start_offset")) == c("text")
    named = c("id") == chunk_id(document_id(c("source_path")), c("chunk_index"))
    return made.groupBy("crate").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_path").alias("documents"), F.count(F.when(exact, 1)).alias("exact"), F.count(F.when(named, 1)).alias("named"), F.count("numbers").alias("with_vector")
    )


def retrieved_hits(spark, directory):
    """What the evaluation questions find in such a store, reranked."""
    found = retrieve(_stored(spark, directory), questions(spark, directory).withColumnRenamed("text", "question"))
    return found.select("query_id", "rank", "chunk_id", "source_path", "section_title", "item_type", "url", F.round("score", 6).alias("score"))


def rejected_questions(spark, directory):
    """Document titles and texts as questions: which would be rejected and why."""
    rows = read_table(spark, directory, "documents", "doc_id", "text").select(c("doc_id").alias("query_id"), c("text").alias("question"))
    return checked_queries(rows, 200).select("query_id", F.length("question").alias("chars"), "rejected")


def eval_deltas(spark, directory):
    out = evaluate.deltas(_ranks(spark, directory, lexical_hits), _ranks(spark, directory, reranked_hits))
    return out.select(F.round("hit_rate_delta", 6).alias("hit_rate_delta"), F.round("mrr_delta", 6).alias("mrr_delta"), "improved", "regressed", "same")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_hashes, clean_texts, normal_texts, clean_code, rendered_blocks, clean_document_sizes, short_documents, token_counts, document_ids, chunk_ids,
        document_urls, detected_crates, item_paths, item_types, section_titles, selected_paths, page_flags, block_codec, parsed_pages, unique_documents,
        duplicate_groups, unique_chunks, renumbered_chunks, low_value_chunks, changelog_stubs, lone_headings, block_sections, chunk_stats, document_chunks,
        message_parts, message_coverage, numbered_batches, token_capped_batches, batch_coverage, vector_threshold, vector_filtered, point_payloads, decoded_payloads, hydrated_hits, first_hits, lexical_hits,
        reranked_hits, context_prefix, prompt_texts, eval_ranks, eval_summary, eval_weak_cases, eval_comparison, hit_latency, hit_arrivals, documents_without_chunks,
        chunks_without_documents, path_difference, vectors_of_lost_chunks, stage_counts, stored_chunks, retrieved_hits, rejected_questions, eval_deltas,
    )
} | {f"vector_top_{d}": _vector_query(d) for d in search.DISTANCES}
