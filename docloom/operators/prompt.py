"""Context selection under a token budget and prompt text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_CONTEXT = "The sources hold nothing about this question."


def within_budget(ranked: DataFrame, budget: int, tokens: str = "token_count") -> DataFrame:
    """The longest prefix by rank of each query (query_id, rank, ``tokens``) whose tokens fit, with ``context_tokens``, their running sum. The first row over the budget ends the prefix. Null counts as 0."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("context_tokens", F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(order)).filter(F.col("context_tokens") <= budget)


def question_fits(questions: DataFrame, limit: int, tokens: str = "token_count") -> DataFrame:
    """Questions whose tokens are within the limit."""
    return questions.filter(F.col(tokens) <= limit)


def prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, prompt, blocks, answer): one row for each question (query_id, question).

    ``context`` (query_id, rank, item_path, title, crate, token_count, text) is numbered from 1 by rank. A question
    without context has no prompt but a fixed answer. A query's context is bounded by its token budget."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    head = F.concat_ws(" | ", F.coalesce(F.when(F.col("item_path") != "", F.col("item_path")), "title", F.lit("")), F.coalesce(F.when(F.col("crate") != "", F.col("crate")), F.lit("unknown")), F.concat(F.lit("token_count="), F.coalesce("token_count", F.lit(0)).cast("string")))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), head, F.lit("\n"), F.coalesce("text", F.lit("")))
    blocks = context.withColumn("n", number).select("query_id", "n", block.alias("block"))
    joined = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("all"))
    out = questions.select("query_id", "question").join(joined, "query_id", "left")
    text = F.concat(F.lit("Question:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nContext:\n"), F.array_join(F.transform("all", lambda b: b["block"]), "\n\n"))
    return out.select("query_id", text.alias("prompt"), F.when(F.col("all").isNull(), F.lit(0)).otherwise(F.size("all")).alias("blocks"), F.when(F.col("all").isNull(), F.lit(NO_CONTEXT)).alias("answer"))
