"""Evaluation cases from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schemas import EVAL_CASE


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expected) of a JSON-lines file; blank lines are skipped, a missing id is ``line-`` and the line's number, a missing question or expectation is an error. Case files are small: the whole file is one row here."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("no", "line")).filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    parsed = lines.select("no", F.from_json("line", EVAL_CASE).alias("c"))
    wrong = F.raise_error(F.concat(F.lit("case without question or expectation in line "), (F.col("no") + 1).cast("string")))
    ok = F.col("c.question").isNotNull() & F.col("c.expected").isNotNull()
    return parsed.select(
        F.coalesce("c.id", F.concat(F.lit("line-"), (F.col("no") + 1).cast("string"))).alias("id"),
        F.when(ok, F.col("c.question")).otherwise(wrong.cast("string")).alias("question"), F.col("c.expected").alias("expected"),
    )
