"""Retrieval quality: first matching rank, hit rate, mean reciprocal rank, latency, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "source_path", "item_path", "text", "url", "crate")


def matches(expected: Column, hit: Column) -> Column:
    """Whether any criterion holds for a hit (a map of strings). All keys of a criterion must hold: ``x_contains`` finds its value in field x without regard to case (a null field reads ``none``, a missing one is empty), any other key means equality."""

    def holds(entry: Column) -> Column:
        name = F.regexp_replace(entry["key"], r"_contains\z", "")
        found = F.element_at(hit, name)
        contains = F.contains(F.lower(F.when(F.array_contains(F.map_keys(hit), name), F.coalesce(found, F.lit("none"))).otherwise(F.lit(""))), F.lower(entry["value"]))
        return F.when(F.endswith(entry["key"], F.lit("_contains")), contains).otherwise(F.element_at(hit, entry["key"]).eqNullSafe(entry["value"]))

    return F.exists(expected, lambda m: F.forall(F.map_entries(m), holds))


def first_ranks(cases: DataFrame, hits: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(case_id, rank, top_score, top_title, top_source_path): the first rank at which a hit matches, null if none does.

    ``cases`` (id, expected), ``hits`` (case_id, rank, score and fields). A case without hits is a miss."""
    have = [f for f in fields if f in hits.columns]
    hit = F.create_map(*[x for f in have for x in (F.lit(f), F.col(f"h.`{f}`").cast("string"))])
    joined = cases.select(F.col("id").alias("case_id"), "expected").alias("c").join(hits.alias("h"), F.col("c.case_id") == F.col("h.case_id"), "left")
    top = lambda f: F.min_by(F.col(f"h.{f}"), F.col("h.rank"))
    extra = [top(f).alias(f"top_{f}") for f in ("score", "title", "source_path") if f in hits.columns]
    return joined.groupBy("c.case_id").agg(F.min(F.when(matches(F.col("c.expected"), hit), F.col("h.rank"))).alias("rank"), *extra)


def summary(results: DataFrame, keys: list[str] | None = None, elapsed: str | None = None) -> DataFrame:
    """total, matched, hit_rate, mrr (a miss counts 0) and, if ``elapsed`` is named, the mean latency. No results give one row of zeros (no rows with keys)."""
    n = F.count(F.lit(1))
    share = lambda x: F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0))
    out = [n.alias("total"), F.count("rank").alias("matched"), share(F.count("rank")).alias("hit_rate"), share(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0))).alias("mrr")]
    if elapsed:
        out.append(F.avg(elapsed).alias("average_latency_ms"))
    return (results.groupBy(*keys) if keys else results.groupBy()).agg(*out)


def weak_cases(results: DataFrame) -> DataFrame:
    """Cases that are missed or not first."""
    return results.filter(F.col("rank").isNull() | (F.col("rank") != 1))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(case_id, rank_a, rank_b, change) of cases in both runs: improved, regressed or same; a miss is worse than any rank."""
    worst = F.lit(2**31 - 1)
    ra, rb = F.coalesce("rank_a", worst), F.coalesce("rank_b", worst)
    both = a.select("case_id", F.col("rank").alias("rank_a")).join(b.select("case_id", F.col("rank").alias("rank_b")), "case_id")
    return both.withColumn("change", F.when(rb < ra, "improved").when(rb > ra, "regressed").otherwise("same"))


def deltas(a: DataFrame, b: DataFrame, elapsed: str | None = None) -> DataFrame:
    """One row for two runs of unique cases: how much ``b`` is over ``a`` in hit rate, mean reciprocal rank and, if ``elapsed`` is named, mean latency, and how many cases of both improved, regressed or stayed."""
    def side(run: DataFrame, s: str) -> DataFrame:
        return run.select("case_id", F.lit(1).alias(f"in_{s}"), F.col("rank").alias(f"rank_{s}"), *([F.col(elapsed).alias(f"ms_{s}")] if elapsed else []))

    both = side(a, "a").join(side(b, "b"), "case_id", "full")
    worst = F.lit(2**31 - 1)
    ra, rb = F.coalesce("rank_a", worst), F.coalesce("rank_b", worst)
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def share(s: str, value: Column) -> Column:
        return F.coalesce(F.sum(value) / F.nullif(F.count(f"in_{s}"), F.lit(0)), F.lit(0.0))

    out = [
        (share("b", F.col("rank_b").isNotNull().cast("int")) - share("a", F.col("rank_a").isNotNull().cast("int"))).alias("hit_rate_delta"),
        (share("b", 1 / F.col("rank_b")) - share("a", 1 / F.col("rank_a"))).alias("mrr_delta"),
        *([(F.avg("ms_b") - F.avg("ms_a")).alias("average_latency_ms_delta")] if elapsed else []),
        *[F.count(F.when(shared & on, 1)).alias(name) for name, on in (("improved", rb < ra), ("regressed", rb > ra), ("same", rb == ra))],
    ]
    return both.agg(*out)


def with_errors(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Results (case_id, rank) with ``error`` from ``errors`` (case_id, error): a case that failed has no rank, whatever hits it got, and so counts as a miss. The first error in order counts."""
    first = errors.groupBy("case_id").agg(F.min("error").alias("error"))
    joined = results.join(first, "case_id", "left")
    return joined.withColumn("rank", F.when(F.col("error").isNull(), F.col("rank")))


def passes(results: DataFrame, least: float = 0.8) -> bool:
    """Whether the hit rate reaches the gate; no results fail it unless it is 0."""
    return summary(results).first()["hit_rate"] >= least
