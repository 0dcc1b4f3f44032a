"""Run bookkeeping: budgets, reuse of answers, region match, per-source statistics, funnel, latest run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import asset_name, normalise_literal
from factweave.operators.skew import keep_last


def within_budget(candidates: DataFrame, budget: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(best candidates up to the budget, the rest deferred to the next run)."""
    best = candidates.orderBy(F.desc("score"), F.asc("source_tier"), F.asc(key)).limit(budget)
    return best, candidates.join(best.select(key), key, "left_anti")


def reuse_answers(requests: DataFrame, answers: DataFrame, now: Column, ttl_seconds: int,
                  keys=("kind", "version", "model", "content_hash")) -> DataFrame:
    """Requests with a fresh stored `answer` where one exists, NULL where the work is still to be done."""
    fresh = answers.filter(F.timestamp_diff("SECOND", F.col("stored_at"), now) < ttl_seconds)
    newest = keep_last(fresh.select(*keys, "answer", "stored_at"), list(keys), "stored_at").drop("stored_at")
    return requests.join(newest, list(keys), "left")


def still_to_do(requests: DataFrame, answers: DataFrame, now: Column, ttl_seconds: int,
                keys=("kind", "version", "model", "content_hash")) -> DataFrame:
    fresh = answers.filter(F.timestamp_diff("SECOND", F.col("stored_at"), now) < ttl_seconds)
    return requests.join(fresh, list(keys), "left_anti")


def matches_region(country: Column, regions, custom_countries=()) -> Column:
    """Country and requested region contain one another after normalisation; worldwide always matches."""
    if "worldwide" in regions:
        return F.lit(True)
    wanted = [normalise_literal(v.replace("_", " ")) for v in (*regions, *custom_countries)]
    name = asset_name(country)
    tests = [F.contains(name, F.lit(w)) | F.contains(F.lit(w), name) for w in wanted]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def source_statistics(calls: DataFrame, provider: str = "provider") -> DataFrame:
    """Per source: queries executed, results, duration, errors, retries, healthy, last error message."""
    failed = F.col("error").isNotNull()
    return calls.groupBy(provider).agg(
        F.count_if(~failed).alias("queries_executed"),
        F.coalesce(F.sum(F.when(~failed, F.col("results"))), F.lit(0)).cast("bigint").alias("results_found"),
        F.coalesce(F.sum(F.when(~failed, F.col("duration_ms"))), F.lit(0)).cast("bigint").alias("duration_ms"),
        F.count_if(failed).alias("error_count"),
        F.coalesce(F.sum(F.when(~failed, F.col("retries"))), F.lit(0)).cast("bigint").alias("retry_count"),
        (F.count_if(failed) == 0).alias("healthy"),
        F.max_by("error", F.when(failed, F.col("call_id"))).alias("error_message"),
    )


def failures(calls: DataFrame, provider: str = "provider") -> DataFrame:
    """Failed calls per source with the last message, as one line each."""
    lost = calls.filter(F.col("error").isNotNull()).groupBy(provider).agg(
        F.count(F.lit(1)).alias("failed_queries"), F.max_by("error", "call_id").alias("last_error"))
    noun = F.when(F.col("failed_queries") == 1, F.lit(" query failed (")).otherwise(F.lit(" queries failed ("))
    return lost.withColumn("message", F.concat(F.col(provider), F.lit(": "), F.col("failed_queries").cast("string"), noun, F.col("last_error"), F.lit(")")))


def funnel(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts per run from stage-tagged rows (run, stage), in one pass."""
    c = F.col("stage")
    return stages.groupBy(run).agg(
        F.count_if(c != "error").alias("results_found"),
        F.count_if(c.isin("rejected", "rejected_late")).alias("rejected"),
        F.count_if(c == "duplicate").alias("duplicates"),
        F.count_if(c.isin("created", "updated", "rejected_late", "deferred")).alias("potential"),
        F.count_if(c == "created").alias("created"),
        F.count_if(c == "updated").alias("updated"),
        F.count_if(c == "deferred").alias("deferred"),
        F.when(F.count_if(c == "error") > 0, F.lit("partial")).otherwise(F.lit("completed")).alias("status"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run by start; a top-1, not a sort."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
