"""Sampled aggregates with a status, and the choice of method and rate.

execute() gives one row: value, status, confidence_level, error_margin and
samples_used, all from the estimate's own interval. timed() runs a query and
measures it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplight.functions.estimators import is_close, ladder_sql, percent_for_error
from samplight.plans import engine
from samplight.plans.spec import QuerySpec, parse

#: Samples of fewer rows say nothing about their margin.
LEAST_SAMPLES = 30
#: Relative margin up to which an answer is stable.
STABLE_MARGIN = 0.05

#: Methods by their name on the command line: sampling method, and what it is for.
CATALOGUE: dict[str, tuple[str, str]] = {
    "random": ("jittered", "hashed places, safe on periodic data"),
    "clt": ("sequential", "systematic with a random start, for error targets"),
    "block": ("block", "whole blocks, least I/O on clustered files"),
    "adaptive": ("balanced", "a quota of every leaf"),
    "parallel": ("parallel_pointer", "equal regions, for grouped queries"),
    "auto_large": ("segments", "ranges of the key, skips whole row groups"),
}
#: Table sizes above which a method is chosen, and the one below all of them.
BY_SIZE = ((50_000, "memory_stride"), (10_000, "direct_access"))
SMALL = "sequential"


@dataclass(frozen=True)
class ValidationResult:
    value: float | None
    status: str
    confidence_level: float
    error_margin: float | None
    samples_used: int
    computation_time: float


def auto_method(agg: str, size: int, grouped: bool) -> str:
    """A name of CATALOGUE by query and table size."""
    if grouped:
        return "parallel"
    if agg == "avg":
        return "random"
    if agg in ("sum", "count"):
        return "auto_large" if size > 100_000 else "clt"
    return "adaptive"


def method_by_size(size: int) -> str:
    """A sampling method by table size alone."""
    return next((m for n, m in BY_SIZE if size > n), SMALL)


def recommend(method: str, agg: str, size: int, grouped: bool) -> str | None:
    """Another name of CATALOGUE where it suits the query better."""
    better = auto_method(agg, size, grouped)
    return better if CATALOGUE[better][0] != method else None


def execute(table: DataFrame, spec: QuerySpec, percent: int = 10, key: str | None = None, method: str = engine.DEFAULT_METHOD, confidence: float = 0.95, **params) -> DataFrame:
    """value, status, confidence_level, error_margin (relative) and samples_used of a query without groups.

    An exact answer is STABLE at confidence 1 with margin 0. Else the confidence
    is the ladder's by the number of samples; the status is INSUFFICIENT_DATA
    below LEAST_SAMPLES, STABLE up to STABLE_MARGIN, DRIFTING beyond.
    """
    got = engine.estimate(table, spec, percent, key, method, confidence, **params)
    if not 0 < percent < 100:
        return got.select("value", F.lit("STABLE").alias("status"), F.lit(1.0).alias("confidence_level"), F.lit(0.0).alias("error_margin"), F.col("n").alias("samples_used"))
    margin = (F.col("ci_upper") - F.col("value")) / F.when(F.col("value") == 0, 1.0).otherwise(F.abs("value"))
    status = F.when(F.col("n") < LEAST_SAMPLES, "INSUFFICIENT_DATA").when(margin <= STABLE_MARGIN, "STABLE").otherwise("DRIFTING")
    return got.select("value", status.alias("status"), F.expr(ladder_sql("n")).alias("confidence_level"), margin.alias("error_margin"), F.col("n").alias("samples_used"))


def timed(table: DataFrame, spec: QuerySpec, percent: int = 10, **options) -> ValidationResult:
    """execute() run and measured; an error is a result with status ERROR."""
    began = time.perf_counter()
    try:
        r = execute(table, spec, percent, **options).first()
    except Exception:
        return ValidationResult(None, "ERROR", 0.0, None, 0, time.perf_counter() - began)
    return ValidationResult(r["value"], r["status"], r["confidence_level"], r["error_margin"], r["samples_used"], time.perf_counter() - began)


class Scheduler:
    """The aggregates of one table's column, exact or sampled."""

    def __init__(self, table: DataFrame, column: str, key: str | None = None):
        self.table, self.column, self.key = table, column, key

    def _run(self, agg: str, percent: int, where: str | None) -> ValidationResult:
        return timed(self.table, QuerySpec(agg, self.column, "table", where), percent, key=self.key)

    def execute_sum_query(self, percent: int = 10, where: str | None = None) -> ValidationResult:
        return self._run("sum", percent, where)

    def execute_avg_query(self, percent: int = 10, where: str | None = None) -> ValidationResult:
        return self._run("avg", percent, where)

    def execute_count_query(self, percent: int = 10, where: str | None = None) -> ValidationResult:
        return self._run("count", percent, where)

    def execute_exact_sum(self, where: str | None = None) -> ValidationResult:
        return self._run("sum", 0, where)

    def execute_exact_avg(self, where: str | None = None) -> ValidationResult:
        return self._run("avg", 0, where)

    def execute_exact_count(self, where: str | None = None) -> ValidationResult:
        return self._run("count", 0, where)

    def search_range(self, low: int, high: int) -> DataFrame:
        """The rows whose key is from low to high."""
        return self.table.filter(F.col(self.key).between(low, high))

    def benchmark_query(self, agg: str = "SUM", percent: int = 10) -> dict[str, float]:
        """Exact against sampled: values, seconds, speedup and accuracy in percent; unknown names count as SUM."""
        name = agg.lower() if agg.lower() in ("sum", "avg", "count") else "sum"
        exact, approx = self._run(name, 0, None), self._run(name, percent, None)
        error = abs(approx.value - exact.value) / (abs(exact.value) or 1) if exact.value is not None and approx.value is not None else float("nan")
        return {
            "exact_value": exact.value, "approx_value": approx.value, "exact_seconds": exact.computation_time, "approx_seconds": approx.computation_time,
            "speedup": exact.computation_time / approx.computation_time, "error_percent": 100 * error, "accuracy_percent": 100 * (1 - error), "samples_used": approx.samples_used,
        }


def query_rate(sql: str, sample: int | None = None, error: float | None = None) -> int:
    """The sampling percent of a query: asked for, or by wanted error, or the query's own."""
    return sample if sample is not None else percent_for_error(error) if error else engine.chosen_percent(parse(sql), None)


def run_timed_query(spark: SparkSession, sql: str, percent: int | None = None, **options) -> tuple[list, float]:
    """(rows, seconds) of a query."""
    began = time.perf_counter()
    run = engine.run_query_groupby_with_ci if parse(sql).group_by else engine.run_query_with_ci
    return run(spark, sql, percent, **options).collect(), time.perf_counter() - began


def benchmark_query(spark: SparkSession, sql: str, rates: tuple[int, ...] = (0, 1, 5, 10, 20, 50), runs: int = 3, **options) -> DataFrame:
    """sample_rate, avg_result, avg_time, min_time, max_time, error and speedup against the exact answer, a row a rate."""
    rows, exact, exact_time = [], None, None
    for rate in (0, *[r for r in rates if r]):
        results, times = [], []
        for _ in range(runs):
            got, seconds = run_timed_query(spark, sql, rate, **options)
            results.append(sum(r["value"] or 0.0 for r in got))
            times.append(seconds)
        value, mean = sum(results) / runs, sum(times) / runs
        if exact is None:
            exact, exact_time = value, mean
        if rate in rates:
            error = 0.0 if exact == value else abs(value - exact) / (abs(exact) or 1)
            rows.append((rate, value, mean, min(times), max(times), error, exact_time / mean))
    return spark.createDataFrame(rows, "sample_rate int, avg_result double, avg_time double, min_time double, max_time double, error double, speedup double")


def error_sweep(spark: SparkSession, sql: str, errors: tuple[float, ...] = (0.1, 1.0, 2.0, 5.0), **options) -> DataFrame:
    """For each wanted error in percent: the rate, whether it was met, and the time against the exact answer's."""
    rows = []
    got, exact_time = run_timed_query(spark, sql, 0, **options)
    exact = got[0]["value"]
    for e in errors:
        rate = percent_for_error(e)
        got, seconds = run_timed_query(spark, sql, rate, **options)
        error = 0.0 if exact == got[0]["value"] else 100 * abs(got[0]["value"] - exact) / (abs(exact) or 1)
        rows.append((e, rate, got[0]["n"], error, is_close(got[0]["value"], exact, e / 100), seconds, exact_time / seconds))
    return spark.createDataFrame(rows, "error_threshold double, sample_percent int, samples_used long, error_percent double, met boolean, seconds double, speedup double")


def adaptive_against_traditional(spark: SparkSession, sql: str, rates: tuple[int, ...] = (5, 10, 20), wanted: float = 0.05, **options) -> DataFrame:
    """Fixed rates, then one that is raised until the relative margin is within wanted: method, percent, value, margin, seconds."""
    rows, spec = [], parse(sql)
    table = spark.table(spec.table)
    for rate in rates:
        r = timed(table, spec, rate, **options)
        rows.append((f"fixed_{rate}", rate, r.value, r.error_margin, r.status, r.computation_time))
    seconds = 0.0
    for rate in (1, 5, 10, 20, 40, 80, 100):
        r = timed(table, spec, rate, **options)
        seconds += r.computation_time
        if r.error_margin is not None and r.error_margin <= wanted and r.status == "STABLE":
            break
    rows.append(("adaptive", rate, r.value, r.error_margin, r.status, seconds))
    return spark.createDataFrame(rows, "method string, percent int, value double, error_margin double, status string, seconds double")


def save_csv(results: DataFrame, path: str) -> None:
    """One CSV file with a header, in the folder path."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_json(results: DataFrame, path: str) -> None:
    """Add the results to the folder path as one more file of JSON lines, with the time."""
    results.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def latest_json(spark: SparkSession, path: str) -> DataFrame:
    """The results that were saved last in the folder path."""
    rows = spark.read.json(path)
    return rows.join(F.broadcast(rows.agg(F.max("timestamp").alias("timestamp"))), "timestamp")  # one row
