"""Command line: one query over Parquet tables in a folder."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from samplight.operators.samplers import METHODS
from samplight.plans import engine, scheduler
from samplight.plans.spec import QueryError, QuerySpec, parse


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="samplight", description=__doc__, allow_abbrev=False)
    p.add_argument("query", nargs="?")
    p.add_argument("--tables", "--db", help="folder of <table>.parquet")
    p.add_argument("-s", "--sample", "--s", type=int, help="percent of rows")
    p.add_argument("-e", "--error", "--e", type=float, help="wanted error in percent; picks the sampling percent")
    p.add_argument("--method", choices=sorted([*METHODS, *scheduler.CATALOGUE]))
    p.add_argument("--key", help="dense 0-based key column; without it rows are numbered")
    p.add_argument("--threads", type=int, default=4, help="tasks at a time on one machine, and shuffle partitions")
    p.add_argument("--confidence", type=float, default=0.95)
    p.add_argument("--ci", action="store_true", help="show the interval")
    p.add_argument("--compare", action="store_true", help="show the exact answer too, with error and speedup")
    p.add_argument("--explain", action="store_true", help="show the plan")
    p.add_argument("--methods", action="store_true", help="list the methods")
    return p


def query_type(spec: QuerySpec, sample: int | None, error: float | None, method: str | None) -> str:
    """How a query is answered: EXACT, EMBEDDED, CLT, BLOCK_SAMPLE or RANDOM_SAMPLE."""
    if error:
        return "CLT"
    if sample:
        return "BLOCK_SAMPLE" if method in ("block", "page", "parallel_block", "segments") else "RANDOM_SAMPLE"
    return "EMBEDDED" if spec.approximate else "EXACT"


def format_time(seconds: float) -> str:
    return f"{1000 * seconds:.0f} ms" if seconds < 1 else f"{seconds:.2f} s"


def method_table() -> str:
    lines = [f"{name:<12}{method:<20}{text}" for name, (method, text) in scheduler.CATALOGUE.items()]
    return "\n".join(["name        method              for", *lines])


def _answer(spark: SparkSession, a: argparse.Namespace, percent: int, method: str) -> DataFrame:
    run = engine.run_query_groupby_with_ci if parse(a.query).group_by else engine.run_query_with_ci
    return run(spark, a.query, percent, key=a.key, method=method, confidence=a.confidence)


def _register(spark: SparkSession, folder: str, spec: QuerySpec) -> None:
    """Views of the folder's tables that the query's text names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    text = f"{spec.table} {spec.where or ''}".lower()
    for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name = f.getPath().getName()
        if name.endswith(".parquet") and name[:-8].lower() in text:
            spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name[:-8])


def main(argv: list[str] | None = None) -> int:
    p = arguments()
    a = p.parse_args(argv)
    if a.methods:
        print(method_table())
        return 0
    if not a.query or not a.tables:
        p.error("a query and --tables are needed")
    try:
        spec = parse(a.query)
    except QueryError as e:
        p.error(str(e))
    spark = SparkSession.builder.config("spark.sql.shuffle.partitions", a.threads).getOrCreate()
    _register(spark, a.tables.rstrip("/"), spec)
    percent = scheduler.query_rate(a.query, a.sample, a.error)
    size = spark.table(spec.base).count() if percent and spec.base else 0
    asked = a.method or scheduler.auto_method(spec.agg, size, bool(spec.group_by))
    method = scheduler.CATALOGUE[asked][0] if asked in scheduler.CATALOGUE else asked
    runs = [(query_type(spec, a.sample, a.error, method) if percent else "EXACT", percent)] + ([("EXACT", 0)] if a.compare and percent else [])
    found = []
    for label, rate in runs:
        began = time.perf_counter()  # numbering rows and looking up sizes count too
        out = _answer(spark, a, rate, method)
        rows = out.collect()
        seconds = time.perf_counter() - began
        if a.explain:
            out.explain("formatted")
        found.append((sum(r["value"] or 0 for r in rows), seconds))
        shown = out.columns if a.ci else [c for c in out.columns if c not in ("ci_lower", "ci_upper", "n")]
        for r in rows:
            print(", ".join(f"{c} = {r[c]}" for c in shown))
        print(f"{label}: {rate or 100} % of rows, {method if rate else 'all'}, {format_time(seconds)}")
    if len(found) == 2:
        (value, seconds), (exact, exact_seconds) = found
        print(f"error {100 * abs(value - exact) / (abs(exact) or 1):.3f} %, speedup {exact_seconds / seconds:.2f}")
        if better := scheduler.recommend(method, spec.agg, size, bool(spec.group_by)):
            print(f"try --method {better}: {scheduler.CATALOGUE[better][1]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
