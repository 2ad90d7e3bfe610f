"""The registered queries and their SQL.

The SQL is written by hand from what a method is meant to take, not made from
the predicates that Spark runs: steps are told by counting (how many rows are
due up to this one, and up to the next), regions and passes by row numbers,
margins by the variance of zero-filled values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplight.operators import samplers
from samplight.plans import engine, scheduler, validation
from samplight.plans.spec import parse
from samplight.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "events": "event_id"}
DIGITS = 2
RATES = (10, 60)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _positioned(spark: SparkSession, sf_dir: str, name: str = "orders") -> DataFrame:
    return samplers.with_position(_table(spark, sf_dir, name), KEYS[name], dense=True)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


# --- samples -----------------------------------------------------------------

_T = "t AS (SELECT *, {key} AS pos, count(*) OVER () AS n FROM {table})"


def _due(x: str, rate: str = "{p}", of: str = "100", before: str = "0") -> str:
    """One more row is due at number x than before it."""
    return f"(({x} + 1) * {rate} + {before}) // {of} > (({x}) * {rate} + {before}) // {of}"


def _hash(x: str, source: str = "t") -> str:
    """Tables h0, h1 and h, with the hash of x in the column h."""
    return f"""h0 AS (SELECT *, ({x}) % 4294967296 AS a FROM {source}), h1 AS (SELECT *, (xor(a, a // 65536) * 1597334677) % 4294967296 AS b FROM h0),
    h AS (SELECT *, (xor(b, b // 65536) * 1103515245) % 4294967296 AS h FROM h1)"""


_SEED_HASH = _hash("42", "(SELECT 1 AS one)").replace("h0", "s0").replace("h1", "s1").replace("h AS (SELECT *", "s AS (SELECT *")
_BLOCKS = "b AS (SELECT *, pos // greatest(1, least({block}, n // 100)) AS b, (n + greatest(1, least({block}, n // 100)) - 1) // greatest(1, least({block}, n // 100)) AS blocks FROM t)"

#: What comes after the table t (with pos and n), to the sampled rows.
SAMPLES: dict[str, str] = {
    "index": "SELECT * FROM t WHERE pos IN (SELECT pos * n // greatest(1, n * {p} // 100) FROM t WHERE pos < n * {p} // 100)",
    "slow_pointer": f"SELECT * FROM t WHERE {_due('pos')}",
    "fast_pointer": f"SELECT * FROM t WHERE {_due('pos // 2')}",
    "stride_bytes": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos // 10 ORDER BY pos) AS r, pos // 10 AS w FROM t) WHERE r <= (w + 1) * 10 * {p} // 100 - w * 10 * {p} // 100",
    "random_start_stride": f"{_SEED_HASH} SELECT * FROM t, s WHERE {_due('pos', before='h % 100')}",
    "sequential": f"{_SEED_HASH} SELECT * FROM t, s WHERE {_due('pos', '10 * {p}', '1000', '999 - h % 999')}",
    "parallel_pointer": f"r AS (SELECT *, row_number() OVER (PARTITION BY pos * 4 // n ORDER BY pos) - 1 AS i FROM t) SELECT * FROM r WHERE {_due('i')}",
    "region_stride": f"r AS (SELECT *, pos * 8 // n AS region, row_number() OVER (PARTITION BY pos * 8 // n ORDER BY pos) - 1 AS i FROM t), {_hash('region + 42 * 8', 'r')} SELECT * FROM h WHERE {_due('i', before='h // 1024 % 100')}",
    "block": f"{_BLOCKS.replace('{block}', '1000')} SELECT * FROM b WHERE {_due('b')}",
    "page": f"{_BLOCKS.replace('{block}', '128')} SELECT * FROM b WHERE {_due('b', before='25')}",
    "node_skip": f"{_BLOCKS.replace('{block}', '127')} SELECT * FROM b WHERE {_due('b', before='50')}",
    "parallel_block": f"{_BLOCKS.replace('{block}', '1000')}, r AS (SELECT *, b * 4 // blocks AS region, dense_rank() OVER (PARTITION BY b * 4 // blocks ORDER BY b) - 1 AS i FROM b) SELECT * FROM r WHERE {_due('i', before='region * 25')}",
    "balanced": "q AS (SELECT *, pos % 127 AS i, (pos // 127 + 1) * 127 * {p} // 100 - pos // 127 * 127 * {p} // 100 AS q FROM t) SELECT * FROM q WHERE ((i + 1) * q + 126) // 127 > (i * q + 126) // 127",
    "direct_access": f"""{_BLOCKS.replace("{block}", "127")}, f AS (SELECT CAST(ceil(sqrt(100.0 * {{p}})) AS BIGINT) AS f),
    l AS (SELECT * FROM b, f WHERE {_due("b", "f")}), i AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM l) SELECT * FROM i WHERE {_due("i", "{p}", "f")}""",
    "nth_wrap": f"{_SEED_HASH}, w AS (SELECT *, row_number() OVER (ORDER BY (pos + n - h % n) % n) - 1 AS i FROM t, s) SELECT * FROM w WHERE {_due('i')}",
    "jittered": f"{_hash('pos // 100 + 42')} SELECT * FROM h WHERE {_due('pos', before='h // 1024 % 100')}",
    "segments": f"SELECT * FROM t WHERE {_due('(pos * 200 // n)')}",
    "head": "SELECT * FROM t WHERE pos < n * {p} // 100",
    "dual_pointer": f"""f AS (SELECT *, {_due("pos", "{p}", "300")} AS fast FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY fast ORDER BY pos) - 1 AS i FROM f)
    SELECT * FROM r WHERE fast OR {_due("i", "2 * {p}", "(300 - {p})")}""",
    "random_hash": f"{_SEED_HASH}, x AS (SELECT t.*, s.h AS seed FROM t, s), {_hash('pos + seed', 'x')}, k AS (SELECT *, row_number() OVER (ORDER BY h, pos) AS k FROM h) SELECT * FROM k WHERE k <= n * {{p}} // 100",
    "stratified_block": """r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, pos) - 1 AS r FROM t),
    x AS (SELECT *, CASE WHEN r >= n * 3 // 4 THEN 3 WHEN r >= n * 2 // 4 THEN 2 WHEN r >= n // 4 THEN 1 ELSE 0 END AS stratum FROM r),
    c AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS size FROM x),
    o AS (SELECT stratum, row_number() OVER (ORDER BY count(*), stratum) - 1 AS place FROM x GROUP BY stratum),
    q AS (SELECT c.*, (n * {p} // 100) // 4 + CASE WHEN place >= 4 - (n * {p} // 100) % 4 THEN 1 ELSE 0 END AS quota FROM c JOIN o USING (stratum))
    SELECT * FROM q WHERE ((i + 1) * quota + size - 1) // size > (i * quota + size - 1) // size""",
}
for _same, _as in (("byte_offset", "index"), ("memory_stride", "slow_pointer"), ("address_arithmetic", "slow_pointer")):
    SAMPLES[_same] = SAMPLES[_as]


def _take(method: str, percent: int, table: str = "orders") -> str:
    """WITH text that ends in the table p of sampled rows."""
    *before, last = SAMPLES[method].replace("{p}", str(percent)).rpartition("SELECT * FROM")
    head = before[0].strip().rstrip(",")
    return f"WITH {_T.format(key=KEYS[table], table=table)}{', ' + head if head else ''}, p AS (SELECT * FROM{last})"


def _sampled(method: str, percent: int) -> None:
    columns = ["o_orderkey", "o_totalprice", *(["stratum"] if method == "stratified_block" else [])]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _positioned(spark, sf_dir)
        if method == "random_hash":
            return samplers.random_sample(rows, percent).select(*columns)
        if method == "stratified_block":
            return samplers.stratified_sample(rows, "o_totalprice", percent).select(*columns)
        return samplers.sample(rows, method, percent).select(*columns)

    _add(f"s_{method}" + ("" if percent == RATES[0] else f"_{percent}"), run, f"{_take(method, percent)} SELECT {', '.join(columns)} FROM p")


for _method in SAMPLES:
    for _percent in RATES:
        _sampled(_method, _percent)

# --- aggregates ----------------------------------------------------------------


def _exact_sql(table: str, agg: str, x: str, where: str = "true", keys: str = "") -> str:
    lead, grouped = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    value = f"round(CAST({agg}({x}) AS DOUBLE), 2)"
    return f"SELECT {lead}{value} AS value, {value} AS ci_lower, {value} AS ci_upper, count({x}) AS n FROM {table} WHERE {where} {grouped}"


def _estimate_sql(table: str, agg: str, x: str, percent: int, method: str, where: str = "true", keys: str = "") -> str:
    """Sums and counts: size times the mean of the values with zeros outside the part; their variance gives the margin."""
    lead = f"{keys}, " if keys else ""
    head = f"{_take(method, percent, table)}, c AS (SELECT (SELECT count(*) FROM p) AS m, (SELECT count(*) FROM t) AS big)"
    head += f", g AS (SELECT {lead}count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS sd, sum({x}) AS s, sum(CAST({x} AS DOUBLE) * {x}) AS ss FROM p WHERE {where} {f'GROUP BY {keys}' if keys else ''})"
    if agg == "avg":
        value, margin = "mean", "1.96 * sd / sqrt(n)"
    else:
        s, ss = ("s", "ss") if agg == "sum" else ("n", "n")
        value = f"{s} / CAST(m AS DOUBLE) * big"
        margin = f"1.96 * big * sqrt((1 - CAST(m AS DOUBLE) / big) * (({ss} / CAST(m AS DOUBLE)) - ({s} / CAST(m AS DOUBLE)) ** 2) * m / (m - 1) / m)"
    head += f", v AS (SELECT g.*, CASE WHEN n > 0 THEN {value} END AS value, CASE WHEN n > 1 THEN {margin} ELSE 0 END AS margin FROM g, c)"
    shown = "round(value, 2) AS value, round(value - margin, 2) AS ci_lower, round(value + margin, 2) AS ci_upper"
    if keys:
        match = " AND ".join(f"d.{k} IS NOT DISTINCT FROM v.{k}" for k in keys.split(", "))
        lead = "".join(f"d.{k}, " for k in keys.split(", "))
        return f"{head} SELECT {lead}{shown}, coalesce(n, 0) AS n FROM (SELECT DISTINCT {keys} FROM t WHERE {where}) d LEFT JOIN v ON {match}"
    return f"{head} SELECT {shown}, n FROM v"


def _estimate(query: str, sql: str, oracle: str, percent: int = 0, method: str = engine.DEFAULT_METHOD) -> None:
    spec = parse(sql)
    chosen = percent or engine.chosen_percent(spec, None)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(engine.estimate(_table(spark, sf_dir, spec.table), spec, chosen, KEYS.get(spec.table), method))

    _add(query, run, oracle)


for _agg in ("sum", "avg", "count"):
    _estimate(f"exact_{_agg}", f"SELECT {_agg}(o_totalprice) FROM orders", _exact_sql("orders", _agg, "o_totalprice"))
    _estimate(f"exact_groupby_{_agg}", f"SELECT {_agg}(l_extendedprice) FROM lineitem GROUP BY l_returnflag, l_linestatus", _exact_sql("lineitem", _agg, "l_extendedprice", keys="l_returnflag, l_linestatus"))
    for _percent in (10, 15, 20):
        _estimate(f"approx_{_agg}_{_percent}", f"SELECT {_agg}(o_totalprice) FROM orders", _estimate_sql("orders", _agg, "o_totalprice", _percent, "jittered"), _percent)
    _estimate(f"approx_{_agg}_ci", f"SELECT {_agg}(value) FROM events", _estimate_sql("events", _agg, "value", 10, "sequential"), 10, "sequential")
    _estimate(f"approx_groupby_{_agg}_ci", f"SELECT {_agg}(o_totalprice) FROM orders GROUP BY o_orderstatus", _estimate_sql("orders", _agg, "o_totalprice", 10, "jittered", keys="o_orderstatus"), 10)
    _estimate(
        f"sched_{_agg}_where",
        f"SELECT {_agg}(o_totalprice) FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000",
        _estimate_sql("orders", _agg, "o_totalprice", 10, "parallel_pointer", "o_totalprice BETWEEN 1000 AND 200000"),
        10,
        "parallel_pointer",
    )
_estimate("exact_sum_range", "SELECT SUM(o_totalprice) FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 90000", _exact_sql("orders", "sum", "o_totalprice", "o_totalprice BETWEEN 1000 AND 90000"))
_estimate(
    "approx_where_or",
    "SELECT SUM(o_totalprice) FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000",
    _estimate_sql("orders", "sum", "o_totalprice", 10, "jittered", "(o_orderstatus = 'F' OR o_totalprice > 300000)"),
    10,
)
_estimate("groupby_missing_groups", "SELECT SUM(value) FROM events GROUP BY user_id", _estimate_sql("events", "sum", "value", 1, "jittered", keys="user_id"), 1)
_estimate("approx_fn_syntax", "SELECT APPROX_SUM(o_totalprice, 15) FROM orders", _estimate_sql("orders", "sum", "o_totalprice", 15, "jittered"))
_estimate("approx_wrap_syntax", "SELECT APPROX(SUM(o_totalprice)) FROM orders", _estimate_sql("orders", "sum", "o_totalprice", 10, "jittered"))
_estimate("agg_stride_sum", "SELECT SUM(o_totalprice) FROM orders", _estimate_sql("orders", "sum", "o_totalprice", 10, "slow_pointer"), 10, "memory_stride")
_estimate("approx_segments_sum", "SELECT SUM(o_totalprice) FROM orders", f"""{_take("segments", 10)}, u AS (SELECT pos * 200 // n AS u, sum(o_totalprice) AS t FROM p GROUP BY 1),
    v AS (SELECT (SELECT sum(t) FROM u) * (SELECT count(*) FROM t) / (SELECT count(*) FROM p) AS value, 1.96 * 200 * sqrt(var_samp(t) / count(*) * (1 - count(*) / 200.0)) AS margin FROM u)
    SELECT round(value, 2) AS value, round(value - margin, 2) AS ci_lower, round(value + margin, 2) AS ci_upper, (SELECT count(o_totalprice) FROM p) AS n FROM v""", 10, "segments")  # fmt: skip
_estimate("expression_aggregate", "SELECT SUM(abs(o_totalprice - 1000)) FROM orders WHERE o_orderstatus IN ('F', 'O')", f"""{_take("block", 20)},
    u AS (SELECT b, max(blocks) AS blocks, coalesce(sum(abs(o_totalprice - 1000)) FILTER (o_orderstatus IN ('F', 'O')), 0) AS t FROM p GROUP BY b),
    v AS (SELECT (SELECT sum(t) FROM u) * (SELECT count(*) FROM t) / (SELECT count(*) FROM p) AS value, 1.96 * max(blocks) * sqrt(var_samp(t) / count(*) * (1 - CAST(count(*) AS DOUBLE) / max(blocks))) AS margin FROM u)
    SELECT round(value, 2) AS value, round(value - margin, 2) AS ci_lower, round(value + margin, 2) AS ci_upper, (SELECT count(*) FROM p WHERE o_orderstatus IN ('F', 'O')) AS n FROM v""", 20, "block")  # fmt: skip


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        _table(spark, sf_dir, name).createOrReplaceTempView(name)


def _query(name: str, sql: str, oracle: str, percent: int = 0, **options) -> None:
    """A query by its text over views of the tables that it names."""
    spec = parse(sql)
    used = [t for t in ("orders", "customer", "lineitem", "events", "nation") if re.search(rf"\b{t}\b", spec.table)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, *used)
        answer = engine.run_query_groupby_with_ci if spec.group_by else engine.run_query_with_ci
        return _rounded(answer(spark, sql, percent, **options).select(*[f"`{engine._name(k)}`" for k in spec.group_by], "value"))

    _add(name, run, oracle)


_query("exact_count_distinct", "SELECT COUNT(DISTINCT o_custkey) FROM orders", "SELECT count(DISTINCT o_custkey) AS value FROM orders")
_query("exact_min", "SELECT MIN(o_totalprice) FROM orders WHERE o_orderstatus = 'F'", "SELECT round(min(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")
_query("exact_max_by_group", "SELECT MAX(o_totalprice) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(max(o_totalprice), 2) AS value FROM orders GROUP BY o_orderstatus")
_query(
    "exact_join",
    "SELECT SUM(o_totalprice * 2) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
    "SELECT round(sum(o_totalprice * 2), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
)
_query(
    "exact_join_tail",
    "SELECT COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING COUNT(*) > 10 ORDER BY c_nationkey LIMIT 5",
    "SELECT c_nationkey, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(*) > 10 ORDER BY c_nationkey LIMIT 5",
)
_query("exact_subquery", "SELECT AVG(v) FROM (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey) x", "SELECT round(avg(v), 2) AS value FROM (SELECT sum(o_totalprice) AS v FROM orders GROUP BY o_custkey)")
_query("exact_group_by_expression", "SELECT SUM(o_totalprice) FROM orders GROUP BY year(o_orderdate)", 'SELECT CAST(year(o_orderdate) AS INTEGER) AS "year(o_orderdate)", round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1')
_query(
    "approx_join",
    "SELECT SUM(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
    f"{_take('jittered', 20)} SELECT round(sum(o_totalprice) * (SELECT count(*) FROM t) / (SELECT count(*) FROM p), 2) AS value FROM p JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
    20,
    key="o_orderkey",
)
_add(
    "table_helpers",
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").filter("o_totalprice < 0").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.coalesce(F.avg("o_totalprice"), F.lit(0.0)).alias("mean"), F.count("o_totalprice").alias("n")),
    "SELECT CAST(coalesce(sum(o_totalprice), 0) AS DOUBLE) AS total, CAST(coalesce(avg(o_totalprice), 0) AS DOUBLE) AS mean, count(o_totalprice) AS n FROM orders WHERE o_totalprice < 0",
)

# --- scheduler -----------------------------------------------------------------


def _scheduled(agg: str, percent: int) -> None:
    spec = parse(f"SELECT {agg}(o_totalprice) FROM orders")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scheduler.execute(_table(spark, sf_dir, "orders"), spec, percent, KEYS["orders"])
        return out.withColumn("value", F.round("value", DIGITS)).withColumn("error_margin", F.round("error_margin", 6))

    inner = _estimate_sql("orders", agg, "o_totalprice", percent, "jittered").replace("round(value, 2) AS value, round(value - margin, 2) AS ci_lower, round(value + margin, 2) AS ci_upper", "value, margin")
    _add(f"sched_{agg}", run, f"""SELECT round(value, 2) AS value, CASE WHEN n < 30 THEN 'INSUFFICIENT_DATA' WHEN margin / abs(value) <= 0.05 THEN 'STABLE' ELSE 'DRIFTING' END AS status,
        CASE WHEN n >= 1000 THEN 0.95 WHEN n >= 500 THEN 0.9 WHEN n >= 100 THEN 0.85 WHEN n >= 50 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence_level,
        round(margin / abs(value), 6) AS error_margin, n AS samples_used FROM ({inner})""")  # fmt: skip
    _add(
        f"sched_exact_{agg}",
        lambda spark, sf_dir: scheduler.execute(_table(spark, sf_dir, "orders"), spec, 0).withColumn("value", F.round("value", DIGITS)),
        f"SELECT round(CAST({agg}(o_totalprice) AS DOUBLE), 2) AS value, 'STABLE' AS status, 1.0::DOUBLE AS confidence_level, 0.0::DOUBLE AS error_margin, count(o_totalprice) AS samples_used FROM orders",
    )


for _agg in ("sum", "avg", "count"):
    _scheduled(_agg, 10)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact against sampled, without the times."""
    orders = _positioned(spark, sf_dir)
    x, chosen = F.col("o_totalprice"), F.expr(samplers.predicate("slow_pointer", None, 10))
    out = orders.agg(F.sum(x).alias("exact"), (F.sum(F.when(chosen, x)) * F.count(F.lit(1)) / F.count(F.when(chosen, 1))).alias("approx"), F.count(F.when(chosen, x)).alias("samples_used"))
    out = out.withColumn("accuracy_percent", 100 * (1 - F.abs(F.col("approx") - F.col("exact")) / F.abs("exact")))
    return _rounded(out)


_add(
    "sched_benchmark",
    _benchmark,
    f"""{_take("slow_pointer", 10)}, a AS (SELECT (SELECT sum(o_totalprice) FROM orders) AS exact, sum(o_totalprice) * max(n) / count(*) AS approx, count(*) AS samples_used FROM p)
    SELECT round(exact, 2) AS exact, round(approx, 2) AS approx, samples_used, round(100 * (1 - abs(approx - exact) / abs(exact)), 2) AS accuracy_percent FROM a""",
)


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method and rate for each aggregate, by the table's size."""
    size = _table(spark, sf_dir, "orders").count()
    rows = [(agg, grouped, scheduler.CATALOGUE[scheduler.auto_method(agg, size, grouped)][0], scheduler.method_by_size(size)) for agg in ("sum", "avg", "count") for grouped in (False, True)]
    return spark.createDataFrame(rows, "agg string, grouped boolean, method string, by_size string")


_add(
    "method_choice",
    _choices,
    """SELECT agg, grouped, CASE WHEN grouped THEN 'parallel_pointer' WHEN agg = 'avg' THEN 'jittered' WHEN n > 100000 THEN 'segments' ELSE 'sequential' END AS method,
    CASE WHEN n > 50000 THEN 'memory_stride' WHEN n > 10000 THEN 'direct_access' ELSE 'sequential' END AS by_size
    FROM (VALUES ('sum'), ('avg'), ('count')) a(agg), (VALUES (false), (true)) g(grouped), (SELECT count(*) AS n FROM orders)""",
)

# --- samples with parameters from the data --------------------------------------

_add(
    "s_adaptive_block",
    lambda spark, sf_dir: samplers.adaptive_block_sample(_positioned(spark, sf_dir), "o_totalprice", 10).select("o_orderkey", "o_totalprice"),
    f"""WITH {_T.format(key="o_orderkey", table="orders")}, z AS (SELECT *, least(pos // greatest(1, n // 10), 9) AS zone FROM t),
    b AS (SELECT zone, var_pop(o_totalprice) AS v FROM z GROUP BY zone),
    w AS (SELECT zone, CASE WHEN max(v) OVER () > 0 THEN 500 + CAST(floor(1500 * (1 - v / max(v) OVER ())) AS BIGINT) ELSE 500 END AS width FROM b)
    SELECT o_orderkey, o_totalprice FROM z JOIN w USING (zone) WHERE (pos - zone * greatest(1, n // 10)) % width < greatest(1, width * 10 // 100)""",
)
_add(
    "gather_by_index",
    lambda spark, sf_dir: samplers.gather(_positioned(spark, sf_dir), [0, 7, 7, 99, 1200]).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (0, 7, 99, 1200)",
)

# --- convergence -----------------------------------------------------------------

_add(
    "slices_fast",
    lambda spark, sf_dir: _rounded(validation.slice_estimates(_positioned(spark, sf_dir), "o_totalprice", 50)),
    "SELECT o_orderkey % 50 AS slice, count(o_totalprice) AS n, round(sum(o_totalprice) * 50, 2) AS estimate FROM orders GROUP BY 1",
)
_add(
    "slices_slow",
    lambda spark, sf_dir: _rounded(validation.combine(validation.slice_estimates(_positioned(spark, sf_dir), "o_totalprice", 50, "avg").filter("slice >= 40"), "avg")),
    "SELECT round(avg(o_totalprice), 2) AS value, count(o_totalprice) AS n FROM orders WHERE o_orderkey % 50 >= 40",
)
_add(
    "cv_confidence",
    lambda spark, sf_dir: validation.slice_estimates(_positioned(spark, sf_dir), "o_totalprice", 50).agg(F.round(validation.confidence_of(), 6).alias("confidence_level")),
    "SELECT round(greatest(0, least(1, 1 - stddev_samp(e) / abs(avg(e)))), 6) AS confidence_level FROM (SELECT sum(o_totalprice) * 50 AS e FROM orders GROUP BY o_orderkey % 50)",
)
_SLICES = "s AS (SELECT o_orderkey % 50 AS slice, sum(o_totalprice) * 50 AS estimate FROM orders GROUP BY 1)"
_add(
    "adaptive_verdict",
    lambda spark, sf_dir: _rounded(validation.verdict(validation.slice_estimates(_positioned(spark, sf_dir), "o_totalprice", 50), 40)),
    f"""WITH {_SLICES}, a AS (SELECT avg(estimate) FILTER (slice < 40) AS value, avg(estimate) FILTER (slice >= 40) AS slow,
    stddev_samp(estimate) FILTER (slice >= 40) AS sd FROM s), c AS (SELECT *, greatest(0, least(1, 1 - sd / abs(slow))) AS l FROM a)
    SELECT round(value, 2) AS value, round(l, 2) AS confidence_level,
    CASE WHEN abs(value - slow) / abs(value) <= 0.05 AND l >= 0.95 THEN 'STABLE' ELSE 'DRIFTING' END AS status FROM c""",
)
_add(
    "clt_progressive",
    lambda spark, sf_dir: _rounded(validation.progressive(_positioned(spark, sf_dir), "o_totalprice")),
    """SELECT stage, count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean,
    round(100 * 1.96 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)) / abs(avg(o_totalprice)), 2) AS error_percent
    FROM orders JOIN (VALUES (50), (25), (10), (5)) x(stage) ON o_orderkey % stage = 0 GROUP BY stage""",
)
#: Each stage's rows are joined to it; the moments are the engine's own.
_CLT = f"""{_take("slow_pointer", 20)}, d AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) % 8 AS slice FROM p), k AS (SELECT unnest(range(1, 9)) AS stage),
    m AS (SELECT stage, count(*) AS n, avg(o_totalprice) AS mean, 196 * stddev_samp(o_totalprice) / sqrt(count(*)) / abs(avg(o_totalprice)) AS error_percent,
        avg(o_totalprice) FILTER (slice % 2 = 0) AS fast, avg(o_totalprice) FILTER (slice % 2 = 1) AS slow, count(*) FILTER (slice % 2 = 0) AS n_fast, count(*) FILTER (slice % 2 = 1) AS n_slow
        FROM k JOIN d ON slice < stage GROUP BY stage),
    e AS (SELECT *, CASE WHEN n_fast >= 20 AND n_slow >= 20 THEN 100 * abs(slow - fast) / abs(fast) END AS cross_error FROM m),
    f AS (SELECT *, stage >= 2 AND ((n >= 50 AND error_percent <= 2) OR (stage >= 4 AND coalesce(cross_error <= 2, false))) AS good FROM e)"""
_add(
    "clt_cross_validate",
    lambda spark, sf_dir: _rounded(validation.clt_stages(_positioned(spark, sf_dir), "o_totalprice", 20)),
    f"""{_CLT} SELECT stage, n, round(mean, 2) AS mean, round(error_percent, 2) AS error_percent, round(cross_error, 2) AS cross_error, bool_or(good) OVER (ORDER BY stage) AS stopped FROM f""",
)
_add(
    "s_clt_validated",
    lambda spark, sf_dir: validation.clt_sample(_positioned(spark, sf_dir), "o_totalprice", 20).select("o_orderkey", "o_totalprice"),
    f"{_CLT} SELECT o_orderkey, o_totalprice FROM d WHERE slice < coalesce((SELECT min(stage) FROM f WHERE good), 8)",
)
_add(
    "s_signal_clt",
    lambda spark, sf_dir: validation.fast_slow_sample(_positioned(spark, sf_dir), "o_totalprice", 20).select("o_orderkey", "o_totalprice"),
    f"{_CLT} SELECT o_orderkey, o_totalprice FROM d WHERE slice < coalesce((SELECT min(stage) FROM f WHERE cross_error <= 2 AND stage >= 4), 8)",
)
_add(
    "clt_pilot_n",
    lambda spark, sf_dir: validation.pilot_rows(_positioned(spark, sf_dir), "o_totalprice", 2.0),
    """WITH a AS (SELECT count(*) AS size FROM orders), b AS (SELECT count(o_totalprice) AS pilot, (1.96 * stddev_samp(o_totalprice) / abs(avg(o_totalprice)) / 0.02) ** 2 AS wanted FROM orders WHERE o_orderkey % 100 = 0)
    SELECT size, pilot, least(CAST(floor(wanted) AS BIGINT) + 1, size) AS needed, CAST(ceil(100.0 * least(CAST(floor(wanted) AS BIGINT) + 1, size) / size) AS BIGINT) AS percent FROM a, b""",
)


def _block_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _positioned(spark, sf_dir)
    return validation.block_estimates(orders, "o_totalprice", samplers.dense_size(orders))


_BLOCK_SQL = """SELECT o_orderkey // (n // 8) AS block, count(*) AS n, sum(o_totalprice) / count(*) * max(n) AS estimate FROM (SELECT *, count(*) OVER () AS n FROM orders)
    WHERE o_orderkey // (n // 8) < 8 AND o_orderkey - o_orderkey // (n // 8) * (n // 8) < n * 10 // 100 // 8 GROUP BY 1"""
_add("block_slices", lambda spark, sf_dir: _rounded(_block_slices(spark, sf_dir)), f"SELECT block, n, round(estimate, 2) AS estimate FROM ({_BLOCK_SQL})")
_add(
    "block_verdict",
    lambda spark, sf_dir: _rounded(validation.block_verdict(_block_slices(spark, sf_dir))),
    f"""SELECT round(value, 2) AS value, round(l, 2) AS confidence_level, CASE WHEN l >= 0.95 THEN 'STABLE' ELSE 'DRIFTING' END AS status
    FROM (SELECT avg(estimate) AS value, greatest(0, least(1, 1 - stddev_samp(estimate) / abs(avg(estimate)))) AS l FROM ({_BLOCK_SQL}))""",
)


def _head(parts: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = _positioned(spark, sf_dir)
        return _rounded(validation.head_sum(orders, "o_totalprice", samplers.dense_size(orders), 10, parts))

    return run


_HEAD_SQL = """SELECT round(sum(o_totalprice) * max(n) / max(n * 10 // 100), 2) AS value, count(o_totalprice) AS n FROM (SELECT *, count(*) OVER () AS n FROM orders) WHERE o_orderkey < n * 10 // 100"""
_add("head_block", _head(1), _HEAD_SQL)
_add("parallel_head", _head(4), _HEAD_SQL)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative error of the sampled sum at each rate, in one pass over the table."""
    positioned = _positioned(spark, sf_dir)
    sums = [F.sum("o_totalprice").alias("exact"), F.count(F.lit(1)).alias("size")]
    for p in (1, 5, 10, 20, 50):
        chosen = F.expr(samplers.predicate("slow_pointer", None, p))
        sums.append((F.sum(F.when(chosen, F.col("o_totalprice"))) / F.count(F.when(chosen, 1))).alias(f"p{p}"))
    totals = positioned.agg(*sums)
    error = lambda p: 100 * F.abs(F.col(f"p{p}") * F.col("size") - F.col("exact")) / F.col("exact")
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), error(p).alias("error_percent")) for p in (1, 5, 10, 20, 50)]))
    return _rounded(totals.select(rows.alias("r")).select("r.*"))


_add(
    "bench_error_by_rate",
    _errors,
    f"WITH {_T.format(key='o_orderkey', table='orders')}, x AS (SELECT sum(o_totalprice) AS exact FROM t) "
    + " UNION ALL ".join(
        f"SELECT {p} AS percent, round(100 * abs(avg(o_totalprice) * max(n) - (SELECT exact FROM x)) / (SELECT exact FROM x), 2) AS error_percent FROM t WHERE {_due('pos').replace('{p}', str(p))}"
        for p in (1, 5, 10, 20, 50)
    ),
)

# --- tables ----------------------------------------------------------------------

_add(
    "table_stats",
    lambda spark, sf_dir: _rounded(tables.statistics(_table(spark, sf_dir, "orders"))),
    "SELECT count(*) AS total_records, count(*) // 255 + 1 AS node_count, CAST(greatest(1, ceil(ln(count(*)) / ln(255))) AS INTEGER) AS tree_height, round(count(*) * 32 / 1048576.0, 2) AS size_mb FROM orders",
)
_add("example_table", lambda spark, sf_dir: tables.example_table(spark), "SELECT i AS id, i * 1.5::DOUBLE AS value FROM range(1, 11) r(i)")
_add("sales_generator", lambda spark, sf_dir: tables.sales_table(spark))
