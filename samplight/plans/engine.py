"""Exact and sampled aggregates with confidence intervals.

Where the table's size is known (rows numbered by file, or a dense key of
Parquet files, whose footers tell) and a closed form gives the sample's, the
sample is a filter under the aggregates; that of ``segments`` skips row groups.
Else, and where one scan does it all, the table is read once with the sample as a
condition inside the aggregates, next to both sizes; with a filter or groups
these come from a second scan of the key alone, so that the filter is pushed
down to the first one.

Columns that start with two underscores are the library's own. A group key that
is called like a result column (value, ci_lower, ci_upper, n) is given back as
``group_<name>``; a key that is an expression is called by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplight.functions.estimators import margin_sql, value_sql, z_score
from samplight.operators.samplers import NOT_DENSE, POS, SIZELESS, dense_size, density, placed, predicate, taken, units
from samplight.plans.spec import AGGREGATES, QueryError, QuerySpec, parse

DEFAULT_PERCENT = 10
#: Hashed places: a period in the data can't fall in with the sample's.
DEFAULT_METHOD = "jittered"
RESULTS = ("value", "ci_lower", "ci_upper", "n")


def _name(key: str) -> str:
    plain = key.strip("`")
    return f"group_{plain}" if plain.lower() in RESULTS else plain


def _shown(out: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The result columns from __k<i>, value, margin and __n."""
    value, margin = F.col("__value"), F.col("__margin")
    named = [F.col(f"__k{i}").alias(_name(k)) for i, k in enumerate(keys)]
    return out.select(*named, value.alias("value"), (value - margin).alias("ci_lower"), (value + margin).alias("ci_upper"), F.coalesce("__n", F.lit(0).cast("long")).alias("n"))


def _numbers(spec: QuerySpec) -> tuple[Column, Column]:
    """(1 where the column isn't null, its value as a double)."""
    if spec.column == "*":
        return F.lit(1), F.lit(1.0)
    x = F.expr(spec.column)
    return F.when(x.isNotNull(), 1), F.lit(0.0) if spec.agg == "count" else x.cast("double")


def exact(table: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row (or one a group) of value, ci_lower, ci_upper (both value) and n."""
    rows = table.filter(f"({spec.where})") if spec.where else table
    keys = [F.expr(k).alias(f"__k{i}") for i, k in enumerate(spec.group_by)]
    if spec.agg in AGGREGATES and not spec.distinct:
        there, x = _numbers(spec)
        sums = rows.groupBy(*keys).agg(F.count(there).alias("__n"), F.sum(x).alias("__s"))
        value = {"sum": "__s", "count": "cast(__n as double)", "avg": "__s / nullif(__n, 0)"}[spec.agg]
        return _shown(sums.withColumn("__value", F.expr(value)).withColumn("__margin", F.lit(0.0)), spec.group_by)
    value = F.expr(f"{spec.agg}({'distinct ' if spec.distinct else ''}{spec.column})")
    out = rows.groupBy(*keys).agg(value.alias("__value"), F.count(F.lit(1)).alias("__n"))
    names = [F.col(f"__k{i}").alias(_name(k)) for i, k in enumerate(spec.group_by)]
    return out.select(*names, F.col("__value").alias("value"), F.col("__value").alias("ci_lower"), F.col("__value").alias("ci_upper"), F.col("__n").alias("n"))


def estimate(table: DataFrame, spec: QuerySpec, percent: int = 0, key: str | None = None, method: str = DEFAULT_METHOD, confidence: float = 0.95, **params) -> DataFrame:
    """One row (or one a group) of value, ci_lower, ci_upper and n, the rows it rests on.

    key is a dense 0-based column of the table; without one rows are numbered. A
    key that isn't dense raises an error, at once or when the result is read.
    Groups that the sample missed stay, with a null value.
    """
    if percent <= 0 or percent >= 100:
        return exact(table, spec)
    if spec.agg not in AGGREGATES or spec.distinct:
        raise QueryError("MIN, MAX and DISTINCT are answered exactly only")
    one_scan = method in SIZELESS and not spec.where and not spec.group_by  # which tells the size too
    positioned, size = placed(table, key, look=not one_scan)
    counted = size is None
    if counted and method not in SIZELESS:
        size = dense_size(positioned)
    if size == 0:
        return exact(table, spec)
    m = None if size is None else taken(method, size, percent, **params)
    blocks = None if size is None else units(method, size, percent, **params)
    chosen = F.expr(predicate(method, size, percent, **params))
    there, x = _numbers(spec)
    rows = positioned.filter(f"({spec.where})") if spec.where else positioned
    alone = m is not None and not spec.group_by  # groups that the sample missed are told by all rows
    if alone:
        rows = rows.filter(chosen)
    keys = [F.expr(k).alias(f"__k{i}") for i, k in enumerate(spec.group_by)]
    names = [f"__k{i}" for i in range(len(keys))]
    totals = [*density(), F.count(F.when(chosen, 1)).cast("double").alias("__m")]
    mine = lambda c: c if alone else F.when(chosen, c)
    own = [F.count(mine(there)).alias("__n"), F.sum(mine(x)).alias("__s"), F.sum(mine(x * x)).alias("__ss")]
    if blocks is not None:
        unit = mine(F.expr(blocks[0])).alias("__unit")
        by_unit = rows.groupBy(*keys, unit).agg(F.count(mine(there)).alias("c"), F.coalesce(F.sum(mine(x)), F.lit(0.0)).alias("t"))
        sums = by_unit.groupBy(*names).agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("__n"), F.sum(F.when(F.col("c") > 0, F.col("t"))).alias("__s"), F.sum(F.col("t") * F.col("t")).alias("__ss"),
            F.sum(F.col("c") * F.col("c")).cast("double").alias("__cc"), F.sum(F.col("c") * F.col("t")).alias("__cs"),
        )
        units_of = [F.lit(float(blocks[1])).alias("__all_units"), blocks[2].cast("double").alias("__units")]
        if m is None:
            out = sums.crossJoin(F.broadcast(positioned.agg(*totals, *units_of)))  # one row
        else:
            out = sums.select("*", F.lit(size).alias("__size"), F.lit(float(m)).alias("__m"), *units_of)
    elif m is not None:
        out = rows.groupBy(*keys).agg(*own).select("*", F.lit(size).alias("__size"), F.lit(float(m)).alias("__m"))
    else:
        if spec.where or keys:
            if not keys:
                rows = rows.filter(chosen)
            out = rows.groupBy(*keys).agg(*own).crossJoin(F.broadcast(positioned.agg(*totals)))  # one row
        else:
            out = positioned.agg(*own, *totals)
    if key is not None and counted and size is None:
        out = _guarded(out)
    out = out.withColumn("__size", F.col("__size").cast("double"))
    out = out.withColumn("__value", F.expr(f"case when __n > 0 then {value_sql(spec.agg)} when '{spec.agg}' = 'count' and {not keys} then 0D end"))
    return _shown(out.withColumn("__margin", F.expr(margin_sql(spec.agg, z_score(confidence), blocks is not None))), spec.group_by)


def _guarded(out: DataFrame) -> DataFrame:
    """out, with an error when it is read if the key isn't dense."""
    sound = F.expr("coalesce(__least = 0 and __most = __size - 1, true)")
    return out.withColumn("__m", F.when(sound, F.col("__m")).otherwise(F.raise_error(F.lit(NOT_DENSE)).cast("double")))


def _joined(spark: SparkSession, spec: QuerySpec, percent: int, key: str | None, method: str, confidence: float, **params) -> DataFrame:
    """A sample of the first table, joined to the others; the sampled unit is a row of the first table."""
    rest = spec.table[len(spec.base) :]
    words = rest.split()
    named = bool(words) and words[0].lower() not in ("join", "inner", "left", "right", "full", "cross", "natural", "semi", "anti") and words[0] != ","
    if spec.agg not in AGGREGATES or spec.distinct:
        raise QueryError("MIN, MAX and DISTINCT are answered exactly only")
    positioned, size = placed(spark.table(spec.base), key)
    if size is None and method not in SIZELESS:
        size = dense_size(positioned)
    m = None if size is None else taken(method, size, percent, **params)
    sampled = positioned.filter(predicate(method, size, percent, **params))
    keys = ", ".join(f"{k} AS __k{i}" for i, k in enumerate(spec.group_by))
    x = "1" if spec.column == "*" else spec.column
    source = "{__taken}" + ("" if named else f" AS {spec.base.split('.')[-1]}") + rest
    where = f" WHERE ({spec.where})" if spec.where else ""
    rows = spark.sql(f"SELECT {keys + ', ' if keys else ''}{POS}, {x} AS __x FROM {source}{where}", __taken=sampled)
    names = [f"__k{i}" for i in range(len(spec.group_by))]
    by_row = rows.groupBy(*names, POS).agg(F.count("__x").alias("c"), F.sum(F.lit(0.0) if spec.agg == "count" else F.col("__x").cast("double")).alias("t"))
    sums = by_row.groupBy(*names).agg(
        F.sum("c").alias("__n"), F.sum("t").alias("__s"), F.sum(F.col("t") * F.col("t")).alias("__ss"),
        F.sum(F.col("c") * F.col("c")).cast("double").alias("__cc"), F.sum(F.col("c") * F.col("t")).alias("__cs"),
    )
    if m is not None:
        out = sums.select("*", F.lit(size).alias("__size"), F.lit(float(m)).alias("__m"))
    else:
        totals = positioned.agg(*density(), F.count(F.when(F.expr(predicate(method, size, percent, **params)), 1)).cast("double").alias("__m"))
        out = sums.crossJoin(F.broadcast(totals))  # one row
    out = (_guarded(out) if key is not None and size is None else out).withColumn("__size", F.col("__size").cast("double"))
    out = out.withColumn("__units", F.col("__m")).withColumn("__all_units", F.col("__size"))
    out = out.withColumn("__value", F.expr(f"case when __n > 0 then {value_sql(spec.agg)} end"))
    return _shown(out.withColumn("__margin", F.expr(margin_sql(spec.agg, z_score(confidence), True))), spec.group_by)


def _passed_through(spark: SparkSession, spec: QuerySpec, sql: str) -> DataFrame:
    """Joins, subqueries and trailing clauses, exactly, as Spark SQL has them."""
    x = f"{spec.agg}({'DISTINCT ' if spec.distinct else ''}{spec.column})"
    keys = "".join(f"{k} AS `{_name(k)}`, " for k in spec.group_by)
    text = f"SELECT {keys}{x} AS value FROM {spec.table}" + (f" WHERE {spec.where}" if spec.where else "")
    text += f" GROUP BY {', '.join(spec.group_by)}" if spec.group_by else ""
    out = spark.sql(f"{text} {spec.tail}")
    return out.select(*[f"`{_name(k)}`" for k in spec.group_by], "value", F.col("value").alias("ci_lower"), F.col("value").alias("ci_upper"), F.lit(None).cast("long").alias("n"))


def chosen_percent(spec: QuerySpec, percent: int | None) -> int:
    return percent if percent is not None else spec.percent if spec.percent is not None else DEFAULT_PERCENT if spec.approximate else 0


def _run(spark: SparkSession, sql: str, percent: int | None, grouped: bool, key: str | None = None, method: str = DEFAULT_METHOD, confidence: float = 0.95, **params) -> DataFrame:
    spec = parse(sql)
    if bool(spec.group_by) != grouped:
        raise QueryError("GROUP BY needs the grouped form" if spec.group_by else "the grouped form needs GROUP BY")
    rate = chosen_percent(spec, percent)
    if not 0 < rate < 100:
        return _passed_through(spark, spec, sql) if spec.joined or spec.tail else exact(spark.table(spec.table), spec)
    if spec.tail:
        raise QueryError("HAVING, ORDER BY, LIMIT and set operations are answered exactly only")
    if spec.joined:
        if spec.base is None:
            raise QueryError("a subquery has no table to sample")
        return _joined(spark, spec, rate, key, method, confidence, **params)
    return estimate(spark.table(spec.table), spec, rate, key, method, confidence, **params)


def run_query(spark: SparkSession, sql: str, percent: int | None = None, **options) -> DataFrame:
    return _run(spark, sql, percent, False, **options).select("value")


def run_query_with_ci(spark: SparkSession, sql: str, percent: int | None = None, **options) -> DataFrame:
    return _run(spark, sql, percent, False, **options)


def run_query_groupby(spark: SparkSession, sql: str, percent: int | None = None, **options) -> DataFrame:
    return _run(spark, sql, percent, True, **options).drop("ci_lower", "ci_upper", "n")


def run_query_groupby_with_ci(spark: SparkSession, sql: str, percent: int | None = None, **options) -> DataFrame:
    return _run(spark, sql, percent, True, **options)


def execute_sum(table: DataFrame, column: str) -> float:
    """The column's sum; 0 where there is nothing to sum."""
    return table.agg(F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0))).first()[0]


def execute_avg(table: DataFrame, column: str) -> float:
    return table.agg(F.coalesce(F.avg(F.col(column).cast("double")), F.lit(0.0))).first()[0]


def execute_count(table: DataFrame, column: str) -> int:
    return table.agg(F.count(column)).first()[0]
