"""Convergence and stability: slices of one pass compared with each other.

A table is cut into interleaved slices by position; the moments of all slices
come from one aggregate, so that stop rules look at a few rows and no row of
the table is read twice. What a rule decides is which slices a sample keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplight.functions.estimators import z_score
from samplight.operators.samplers import POS

#: Slices of a progressive sample at each percent of the table.
STAGES = 8
#: Rows below which a stop rule isn't asked; rows of both sides for a cross-validation.
LEAST_ROWS, LEAST_CROSS = 50, 20


def relative(difference: Column, to: Column) -> Column:
    """|difference| / |to|; the difference itself where that is zero."""
    return F.abs(difference) / F.when(to == 0, 1.0).otherwise(F.abs(to))


def slice_estimates(positioned: DataFrame, column: str, slices: int, agg: str = "sum") -> DataFrame:
    """slice, n and the table's sum, count or mean as each of some interleaved slices estimates it, in one pass."""
    x = F.col(column).cast("double")
    value = {"sum": F.sum(x) * slices, "count": (F.count(column) * slices).cast("double"), "avg": F.avg(x)}[agg]
    return positioned.groupBy((F.col(POS) % slices).alias("slice")).agg(F.count(column).alias("n"), value.alias("estimate"))


def combine(slices: DataFrame, agg: str = "sum") -> DataFrame:
    """One value from all slices: the mean of sums or counts, the mean weighted by n of means."""
    value = F.sum(F.col("estimate") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)) if agg == "avg" else F.avg("estimate")
    return slices.agg(value.alias("value"), F.sum("n").alias("n"))


def confidence_of(values: str = "estimate") -> Column:
    """1 - deviation / |mean| within 0 and 1; 0 for fewer than two values."""
    spread = relative(F.stddev_samp(values), F.avg(values))
    return F.when(F.count(values) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread)))


def verdict(slices: DataFrame, fast: int, threshold: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """The first `fast` slices against the others: value, confidence_level and status.

    STABLE needs both the confidence of the slower slices and the relative
    difference to hold; fewer than two slower slices are INSUFFICIENT_DATA.
    """
    quick = F.when(F.col("slice") < fast, F.col("estimate"))
    slow = F.when(F.col("slice") >= fast, F.col("estimate"))
    out = slices.agg(F.avg(quick).alias("value"), F.avg(slow).alias("slow"), F.stddev_samp(slow).alias("sd"), F.count(slow).alias("n_slow"))
    level = F.when(F.col("n_slow") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - relative(F.col("sd"), F.col("slow")))))
    near = relative(F.col("value") - F.col("slow"), F.col("value")) <= threshold
    status = F.when(F.col("n_slow") < 2, "INSUFFICIENT_DATA").when(near & (F.col("confidence_level") >= confidence), "STABLE").otherwise("DRIFTING")
    return out.withColumn("confidence_level", level).withColumn("status", status).select("value", "confidence_level", "status")


def progressive(positioned: DataFrame, column: str, stages: tuple[int, ...] = (50, 25, 10, 5), z: float = 1.96) -> DataFrame:
    """Nested samples of every 50th, 25th, ... row: stage, n, mean and relative margin in percent, in one pass."""
    stage_of = F.explode(F.array(*[F.when(F.col(POS) % s == 0, F.lit(s)) for s in stages])).alias("stage")
    rows = positioned.select(stage_of, F.col(column).alias("x")).filter("stage is not null")
    out = rows.groupBy("stage").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return out.select("stage", "n", "mean", (100 * z * relative(F.col("sd") / F.sqrt("n"), F.col("mean"))).alias("error_percent"))


def _slice_of(percent: int, stages: int) -> Column:
    """The slice of a row that is in the sample of percent, from 0 to stages - 1; null for others.

    Slices are dealt by the number of the row in the sample, so that each is a
    systematic sample of the whole table.
    """
    p = F.lit(percent)
    return F.when((F.col(POS) * p) % 100 >= 100 - p, F.expr(f"({POS} * {percent}) DIV 100 % {stages}"))


def clt_stages(positioned: DataFrame, column: str, percent: int, confidence: float = 0.95, max_error: float = 2.0, stages: int = STAGES) -> DataFrame:
    """The stop rule, slice by slice of a sample of percent: stage, n, mean, error_percent, cross_error, stopped.

    A sample grows by a slice at a time. It is large enough when the relative
    margin of the mean is within max_error percent and it has LEAST_ROWS rows
    (the central limit theorem), or when its even and odd slices agree within
    max_error percent and half of the sample is there (cross-validation).
    stopped marks the first such stage and all after it. A quarter of the stages
    is always taken, whatever the rule says.
    """
    x = F.col(column).cast("double")
    moments = positioned.select(_slice_of(percent, stages).alias("slice"), x.alias("x")).filter("slice is not null and x is not null")
    moments = moments.groupBy("slice").agg(F.count("x").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    upto = Window.orderBy("slice")  # one row for each slice
    fast, slow = F.col("slice") % 2 == 0, F.col("slice") % 2 == 1
    run = lambda c, side=None: F.sum(F.when(side, F.col(c)) if side is not None else F.col(c)).over(upto)
    out = moments.select(
        (F.col("slice") + 1).alias("stage"), run("c").alias("n"), run("s").alias("s"), run("ss").alias("ss"),
        run("c", fast).alias("n_fast"), run("s", fast).alias("s_fast"), run("c", slow).alias("n_slow"), run("s", slow).alias("s_slow"),
    )
    out = out.withColumn("mean", F.expr("s / n")).withColumn("var", F.expr("case when n > 1 then greatest(0, ss - s * s / n) / (n - 1) end"))
    out = out.withColumn("error_percent", 100 * z_score(confidence) * relative(F.sqrt(F.col("var") / F.col("n")), F.col("mean")))
    both = F.expr(f"n_fast >= {LEAST_CROSS} and n_slow >= {LEAST_CROSS}")
    mean_fast, mean_slow = F.expr("s_fast / nullif(n_fast, 0)"), F.expr("s_slow / nullif(n_slow, 0)")
    out = out.withColumn("cross_error", F.when(both, 100 * relative(mean_slow - mean_fast, mean_fast)))
    enough = (F.col("n") >= LEAST_ROWS) & (F.col("error_percent") <= max_error)
    agreed = (F.col("cross_error") <= max_error) & (2 * F.col("stage") >= stages)
    good = F.coalesce((4 * F.col("stage") >= stages) & (enough | agreed), F.lit(False))
    out = out.withColumn("stopped", F.max(good).over(Window.orderBy("stage")))
    return out.select(F.col("stage").cast("long").alias("stage"), "n", "mean", "error_percent", "cross_error", "stopped")


def clt_sample(positioned: DataFrame, column: str, percent: int, confidence: float = 0.95, max_error: float = 2.0, stages: int = STAGES) -> DataFrame:
    """The rows of the stages up to the one where the stop rule holds; all of the sample if it never does.

    The driver sees the stages' few rows; what is returned is a plain filter.
    """
    found = clt_stages(positioned, column, percent, confidence, max_error, stages).filter("stopped").agg(F.min("stage")).first()[0]
    return positioned.filter(_slice_of(percent, stages) < F.lit(stages if found is None else found))


def fast_slow_sample(positioned: DataFrame, column: str, percent: int, max_error: float = 2.0, stages: int = STAGES) -> DataFrame:
    """clt_sample() by the signal of cross-validation alone."""
    found = clt_stages(positioned, column, percent, 0.95, max_error, stages).filter(f"cross_error <= {max_error} and 2 * stage >= {stages}").agg(F.min("stage")).first()[0]
    return positioned.filter(_slice_of(percent, stages) < F.lit(stages if found is None else found))


def pilot_rows(positioned: DataFrame, column: str, error_percent: float, every: int = 100, confidence: float = 0.95) -> DataFrame:
    """From every 100th row: how many rows, and what percent, bring the mean's margin below error_percent."""
    z = z_score(confidence)
    x = F.when(F.col(POS) % every == 0, F.col(column).cast("double"))
    out = positioned.agg(F.count(F.lit(1)).alias("size"), F.count(x).alias("pilot"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    wanted = F.pow(z * relative(F.col("sd"), F.col("mean")) / (error_percent / 100), 2.0)
    rows = F.least(F.floor(wanted).cast("long") + 1, F.col("size"))
    return out.select("size", "pilot", rows.alias("needed")).withColumn("percent", F.ceil(100 * F.col("needed") / F.greatest("size", F.lit(1))).cast("long"))


def block_estimates(positioned: DataFrame, column: str, size: int, percent: int = 10, blocks: int = 8) -> DataFrame:
    """block, n and the table's sum as each of some contiguous blocks, evenly spread, estimates it."""
    every, rows = max(1, size // blocks), max(1, size * percent // 100 // blocks)
    chosen = positioned.filter(f"{POS} % {every} < {rows} and {POS} DIV {every} < {blocks}")
    scale = F.lit(float(size)) / F.count(F.lit(1))
    return chosen.groupBy(F.expr(f"{POS} DIV {every}").alias("block")).agg(F.count(column).alias("n"), (F.sum(F.col(column).cast("double")) * scale).alias("estimate"))


def block_verdict(blocks: DataFrame, confidence: float = 0.95) -> DataFrame:
    """value, confidence_level and status from the blocks' estimates."""
    out = blocks.agg(F.avg("estimate").alias("value"), confidence_of().alias("confidence_level"), F.count("estimate").alias("n"))
    status = F.when(F.col("n") < 2, "INSUFFICIENT_DATA").when(F.col("confidence_level") >= confidence, "STABLE").otherwise("DRIFTING")
    return out.select("value", "confidence_level", status.alias("status"))


def head_sum(positioned: DataFrame, column: str, size: int, percent: int = 10, parts: int = 1) -> DataFrame:
    """The table's sum from its first rows, split into parts: fast, and biased unless the order is random."""
    rows = size * percent // 100
    x = F.col(column).cast("double")
    head = positioned.filter(f"{POS} < {rows}").groupBy(F.expr(f"{POS} * {parts} DIV {max(1, rows)}").alias("part"))
    out = head.agg(F.count(column).alias("n"), F.sum(x).alias("s"))
    return out.agg((F.sum("s") * F.lit(float(size)) / F.lit(float(max(1, rows)))).alias("value"), F.sum("n").alias("n"))


TAG = "samplight"


def stop(spark: SparkSession, tag: str = TAG) -> list[str]:
    """End the running jobs of a tag (spark.addTag(tag) before them)."""
    spark.sparkContext.cancelJobsWithTag(tag)
    return [tag]
