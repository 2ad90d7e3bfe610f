"""Sampling methods as predicates on a row's position.

Every method keeps ``percent`` of the rows, from 1 to 99, spread over the whole
table (but for ``head``, the first rows by name). Its rows are those whose
0-based position satisfies an expression in integer arithmetic, so that a
sample is an ordinary filter: it needs no shuffle and runs inside whole-stage
code generation. Most rest on one law: of n consecutive numbers q from 0,
``(q * p + o) % 100 >= 100 - p`` holds for (n * p + o) DIV 100 - o DIV 100,
evenly spread. It needs no table size and can't overflow below 9e16 rows.

Positions are in the column ``__pos``, which with_position() adds. Columns that
start with two underscores are the library's own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType
from pyspark.sql.window import Window

POS = "__pos"
SEED = 42
#: Multipliers of the portable hash; both below 2**31, so that products of 32-bit numbers fit a long.
HASH_MULTIPLIERS = (1597334677, 1103515245)
HASH_MODULUS = 2**32
#: Contiguous parts of a table for ``segments``.
SEGMENTS = 200
#: Bins of the hash in which an exact random sample looks for its limit.
RANDOM_BINS = 65_536


def mix(x: int) -> int:
    """A number below 2**32 from another; the same as mixed() gives in a query."""
    x %= HASH_MODULUS
    for m in HASH_MULTIPLIERS:
        x = ((x ^ (x >> 16)) * m) % HASH_MODULUS
    return x


def mixed(x: str) -> str:
    x = f"(({x}) & {HASH_MODULUS - 1})"
    for m in HASH_MULTIPLIERS:
        x = f"((({x} ^ shiftright({x}, 16)) * {m}) & {HASH_MODULUS - 1})"
    return x


def even(q: str, percent: int, offset: str | int = 0, base: int = 100) -> str:
    """percent of base of the numbers q, evenly spread."""
    return f"(({q}) * {percent} + {offset}) % {base} >= {base - percent}"


def by_index(size: int, p: int) -> str:
    """T = size * p DIV 100 rows, at j * size DIV T."""
    target = size * p // 100
    if not target:
        return "false"
    wide = "cast({} as decimal(38, 0))" if size * target >= 2**62 else "{}"
    j = wide.format(f"(({wide.format(POS)} * {target} + {size - 1}) DIV {size})")
    return f"{j} < {target} and ({j} * {size}) DIV {target} = {POS}"


def by_stride(size: int | None, p: int) -> str:
    """One row in every 100 / p."""
    return even(POS, p)


def by_pairs(size: int | None, p: int, step_size: int = 2) -> str:
    """Runs of step_size rows, one run in every 100 / p."""
    return even(f"{POS} DIV {step_size}", p)


def by_start(size: int | None, p: int, seed: int = SEED) -> str:
    """One row in every 100 / p, from a start that the seed gives."""
    return even(POS, p, mix(seed) % 100)


def by_fraction(size: int | None, p: int, seed: int = SEED) -> str:
    """One row in every 100 / p, from a start in thousandths of a step."""
    return even(POS, 10 * p, 1000 - (1 + mix(seed) % 999), 1000)


def by_region(size: int, p: int, regions: int = 4, seed: int | None = None) -> str:
    """The same share of some equal regions; with a seed each has its own start."""
    t = f"(({POS} * {regions}) DIV {size})"
    return even(f"{POS} - ({t} * {size} + {regions - 1}) DIV {regions}", p, 0 if seed is None else f"{mixed(f'{t} + {seed * regions}')} DIV 1024 % 100")


def block_rows(size: int, block: int) -> int:
    """Rows of one block: a hundredth of the table at most, so that whole blocks can make up any percentage."""
    return max(1, min(block, size // 100))


def by_block(size: int, p: int, block: int = 1000, offset: int = 0) -> str:
    """Whole blocks, evenly spread."""
    return even(f"{POS} DIV {block_rows(size, block)}", p, offset)


def by_region_blocks(size: int, p: int, block: int = 1000, regions: int = 4) -> str:
    """Whole blocks, with another start in each region."""
    rows = block_rows(size, block)
    blocks = -(-size // rows)
    b = f"({POS} DIV {rows})"
    t = f"(({b} * {regions}) DIV {blocks})"
    return even(f"{b} - ({t} * {blocks} + {regions - 1}) DIV {regions}", p, f"{t} * {100 // regions}")


def by_quota(size: int | None, p: int, leaf: int = 127) -> str:
    """An evenly spaced quota of every leaf; quotas add up to p percent."""
    n, i = f"({POS} DIV {leaf})", f"({POS} % {leaf})"
    quota = f"((({n} + 1) * {leaf * p}) DIV 100 - ({n} * {leaf * p}) DIV 100)"
    j = f"(({i} * {quota} + {leaf - 1}) DIV {leaf})"
    return f"{j} < {quota} and ({j} * {leaf}) DIV greatest(1, {quota}) = {i}"


def leaf_percent(p: int) -> int:
    """Percentage of leaves that a two-stage sample takes: the square root of the whole share."""
    return math.isqrt(100 * p - 1) + 1


def by_two_stage(size: int, p: int, leaf: int = 127) -> str:
    """Evenly spread leaves, and of each an evenly spread share of rows."""
    rows, first = block_rows(size, leaf), leaf_percent(p)
    n = f"({POS} DIV {rows})"
    within = f"(({n} * {first}) DIV 100) * {rows} + {POS} % {rows}"  # its place among the chosen leaves' rows
    return f"{even(n, first)} and {even(within, p, 0, first)}"


def by_wrap(size: int, p: int, seed: int = SEED) -> str:
    """One row in every 100 / p from a start anywhere, going on at the table's beginning."""
    return even(f"({POS} + {size - mix(seed) % size}) % {size}", p) if size else "false"


def by_jitter(size: int | None, p: int, seed: int = SEED) -> str:
    """p rows of every 100, at a place that a hash gives."""
    return even(POS, p, f"{mixed(f'{POS} DIV 100 + {seed}')} DIV 1024 % 100")


def by_stride_bytes(size: int | None, p: int, stride_bytes: int = 320, row_bytes: int = 32) -> str:
    """The first rows of every stride of bytes; their numbers add up to p percent."""
    rows = max(1, stride_bytes // row_bytes)
    w = f"({POS} DIV {rows})"
    return f"{POS} % {rows} < (({w} + 1) * {rows * p}) DIV 100 - ({w} * {rows * p}) DIV 100"


def segment_bounds(size: int, p: int) -> list[tuple[int, int]]:
    """First and last position of each chosen segment."""
    chosen = [k for k in range(SEGMENTS) if k * p % 100 >= 100 - p]
    bounds = [(-(-k * size // SEGMENTS), -(-(k + 1) * size // SEGMENTS) - 1) for k in chosen]
    return [(a, b) for a, b in bounds if a <= b]


def by_segment(size: int, p: int) -> str:
    """Contiguous segments as ranges of positions: on a sorted dense key whole row groups are skipped."""
    return " or ".join(f"({POS} >= {a} and {POS} <= {b})" for a, b in segment_bounds(size, p)) or "false"


def by_head(size: int, p: int) -> str:
    """The first rows: fast, and biased unless the order is random."""
    return f"{POS} < {size * p // 100}"


def _dual(size: int | None, p: int) -> str:
    """A sparse pass for a third of the sample, and a denser one over the rows that it leaves."""
    left = f"{POS} - ({POS} * {p}) DIV 300"
    return f"({even(POS, p, 0, 300)} or {even(left, 2 * p, 0, 300 - p)})"


#: Methods by name: predicate and parameters.
METHODS: dict[str, tuple[Callable[..., str], dict]] = {
    "index": (by_index, {}), "byte_offset": (by_index, {}), "slow_pointer": (by_stride, {}), "fast_pointer": (by_pairs, {}), "dual_pointer": (_dual, {}),
    "memory_stride": (by_stride, {}), "address_arithmetic": (by_stride, {}), "stride_bytes": (by_stride_bytes, {}), "random_start_stride": (by_start, {}),
    "sequential": (by_fraction, {}), "parallel_pointer": (by_region, {}), "region_stride": (by_region, {"regions": 8, "seed": SEED}), "block": (by_block, {}),
    "page": (by_block, {"block": 128, "offset": 25}), "parallel_block": (by_region_blocks, {}), "node_skip": (by_block, {"block": 127, "offset": 50}),
    "balanced": (by_quota, {}), "direct_access": (by_two_stage, {}), "nth_wrap": (by_wrap, {}), "jittered": (by_jitter, {}), "segments": (by_segment, {}), "head": (by_head, {}),
}
#: Methods that take whole blocks, evenly spread, and what they go by if not told.
BLOCKS, BLOCK_DEFAULTS = ("block", "page", "node_skip"), {"block": 1000, "offset": 0}
#: Methods that need no table size.
SIZELESS = frozenset({"slow_pointer", "fast_pointer", "dual_pointer", "memory_stride", "address_arithmetic", "stride_bytes", "random_start_stride", "sequential", "balanced", "jittered"})


def predicate(method: str, size: int | None, percent: int, **params) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown sampling method {method!r}; known: {', '.join(sorted(METHODS))}")
    if not 0 < percent < 100:
        return "true"
    if size is None and method not in SIZELESS:
        raise ValueError(f"{method} needs the table's size")
    if size == 0:
        return "false"
    make, defaults = METHODS[method]
    return make(size, percent, **(defaults | params))


def units(method: str, size: int, percent: int, **params) -> tuple[str, int, Column] | None:
    """(number of a row's unit, units in all, aggregate that counts the chosen ones) where a method takes units of rows whole."""
    if method == "segments":
        return f"({POS} * {SEGMENTS}) DIV {size}", min(SEGMENTS, size), F.lit(len(segment_bounds(size, percent)))
    if method not in (*BLOCKS, "parallel_block"):
        return None
    given = BLOCK_DEFAULTS | METHODS[method][1] | params
    rows = block_rows(size, given["block"])
    blocks = -(-size // rows)
    if method in BLOCKS:
        return f"{POS} DIV {rows}", blocks, F.lit(due(blocks, percent, given["offset"]))
    first = f"({predicate(method, size, percent, **params)}) and {POS} % {rows} = 0"
    return f"{POS} DIV {rows}", blocks, F.count(F.when(F.expr(first), 1))


def due(n: int, percent: int, offset: int = 0, base: int = 100) -> int:
    """How many of the numbers 0 to n - 1 even() holds for."""
    return (n * percent + offset) // base - offset // base


def taken(method: str, size: int, percent: int, **params) -> int | None:
    """Rows that a method keeps of a table of some size; None where only a count can tell."""
    given = {"seed": SEED} | BLOCK_DEFAULTS | METHODS[method][1] | params
    if method in ("slow_pointer", "memory_stride", "address_arithmetic", "nth_wrap"):
        return due(size, percent)
    if method in ("index", "byte_offset", "head"):
        return size * percent // 100
    if method == "random_start_stride":
        return due(size, percent, mix(given["seed"]) % 100)
    if method == "sequential":
        return due(size, 10 * percent, 1000 - (1 + mix(given["seed"]) % 999), 1000)
    if method == "jittered":
        whole, offset = size // 100 * 100, mix(size // 100 + given["seed"]) // 1024 % 100
        return due(size, percent, offset) - due(whole, percent, offset) + whole * percent // 100
    if method == "segments":
        return sum(b - a + 1 for a, b in segment_bounds(size, percent))
    if method in BLOCKS:
        rows, offset = block_rows(size, given["block"]), given["offset"]
        blocks = -(-size // rows)
        last = due(blocks, percent, offset) - due(blocks - 1, percent, offset)
        return due(blocks, percent, offset) * rows - last * (blocks * rows - size)
    return None


def with_position(df: DataFrame, key: str | None = None, dense: bool = False) -> DataFrame:
    """df with a 0-based position ``__pos``.

    A dense key is the position itself and costs nothing (check_dense() tells).
    Without a key, a table of Parquet files takes the files' order: each row's
    place in its file after the rows of the files before, which needs one count
    for each file and no shuffle. Else rows are sorted in range partitions by the
    key (or all columns) and numbered from partition counts, so that no task
    sees the whole table.
    """
    if dense:
        return df.withColumn(POS, F.col(key).cast("long"))
    return _numbered(df, key)[0]


def placed(df: DataFrame, key: str | None = None, look: bool = True) -> tuple[DataFrame, int | None]:
    """df with positions, by a dense key or else by the rows' order, and its rows where no scan is needed to know them.

    Of a dense key of Parquet files their footers tell, which look asks for;
    where they speak against it, a scan has to decide.
    """
    if key is None:
        return _numbered(df, None)
    size, least, most = (footers(df, key) if look else None) or (None, None, None)
    return with_position(df, key, dense=True), size if not size or (least, most) == (0, size - 1) else None


def footers(df: DataFrame, key: str) -> tuple[int, int | None, int | None] | None:
    """(rows, least, most) of a whole-number column, from the footers of a table's Parquet files.

    None for a table that isn't one of plain Parquet files (a filtered one, say), or
    whose footers have no statistics. Executors read the footers, no data. The
    reader finds a column by its place in the table's schema, so that files with
    other orders of columns give other columns' bounds.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    relation, column = plan.relation(), df.select(key)
    if relation.fileFormat().toString() != "Parquet" or not relation.partitionSchema().isEmpty() or not isinstance(column.schema[0].dataType, IntegralType):
        return None
    session = df.sparkSession.newSession()  # its own settings: this reader can answer from footers
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    paths = relation.location().rootPaths()
    try:
        table = session.read.schema(StructType.fromJson(json.loads(relation.dataSchema().json()))).parquet(*[paths.apply(k).toString() for k in range(paths.size())])
        of = table.agg(F.count(F.lit(1)), F.min(key), F.max(key))
        return tuple(of.first()) if "PushedAggregation: [COUNT" in of._jdf.queryExecution().toString() else None
    except PySparkException:
        return None


def _numbered(df: DataFrame, key: str | None) -> tuple[DataFrame, int]:
    return (None if key else _by_file(df)) or _by_order(df, [key] if key else df.columns)


#: Files whose starts may be broadcast (a path and a number each).
BROADCAST_FILES = 100_000


def _by_file(df: DataFrame) -> tuple[DataFrame, int] | None:
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # no table of files
        return None
    counts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).select("__file", F.xxhash64("__file").alias("__short"), "n")
    starts, total = [], 0
    for path, short, n in sorted(counts.collect()):
        starts.append((path, short, total))
        total += n
    key = "__short" if len({short for _, short, _ in starts}) == len(starts) else "__file"  # numbers are found faster than paths
    before = df.sparkSession.createDataFrame(starts, "__file string, __short long, __before long").select(key, "__before")
    if len(starts) <= BROADCAST_FILES:
        before = F.broadcast(before)
    placed_rows = rows.withColumn("__short", F.xxhash64("__file")).join(before, key)
    return placed_rows.withColumn(POS, F.col("__before") + F.col("__row")).drop("__file", "__short", "__row", "__before"), total


def _by_order(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).persist()
    counts = sorted(ranged.groupBy("__part").count().collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    if not starts:
        return df.withColumn(POS, F.lit(0).cast("long")), 0
    base = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(POS, (F.element_at(base, F.col("__part")) + rank - 1).cast("long")).drop("__part"), total


def density() -> list[Column]:
    """Aggregates that tell whether positions are 0 to n - 1 (for distinct ones)."""
    return [F.count(F.lit(1)).alias("__size"), F.min(POS).alias("__least"), F.max(POS).alias("__most")]


NOT_DENSE = "the key isn't dense from 0; leave it out to have the rows numbered"


def dense_size(positioned: DataFrame) -> int:
    """Rows of a table whose positions are 0 to n - 1; ValueError if they aren't."""
    size, least, most = positioned.agg(*density()).first()
    if size and (least, most) != (0, size - 1):
        raise ValueError(NOT_DENSE)
    return size


def sample(positioned: DataFrame, method: str, percent: int, size: int | None = None, **params) -> DataFrame:
    """The sampled rows of a table with positions; everything at 100 % or more, or at none."""
    if percent <= 0 or percent >= 100:
        return positioned
    if size is None and method not in SIZELESS:
        size = dense_size(positioned)
    return positioned.filter(predicate(method, size, percent, **params))


def random_sample(positioned: DataFrame, percent: int, size: int | None = None, seed: int = SEED) -> DataFrame:
    """Exactly size * percent DIV 100 rows: those with the smallest hash of position and seed.

    The hash's RANDOM_BINS bins are counted; rows of the bins before the one in
    which the limit lies are kept by a filter, only that bin's rows are ranked.
    """
    size = dense_size(positioned) if size is None else size
    target = size * min(max(percent, 0), 100) // 100
    hashed = positioned.withColumn("__hash", F.expr(mixed(f"{POS} + {mix(seed)}"))).withColumn("__bin", F.expr(f"__hash DIV {HASH_MODULUS // RANDOM_BINS}"))
    bins = hashed.groupBy("__bin").agg(F.count(F.lit(1)).alias("n"))
    running = bins.withColumn("upto", F.sum("n").over(Window.orderBy("__bin")))  # RANDOM_BINS rows at most
    limit = running.filter(F.col("upto") >= target).orderBy("__bin").limit(1).select(F.col("__bin").alias("__last"), (target - F.col("upto") + F.col("n")).alias("__left"))
    marked = hashed.crossJoin(F.broadcast(limit))  # one row
    below = marked.filter("__bin < __last")
    rank = F.row_number().over(Window.partitionBy("__bin").orderBy("__hash", POS))
    at = marked.filter("__bin = __last").withColumn("__rank", rank).filter("__rank <= __left").drop("__rank")
    return below.unionAll(at).drop("__hash", "__bin", "__last", "__left")


def quotas(sizes: list[int], target: int) -> list[int]:
    """Equal shares of the target for strata of some sizes; what a small one lacks goes to the others."""
    out, left = [0] * len(sizes), target
    for done, k in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[k] = min(sizes[k], left // (len(sizes) - done))
        left -= out[k]
    return out


def strata_cuts(positioned: DataFrame, measure: str, strata: int, size: int) -> list[tuple]:
    """(measure, position) of the first row of each stratum but the first, of equal numbers of rows, by measure."""
    ranked = _by_order(positioned.select(F.col(measure).alias("__measure"), F.col(POS).alias("__of")), ["__measure", "__of"])[0]
    firsts = sorted({size * k // strata for k in range(1, strata)} - {0})
    found = sorted((r[POS], r["__measure"], r["__of"]) for r in ranked.filter(F.col(POS).isin(firsts)).collect())
    return [(m, at) for _, m, at in found]


def stratified_sample(positioned: DataFrame, measure: str, percent: int, strata: int = 4, size: int | None = None, label: str = "stratum") -> DataFrame:
    """An equal systematic share of each stratum of the measure, size * percent DIV 100 rows in all.

    Strata hold equal numbers of rows by rank of the measure (nulls first, ties
    by position); their number goes to the column ``label``. Rows are numbered
    inside their stratum from counts by partition and stratum, which the driver
    sees. Everything at 100 % or more, or at none.
    """
    if label in positioned.columns:
        raise ValueError(f"the table has a column {label!r}; choose another label")
    size = dense_size(positioned) if size is None else size
    stratum = F.lit(0)
    for m, at in strata_cuts(positioned, measure, strata, size):
        value = F.col(measure)
        after = value.isNotNull() if m is None else value > m
        same = value.isNull() if m is None else value == m
        stratum = stratum + F.when(after | (same & (F.col(POS) >= at)), 1).otherwise(0)
    marked = positioned.withColumn(label, stratum)
    if percent <= 0 or percent >= 100:
        return marked
    ranged = marked.repartitionByRange(POS).sortWithinPartitions(POS).withColumn("__part", F.spark_partition_id()).persist()
    counts = {(r["__part"], r[label]): r["count"] for r in ranged.groupBy("__part", label).count().collect()}
    if not counts:
        return marked
    starts, sizes = {}, [0] * strata
    for (part, k), n in sorted(counts.items()):
        starts[part, k] = sizes[k]
        sizes[k] += n
    quota = quotas(sizes, size * percent // 100)
    base = F.create_map(*[F.lit(x) for (part, k), v in starts.items() for x in (part * strata + k, v)])
    rank = F.row_number().over(Window.partitionBy("__part", label).orderBy(POS))
    ranked = ranged.withColumn("__rank", (F.element_at(base, F.col("__part") * strata + F.col(label)) + rank - 1).cast("long"))
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(label) + 1)
    ranked = ranked.withColumn("__n", of(sizes)).withColumn("__quota", of(quota))
    j = "((__rank * __quota + __n - 1) DIV __n)"
    return ranked.filter(f"{j} < __quota and ({j} * __n) DIV greatest(1, __quota) = __rank").drop("__part", "__rank", "__n", "__quota")


def adaptive_block_sample(positioned: DataFrame, measure: str, percent: int, least: int = 500, most: int = 2000, zones: int = 10, size: int | None = None) -> DataFrame:
    """The same share of every block; blocks are smaller in zones where the measure varies more."""
    size = dense_size(positioned) if size is None else size
    width = max(1, size // zones)
    zoned = positioned.withColumn("__zone", F.least(F.expr(f"{POS} DIV {width}"), F.lit(zones - 1)))
    spread = zoned.groupBy("__zone").agg(F.var_pop(measure).alias("__v"))
    top = F.max("__v").over(Window.partitionBy())  # one row for each zone
    block = F.when(top > 0, F.lit(least) + F.floor((most - least) * (1 - F.col("__v") / top))).otherwise(least)
    chosen = zoned.join(F.broadcast(spread.select("__zone", block.cast("long").alias("__width"))), "__zone")
    return chosen.filter(f"({POS} - __zone * {width}) % __width < greatest(1, __width * {percent} DIV 100)").drop("__zone", "__width")


def gather(positioned: DataFrame, positions: list[int]) -> DataFrame:
    """The rows at some positions, each once."""
    wanted = positioned.sparkSession.createDataFrame([(int(p),) for p in positions], f"{POS} long")
    return positioned.join(wanted, POS, "left_semi")


def round_robin(df: DataFrame, parts: int) -> DataFrame:
    """df dealt out row by row over some partitions."""
    return df.repartition(parts)
