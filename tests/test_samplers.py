from collections import Counter

import pytest
from pyspark.sql import functions as F

from samplight.operators import samplers
from samplight.operators.samplers import POS
from samplight.plans.roster import QUERIES

SIZE = 15_000
#: Rows that a method may be off its share by: a few starts, or one unit of rows.
SLACK = {"block": 150, "page": 128, "parallel_block": 4 * 150, "node_skip": 127, "segments": 75, "direct_access": 130, "balanced": 127, "region_stride": 8, "parallel_pointer": 4}


def _positions(spark, size):
    return spark.range(size).withColumnRenamed("id", POS)


@pytest.fixture(scope="module")
def taken(spark):
    """Positions by (method, percent), from one pass."""
    rates = (1, 15, 40, 60, 99)
    flags = [F.expr(samplers.predicate(m, SIZE, p)).alias(f"{m}-{p}") for m in samplers.METHODS for p in rates]
    table = _positions(spark, SIZE).select(POS, *flags).toPandas().sort_values(POS)
    return {(m, p): table[POS].to_numpy()[table[f"{m}-{p}"].to_numpy()].tolist() for m in samplers.METHODS for p in rates}


@pytest.mark.parametrize("method", sorted(samplers.METHODS))
@pytest.mark.parametrize("percent", [1, 15, 40, 60, 99])
def test_rates_are_honoured_over_the_whole_table(taken, method, percent):
    got = taken[method, percent]
    assert abs(len(got) - SIZE * percent // 100) <= SLACK.get(method, 2)
    if method != "head":
        tenths = Counter(p * 10 // SIZE for p in got)
        slack = 75 + 2 * SLACK.get(method, 20)
        assert all(abs(tenths[k] - SIZE * percent // 1000) <= slack for k in range(10))
        assert got[0] < 100 * 150 / percent + 300 and got[-1] > SIZE - 100 * 150 / percent - 300


def test_sizes_in_closed_form(spark, taken):
    for (method, percent), got in taken.items():
        assert samplers.taken(method, SIZE, percent) in (len(got), None)
    for size in (1, 99, 250, 1037):
        for method in samplers.METHODS:
            got = _positions(spark, size).agg(*[F.count(F.when(F.expr(samplers.predicate(method, size, p)), 1)) for p in (1, 13, 60, 99)]).first()
            told = [samplers.taken(method, size, p) for p in (1, 13, 60, 99)]
            assert told in ([*got], [None] * 4)
    assert sum(samplers.taken(m, SIZE, 10) is not None for m in samplers.METHODS) > 12


def _loop(method, n, p):
    """What a plain walk over the rows takes."""
    out, due = [], 0
    if method in ("slow_pointer", "fast_pointer"):
        each = 2 if method == "fast_pointer" else 1
        for unit in range(-(-n // each)):
            due += p
            if due >= 100:
                due -= 100
                out += range(unit * each, min(n, (unit + 1) * each))
    elif method == "index":
        target = n * p // 100
        out = [j * n // target for j in range(target)]
    elif method == "block":
        rows = max(1, min(1000, n // 100))
        for start in range(0, n, rows):
            due += p
            if due >= 100:
                due -= 100
                out += range(start, min(n, start + rows))
    elif method == "parallel_pointer":
        for k in range(4):
            due = 0
            for pos in [x for x in range(n) if x * 4 // n == k]:
                due += p
                if due >= 100:
                    due -= 100
                    out.append(pos)
    elif method == "dual_pointer":
        due = slow = 0
        for pos in range(n):
            due += p
            if due >= 300:
                due -= 300
                out.append(pos)
                continue
            slow += 2 * p
            if slow >= 300 - p:
                slow -= 300 - p
                out.append(pos)
    elif method == "nth_wrap":
        start = samplers.mix(samplers.SEED) % n
        for k in range(n):
            due += p
            if due >= 100:
                due -= 100
                out.append((start + k) % n)
    return sorted(out)


@pytest.mark.parametrize("method", ["slow_pointer", "fast_pointer", "index", "block", "parallel_pointer", "dual_pointer", "nth_wrap"])
@pytest.mark.parametrize(("size", "percent"), [(997, 13), (1500, 60), (100, 33), (333, 99)])
def test_predicates_against_loops(spark, method, size, percent):
    rows = samplers.sample(_positions(spark, size), method, percent).collect()
    assert sorted(r[POS] for r in rows) == _loop(method, size, percent)


@pytest.mark.parametrize("method", sorted(samplers.METHODS))
def test_small_tables_and_whole_rates(spark, method):
    for size in (0, 1, 2, 7):
        rows = samplers.sample(_positions(spark, size), method, 10).collect()
        assert len(rows) <= size
    assert samplers.sample(_positions(spark, 7), method, 100).count() == 7


def test_seeds_change_samples(spark):
    rows = _positions(spark, 1000)
    for method in ("random_start_stride", "sequential", "jittered", "nth_wrap", "region_stride"):
        found = {tuple(sorted(r[POS] for r in samplers.sample(rows, method, 10, seed=s).collect())) for s in range(1, 6)}
        assert len(found) > 1
    a, b, again = ({r[POS] for r in samplers.random_sample(rows, 10, seed=s).collect()} for s in (1, 2, 1))
    assert a != b and a == again and len(a) == len(b) == 100


def test_random_sample_is_exact_and_spread(spark):
    for size, percent in ((5000, 13), (1, 10), (0, 10), (100, 100), (64, 50)):
        rows = samplers.random_sample(_positions(spark, size), percent).collect()
        assert len({r[POS] for r in rows}) == len(rows) == size * percent // 100
    tenths = Counter(r[POS] // 500 for r in samplers.random_sample(_positions(spark, 5000), 20).collect())
    assert all(60 <= tenths[k] <= 140 for k in range(10))


def test_hash_is_the_same_in_both_forms(spark):
    rows = spark.range(0, 10**12, 10**10).select("id", F.expr(samplers.mixed("id")).alias("h")).collect()
    assert all(r["h"] == samplers.mix(r["id"]) for r in rows)


def test_large_tables_do_not_overflow(spark):
    n = 10**13
    rows = spark.range(n - 1000, n).withColumnRenamed("id", POS)
    for method in samplers.METHODS:
        got = rows.filter(samplers.predicate(method, n, 25)).count()
        assert 0 <= got <= 1000 and (method in ("head", "segments", "block", "page", "node_skip", "parallel_block", "direct_access") or 240 <= got <= 260)


def test_positions_by_key_and_by_file(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id * 7 as k", "id as want").repartition(5)
    assert all(r[POS] == r["want"] for r in samplers.with_position(rows, "k").collect())
    rows.write.parquet(str(tmp_path / "t"))
    by_file = samplers.with_position(spark.read.parquet(str(tmp_path / "t")))
    assert "Sort" not in by_file._jdf.queryExecution().executedPlan().toString().split("Scan")[0].replace("SortMerge", "")
    assert sorted(r[POS] for r in by_file.collect()) == list(range(1000))
    assert sorted(r[POS] for r in samplers.with_position(rows).collect()) == list(range(1000))


def test_keys_that_are_not_dense(spark):
    gaps = samplers.with_position(spark.range(100).selectExpr("id * 100 as k"), "k", dense=True)
    with pytest.raises(ValueError, match="dense"):
        samplers.sample(gaps, "index", 10)
    assert samplers.sample(samplers.with_position(spark.range(0), "id", dense=True), "index", 10).count() == 0


def test_footers_tell_the_size_of_plain_parquet_tables_only(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "cast(id as int) as i", "if(id = 3, null, id) as holes", "cast(id as string) as s", "id % 2 as part")
    rows.write.parquet(f"{tmp_path}/plain")
    rows.write.partitionBy("part").parquet(f"{tmp_path}/parts")
    table = spark.read.parquet(f"{tmp_path}/plain")
    assert samplers.footers(table, "id") == samplers.footers(table, "i") == samplers.footers(table, "holes") == (1000, 0, 999)
    table.createOrReplaceTempView("plain_view")
    assert samplers.footers(spark.table("plain_view"), "id") == (1000, 0, 999)
    for other, key in ((table, "s"), (table.filter("id < 10"), "id"), (table.limit(10), "id"), (rows, "id"), (spark.read.parquet(f"{tmp_path}/parts"), "id")):
        assert samplers.footers(other, key) is None
    assert samplers.placed(table, "id")[1] == 1000 and samplers.placed(table, "id", look=False)[1] is None and samplers.placed(table)[1] == 1000
    spark.range(5, 50).write.parquet(f"{tmp_path}/late")
    late, size = samplers.placed(spark.read.parquet(f"{tmp_path}/late"), "id")
    assert size is None
    with pytest.raises(ValueError, match="dense"):
        samplers.dense_size(late)
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert samplers.placed(spark.read.parquet(f"{tmp_path}/none"), "id")[1] in (0, None)


def test_segments_are_ranges_that_parquet_can_skip(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = samplers.with_position(spark.read.parquet(str(tmp_path / "t")), "id", dense=True)
    plan = samplers.sample(rows, "segments", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan


@pytest.mark.parametrize("percent", [1, 10, 30, 55])
def test_stratified_takes_equal_systematic_shares(spark, percent):
    table = spark.range(4001).select(F.col("id").alias(POS), ((F.col("id") * 7919) % 4001).cast("double").alias("x"))
    rows = samplers.stratified_sample(table, "x", percent).collect()
    target = 4001 * percent // 100
    taken = Counter(r["stratum"] for r in rows)
    assert len(rows) == len({r[POS] for r in rows}) == target
    assert set(taken) == {0, 1, 2, 3} and max(taken.values()) - min(taken.values()) <= 1
    for k in range(4):
        assert all(k * 4001 // 4 <= r["x"] < (k + 1) * 4001 // 4 for r in rows if r["stratum"] == k)
        places = sorted(r[POS] for r in rows if r["stratum"] == k)
        assert max(b - a for a, b in zip([0, *places], [*places, 4000], strict=True)) < 2 * 4001 / len(places) + 100


def test_stratified_ties_nulls_and_names(spark):
    assert samplers.quotas([2, 100, 100, 100], 50) == [2, 16, 16, 16]
    table = spark.range(1000).select(F.col("id").alias(POS), F.when(F.col("id") < 990, 1.0).when(F.col("id") < 995, F.col("id")).alias("x"))
    rows = samplers.stratified_sample(table, "x", 30).collect()
    assert len(rows) == 300 and max(Counter(r["stratum"] for r in rows).values()) == 75
    assert samplers.stratified_sample(table.limit(0), "x", 30).count() == 0
    with pytest.raises(ValueError, match="label"):
        samplers.stratified_sample(table.withColumn("stratum", F.lit(1)), "x", 30)


def test_adaptive_blocks_with_clashing_names(spark):
    table = spark.range(5000).select(F.col("id").alias(POS), F.col("id").cast("double").alias("width"), F.lit(1.0).alias("zone"))
    rows = samplers.adaptive_block_sample(table, "width", 10)
    assert rows.columns == table.columns and 400 <= rows.count() <= 700
    assert samplers.adaptive_block_sample(table, "zone", 10).count() > 0  # no variance


def test_gather(spark):
    assert sorted(r[POS] for r in samplers.gather(_positions(spark, 50), [3, 3, 49, 50]).collect()) == [3, 49]


def test_sales_query_makes_all_rows(spark):
    assert QUERIES["sales_generator"](spark, "").count() == 100_000
