import pytest

from samplight import cli
from samplight.sources import tables


def _records(spark, n):
    return spark.range(n).selectExpr("id", "id * 0.5 as amount", "cast(id % 4 as int) as region", "cast(id as int) as product_id", "id as timestamp")


def test_record_file(spark, tmp_path):
    rows, path = _records(spark, 1000).repartition(3), str(tmp_path / "r.bin")
    assert tables.write_records(rows, path) == 1000 == tables.estimated_rows(path)
    assert tables.read_records(spark, path).orderBy("id").collect() == rows.orderBy("id").collect()
    pages = sorted(r["id"] // 128 for r in tables.read_records(spark, path, 30).collect())
    assert 0 < len(pages) < 1000 and all(pages.count(k) == min(128, 1000 - 128 * k) for k in set(pages))
    assert tables.file_aggregate(spark, path, "sum", 0).first()["value"] == sum(i * 0.5 for i in range(1000))
    assert tables.file_aggregate(spark, path, "count", 30).first()["value"] == 1000.0
    assert tables.write_records(rows.limit(0), path) == 0 and tables.read_records(spark, path).count() == 0
    assert tables.file_aggregate(spark, path).first()["value"] is None


def test_record_store(spark, tmp_path):
    store = tables.RecordStore(spark, str(tmp_path / "db"))
    with pytest.raises(RuntimeError):
        store.table()
    with pytest.raises(FileNotFoundError):
        store.open_database()
    store.create_database()
    assert (store.sum_amount(), store.avg_amount(), store.get_total_records(), store.get_tree_height(), store.get_node_count()) == (0.0, 0.0, 0, 1, 1)
    store.insert_batch(_records(spark, 300))
    store.insert_record(500, 7, 1, 2, 3)
    assert store.get_total_records() == 301 and store.get_tree_height() == 2 and store.get_node_count() == 2
    assert store.sum_amount() == 150 * 299 / 2 + 7 and store.sum_amount_where(1, 2) == 1 + 1.5 + 2
    assert [r["id"] for r in store.search_range(299, 600).orderBy("id").collect()] == [299, 500]
    path = str(tmp_path / "copy.bin")
    assert store.save_to_file(path) == 301
    store.close_database()
    other = tables.RecordStore(spark, str(tmp_path / "other")).create_database()
    assert other.load_from_file(path) == 301 and other.sum_amount() == store.open_database().sum_amount()
    assert other.get_database_size_mb() == pytest.approx(301 * 32 / 2**20)


def test_statistics(spark):
    assert [tables.tree_height(n) for n in (0, 255, 256, 255**2, 255**2 + 1)] == [1, 1, 2, 2, 3]
    r = tables.statistics(spark.range(65_026)).first()
    assert (r["total_records"], r["node_count"], r["tree_height"]) == (65_026, 256, 3)


def test_command_line(spark, tmp_path, capsys):
    spark.range(2000).selectExpr("id", "cast(id as double) as v", "id % 2 as g").write.parquet(str(tmp_path / "sales.parquet"))
    spark.range(2).selectExpr("id as g", "id as w").write.parquet(str(tmp_path / "dims.parquet"))
    run = lambda *a: (cli.main([*a, "--tables", str(tmp_path)]), capsys.readouterr().out)[1]
    assert "value = 1999000.0" in run("SELECT SUM(v) FROM sales")
    out = run("SELECT SUM(v) FROM sales", "-s", "10", "--ci", "--compare", "--key", "id", "--method", "block", "--threads", "4")
    assert "BLOCK_SAMPLE: 10 % of rows, block" in out and "error " in out and "speedup" in out and "ci_lower" in out and "try --method clt" in out
    assert "CLT: 15 % of rows, sequential" in run("SELECT SUM(v) FROM sales", "--e", "2")
    assert "EMBEDDED: 15 % of rows" in run("SELECT APPROX_SUM(v, 15) FROM sales")
    assert "RANDOM_SAMPLE: 10 %" in run("SELECT AVG(v) FROM sales", "--s", "10")
    out = run("SELECT COUNT(*) FROM sales GROUP BY g", "--sample", "50", "--method", "parallel", "--explain")
    assert out.count("g = ") == 2 and "Physical Plan" in out
    assert "value = 999000.0" in run("SELECT SUM(v) FROM sales JOIN dims ON sales.g = dims.g WHERE w = 0")
    assert cli.main(["--methods"]) == 0 and "segments" in capsys.readouterr().out
    for bad in (["SELECT a FROM t", "--tables", "x"], ["SELECT SUM(v) FROM sales"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    assert [cli.format_time(s) for s in (0.25, 2.5)] == ["250 ms", "2.50 s"]
