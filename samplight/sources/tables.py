"""Generated tables, table statistics, the binary record file, and a table of records that grows."""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from samplight.operators.samplers import POS, SEED, mix, with_position

RECORD = "id long, amount double, region int, product_id int, timestamp long"
#: The record file's header (records, height, records) and row, little-endian.
_HEADER, _ROW = struct.Struct("<QQQ"), struct.Struct("<qdiiq")
_NUMPY = np.dtype([("id", "<i8"), ("amount", "<f8"), ("region", "<i4"), ("product_id", "<i4"), ("timestamp", "<i8")])
#: Keys of a node, and bytes of a page of the record file.
NODE_KEYS, PAGE_BYTES = 255, 4096


def example_table(spark: SparkSession) -> DataFrame:
    """Ten rows, value = 1.5 * id."""
    return spark.range(1, 11).select("id", (F.col("id") * 1.5).alias("value"))


def sales_table(spark: SparkSession, rows: int = 100_000, seed: int = 42) -> DataFrame:
    """id from 1, amount between 1 and 1000, category A to D."""
    letters = F.array(*map(F.lit, "ABCD"))
    return spark.range(1, rows + 1).select("id", (1 + 999 * F.rand(seed)).alias("amount"), F.element_at(letters, (F.floor(F.rand(seed + 1) * 4) + 1).cast("int")).alias("category"))


def tree_height(rows: int) -> int:
    """Levels of a tree of NODE_KEYS rows a node that holds some rows; 1 at least."""
    height, room = 1, NODE_KEYS
    while room < rows:
        height, room = height + 1, room * NODE_KEYS
    return height


def statistics(table: DataFrame) -> DataFrame:
    """Rows, nodes of 255 rows, height of a tree of them and size at 32 bytes a row."""
    n = F.count(F.lit(1))
    height = F.lit(1)
    for k in range(1, 8):  # 255 ** 8 rows are more than a long counts
        height = height + F.when(n > NODE_KEYS**k, 1).otherwise(0)
    return table.agg(n.alias("total_records"), (F.floor(n / NODE_KEYS) + 1).alias("node_count"), height.alias("tree_height"), (n * _ROW.size / 1048576.0).alias("size_mb"))


def estimated_rows(path: str) -> int:
    """Rows of a record file by its size alone."""
    return max(0, (os.path.getsize(path) - _HEADER.size) // _ROW.size)


class _Ranges(InputPartition):
    """Ranges of rows (first, last and one) that one task reads."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = ranges


class _RecordReader(DataSourceReader):
    def __init__(self, path: str, rows: int, percent: int, seed: int):
        self.path, self.rows, self.percent, self.seed = path, rows, percent, seed

    def partitions(self):
        with open(self.path, "rb") as f:
            count = _HEADER.unpack(f.read(_HEADER.size))[2]
        if not 0 < self.percent < 100:
            return [_Ranges([(k, min(count, k + self.rows))]) for k in range(0, count, self.rows)] or [_Ranges([])]
        page = PAGE_BYTES // _ROW.size
        start = mix(self.seed) % 100
        pages = [k for k in range(-(-count // page)) if (k * self.percent + start) % 100 >= 100 - self.percent]
        each = max(1, self.rows // page)
        return [_Ranges([(k * page, min(count, (k + 1) * page)) for k in pages[j : j + each]]) for j in range(0, len(pages), each)] or [_Ranges([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            for first, last in partition.ranges:
                f.seek(_HEADER.size + _ROW.size * first)
                rows = np.frombuffer(f.read(_ROW.size * (last - first)), _NUMPY)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in _NUMPY.names], names=list(_NUMPY.names))


class RecordFile(DataSource):
    """Reads files of fixed 32-byte records, split by record ranges; the path must be a mounted one.

    Options: rows of one task; percent and seed of a sample of whole pages, of
    which no other page is read.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema):
        get = self.options.get
        return _RecordReader(self.options["path"], int(get("rows", 1_000_000)), int(get("percent", 0)), int(get("seed", SEED)))


def read_records(spark: SparkSession, path: str, percent: int = 0, seed: int = SEED) -> DataFrame:
    """A record file, or a sample of its pages."""
    spark.dataSource.register(RecordFile)
    return spark.read.format("records").option("percent", percent).option("seed", seed).load(path)


def _records(table: DataFrame) -> DataFrame:
    """The record's columns in order, of its types."""
    return table.select(*[F.col(name).cast(kind) for name, kind in (field.split() for field in RECORD.split(", "))])


def write_records(table: DataFrame, path: str) -> int:
    """Write a record file by id; returns the number of records.

    Every task writes its rows at their place in the file, which lies on a path
    that the driver and all executors have mounted. A task that is run again
    writes the same bytes.
    """
    placed = with_position(_records(table), "id")
    count = placed.count()
    with open(path, "wb") as f:
        f.write(_HEADER.pack(count, tree_height(count), count))
        f.truncate(_HEADER.size + _ROW.size * count)
    header, names, kind = _HEADER.size, list(_NUMPY.names), _NUMPY

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                rows = np.zeros(b.num_rows, kind)
                for c in names:
                    rows[c] = b.column(c).to_numpy(zero_copy_only=False)
                at = b.column(POS).to_numpy()
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    f.seek(header + kind.itemsize * int(at[run[0]]))
                    f.write(rows[run].tobytes())
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return placed.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def file_aggregate(spark: SparkSession, path: str, agg: str = "sum", percent: int = 10, seed: int = SEED) -> DataFrame:
    """value and n of the amounts of a record file, from a sample of its pages; sums and counts scaled to all records."""
    total = estimated_rows(path)
    rows = read_records(spark, path, percent, seed)
    n = F.count("amount")
    value = {"sum": F.sum("amount") * total / F.nullif(n, F.lit(0)), "avg": F.avg("amount"), "count": F.lit(float(total))}[agg]
    return rows.agg(value.cast("double").alias("value"), n.alias("n"))


class RecordStore:
    """A table of records in a folder of Parquet files that rows are added to.

    Every insert is one append; readers see whole files only. Rows are sorted by
    id inside a file, so that ranges of ids skip row groups.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.is_open = spark, path, False

    def create_database(self) -> RecordStore:
        """An empty table; what was there goes."""
        self.spark.createDataFrame([], RECORD).write.mode("overwrite").parquet(self.path)
        return self.open_database()

    def open_database(self) -> RecordStore:
        try:
            self.spark.read.schema(RECORD).parquet(self.path)
        except AnalysisException as e:
            raise FileNotFoundError(self.path) from e
        self.is_open = True
        return self

    def close_database(self) -> None:
        self.is_open = False

    def table(self) -> DataFrame:
        if not self.is_open:
            raise RuntimeError("the table isn't open")
        return self.spark.read.schema(RECORD).parquet(self.path)

    def insert_record(self, id: int, amount: float, region: int, product_id: int, timestamp: int) -> None:  # noqa: A002
        self.insert_batch(self.spark.createDataFrame([(id, float(amount), region, product_id, timestamp)], RECORD))

    def insert_batch(self, rows: DataFrame) -> None:
        if not self.is_open:
            raise RuntimeError("the table isn't open")
        _records(rows).sortWithinPartitions("id").write.mode("append").parquet(self.path)

    def search_range(self, low: int, high: int) -> DataFrame:
        return self.table().filter(F.col("id").between(low, high))

    def get_total_records(self) -> int:
        return self.table().count()

    def get_tree_height(self) -> int:
        return tree_height(self.get_total_records())

    def get_node_count(self) -> int:
        return math.floor(self.get_total_records() / NODE_KEYS) + 1

    def get_database_size_mb(self) -> float:
        return self.get_total_records() * _ROW.size / 2**20

    def sum_amount(self) -> float:
        return self.table().agg(F.coalesce(F.sum("amount"), F.lit(0.0))).first()[0]

    def avg_amount(self) -> float:
        return self.table().agg(F.coalesce(F.avg("amount"), F.lit(0.0))).first()[0]

    def sum_amount_where(self, low: float, high: float) -> float:
        return self.table().filter(F.col("amount").between(low, high)).agg(F.coalesce(F.sum("amount"), F.lit(0.0))).first()[0]

    def save_to_file(self, path: str) -> int:
        return write_records(self.table(), path)

    def load_from_file(self, path: str) -> int:
        """Add the records of a record file; returns how many."""
        rows = read_records(self.spark, path)
        self.insert_batch(rows)
        return rows.count()
