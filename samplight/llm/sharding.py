"""Contiguous shards of equal bytes, from global prefix sums of sizes.

The law is ``bytes``: documents in ascending doc_id order (ties by checksum and
size), shard cuts at equal shares of all bytes, so that two shards differ by
the size of one document at most. Copies of a text are not kept together: they
may hold a third of all bytes, which no equal share could take.

Edge cases: a null text has size 8 and checksum 0; a null doc_id sorts first;
repeated rows are each placed; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import map_arrow, stage

SHARDS = 24
#: Bytes that each document takes beside its text.
OVERHEAD = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the rows and bytes before them in it."""
    part = TaskContext.get().partitionId()
    rows = total = 0
    for b in batches:
        sizes = b.column("size").to_numpy(zero_copy_only=False)
        sums = np.cumsum(sizes)
        n = b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(rows + np.arange(n, dtype=np.int64)), pa.array(total + sums - sizes)],
                names=[*b.schema.names, "part", "rows_before", "bytes_before"],
            )
            rows, total = rows + n, total + int(sums[-1])


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The driver sees one total for each partition, and one first row for each
    shard; documents travel as (doc_id, size, checksum) only.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ordered = stage(narrow, "shard-sizes").repartitionByRange("doc_id", "text_crc32", "size").sortWithinPartitions("doc_id", "text_crc32", "size")
    placed = stage(map_arrow(ordered, _running, "doc_id long, size long, text_crc32 long, part int, rows_before long, bytes_before long"), "shard-prefix")
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
    totals.sort(key=lambda r: r["part"])
    base, rows, size = [], 0, 0
    for r in totals:
        base.append((r["part"], rows, size))
        rows, size = rows + r["rows"], size + r["bytes"]
    bases = spark.createDataFrame(base, "part int, part_rows long, part_bytes long")
    middle = F.col("bytes_before") + F.col("part_bytes") + F.expr("size div 2")
    share = F.least(F.floor(middle * F.lit(shards) / F.lit(max(size, 1)).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1))
    rows_all = placed.join(F.broadcast(bases), "part").select(  # one row for each partition
        "doc_id", "size", "text_crc32", share.alias("shard"), (F.col("rows_before") + F.col("part_rows")).alias("row")
    )
    first = {r["shard"]: r["row"] for r in rows_all.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in sorted(first.items()) for x, t in ((k, "int"), (v, "long"))]), F.col("shard")) if first else F.lit(0).cast("long")
    return rows_all.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
