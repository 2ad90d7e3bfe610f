"""What the operators share: staged tables, shipping the package, word splitting.

White space is ``[\\x20\\x09-\\x0D]`` everywhere in this folder; a *word* is a
maximal run of other characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Text bytes that one vectorised step works on; what bounds a worker's memory.
SLICE_BYTES = 7 << 20

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.

    Where that is unset, a temporary folder in local mode (one machine) and
    the warehouse otherwise; a machine-local folder is never used on a cluster.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if sc.applicationId not in _OWN_DIRS:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="staged-")
        else:
            _OWN_DIRS[sc.applicationId] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return _OWN_DIRS[sc.applicationId]


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and return the table.

    Lineage is cut there: a lost executor costs only the tasks it ran, never
    what was staged before. A lazy result may still read its tables, so they stay
    until release() or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _note_staged(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: set[str] = set()


def _note_staged(spark: SparkSession) -> None:
    """Have this application's staged tables removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED.add(app)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{app}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that this application staged; results that aren't written yet can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that Python functions find it wherever it was imported from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # itself run from an archive
        return
    name = os.path.basename(top)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for base, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    folder = tempfile.mkdtemp(prefix="ship-")
    path = os.path.join(folder, f"{name}_package.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the package shipped; a worker returns the memory it freed after each task."""
    ship(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What this worker process keeps between tasks: one costly object, the last asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


#: Rows to drop that may be broadcast (16 bytes each); more of them meet the documents in a shuffle.
BROADCAST_LOST = 1_000_000


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from the columns of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text_hash (that of text_hash()) are in lost; all columns as they were."""
    key, digest = free_names(docs, "lost_id", "lost_hash")
    lost = stage(lost.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct(), "lost")
    if lost.count() <= BROADCAST_LOST:
        lost = F.broadcast(lost)
    return docs.join(lost, docs["doc_id"].eqNullSafe(F.col(key)) & (text_hash(docs["text"]) == F.col(digest)), "left_anti")


def one_of_each(docs: DataFrame, same: DataFrame) -> DataFrame:
    """docs with one row only of those that share a group in same (doc_id, text_hash, group); all columns as they were.

    Of a group the row stays that is least over its columns in turn (those that have an order).
    """
    key, digest, group, whole = free_names(docs, "same_id", "same_hash", "same_group", "same_row")
    same = stage(same.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("group").alias(group)).distinct(), "same")
    n = same.count()
    if not n:
        return docs
    if n <= BROADCAST_LOST:
        same = F.broadcast(same)
    marked = docs.join(same, docs["doc_id"].eqNullSafe(F.col(key)) & (text_hash(docs["text"]) == F.col(digest)), "left")
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = marked.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias(whole))
    return marked.filter(F.col(group).isNull()).select(*columns).unionAll(least.select(f"{whole}.*"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean_worker() -> None:
    """Let this worker process give freed Arrow memory back at once."""
    pa.set_memory_pool(pa.system_memory_pool())


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of about limit text bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    bins = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
    for a, b in itertools.pairwise(cuts):
        yield batch.slice(a, b - a)


def plain_strings(column: pa.Array) -> pa.Array:
    """Null as empty, offsets of the array's own."""
    return pa.concat_arrays([pc.fill_null(column, "")])


class Words:
    """The words of some texts: codes[offsets[i]:offsets[i+1]] index uniq for text i."""

    __slots__ = ("codes", "offsets", "uniq")

    def __init__(self, column: pa.Array, lower: bool = False, fold: bool = False):
        """lower: A-Z in lower case; fold: that for all-ASCII words without "<|" only."""
        texts = plain_strings(column)
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        if fold:
            plain = pc.string_is_ascii(flat)
            if pc.any(pc.match_substring(texts, "<|")).as_py():
                plain = pc.and_(plain, pc.invert(pc.match_substring(flat, "<|")))
            flat = pc.if_else(plain, pc.ascii_lower(flat), flat)
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        encoded = flat.dictionary_encode()
        codes = np.asarray(encoded.indices, dtype=np.int64)
        self.uniq = encoded.dictionary
        empty = np.asarray(pc.equal(self.uniq, ""))
        if empty.any():
            there = ~empty[codes]
            offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
            codes = codes[there]
        self.codes, self.offsets = codes, offsets

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        """Sums over each text of a value for each distinct word."""
        sums = np.concatenate((np.zeros((1, *of_word.shape[1:])), np.cumsum(of_word[self.codes], axis=0)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i]+lengths[i]] of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (splitmix64), elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, vectorised over the array's bytes.

    A polynomial over a random byte table modulo 2**64, from prefix sums and
    inverse powers, mixed with the length.
    """
    column = pa.concat_arrays([column])
    if not len(column):
        return np.empty(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[: len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    table = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    length = len(data) + 1
    powers, inverse = np.ones(length, np.uint64), np.ones(length, np.uint64)
    with np.errstate(over="ignore"):
        if length > 1:
            powers[1:] = np.uint64(base)
            inverse[1:] = np.uint64(pow(base, -1, 2**64))
            np.multiply.accumulate(powers, out=powers)
            np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(length, np.uint64)
        np.cumsum(table[data] * powers[:-1], out=sums[1:])
        raw = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
        return mix64(raw + np.diff(offsets).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
