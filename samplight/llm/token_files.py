"""Token files of directly addressable codes, in ascending doc_id order.

A file holds blocks, each with the ids of consecutive documents as one string of
bytes::

    b"DAC1" | u8 levels | u64 n_ids | for each level: u64 n_chunks |
        for each level: chunk bytes | continuation bitmap | rank directory

Level k holds byte k of every id that has one. The bitmap (absent on the last
level) says which chunks go on; the rank directory counts its set bits before
every 512th, so that id i is found with one directory entry and at most 64
bitmap bytes for each level, without decoding the rest of the block.

The container is Parquet without compression, with one row group and one page a
block, so that a block's bytes lie in the file as they are; an index table says
at which id of all each block begins and in which file it lies. ``TokenFiles``
reads any id of all with some ranges of bytes: the file's footer once, the
block's head once, and some dozen bytes an id.

Texts are dealt out by ranges of (doc_id, hash of the text, place in the input),
so that rows that repeat a doc_id can be split, and encoded in that order.
(Encoded first, the ids that are shuffled have about the size of the texts.)

Edge cases: null and empty texts give the end id alone; an empty table gives
files without blocks; a null doc_id sorts first; rows that repeat a doc_id are
written one after the other in order of the hash of their text, equal ones may
be in several files.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplight.llm.common import map_arrow, shared_dir, text_hash, text_slices
from samplight.llm.tokens import default_vocabulary, library_encoder

MAGIC = b"DAC1"
#: Bits between two entries of a rank directory.
RANK_BITS = 512
#: Ids after which a block ends (at the end of a document).
BLOCK_IDS = 1 << 20
END_ID = 2

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    """The block of some ids (unsigned, up to 32 bits)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        levels.append(((rest & np.uint32(255)).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<BQ", len(levels), len(ids)) + b"".join(struct.pack("<Q", len(c)) for c, _ in levels)
    body = []
    for k, (chunks, more) in enumerate(levels):
        body.append(chunks.tobytes())
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            ones = np.concatenate(([0], np.cumsum(_ONES[bits], dtype=np.int64)))
            body += [bits.tobytes(), ones[:-1][:: RANK_BITS // 8].astype("<u4").tobytes()]
    return head + b"".join(body)


class DacReader:
    """Random and sequential access to a block."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_levels, self.n_ids = struct.unpack_from("<BQ", block, 4)
        counts = struct.unpack_from(f"<{n_levels}Q", block, 13)
        at = 13 + 8 * n_levels
        self.levels = []
        for k, n in enumerate(counts):
            chunks = np.frombuffer(block, np.uint8, n, at)
            at += n
            bits = ranks = None
            if k < n_levels - 1:
                n_bytes = (n + 7) // 8
                bits = np.frombuffer(block, np.uint8, n_bytes, at)
                at += n_bytes
                n_ranks = -(-n_bytes // (RANK_BITS // 8))
                ranks = np.frombuffer(block, "<u4", n_ranks, at)
                at += 4 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        """Id i, from one chunk a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            word = i // RANK_BITS
            whole = bits[word * RANK_BITS // 8 : i >> 3]
            i = int(ranks[word]) + int(_ONES[whole].sum()) + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if bits is not None:
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = here
        return out


class DacRanges:
    """Random access to a block through read(first byte, number of bytes), which is called for what is needed only."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, n_levels, self.n_ids = struct.unpack("<4sBQ", read(0, 13))
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        counts = struct.unpack(f"<{n_levels}Q", read(13, 8 * n_levels))
        at, self.levels = 13 + 8 * n_levels, []
        for k, n in enumerate(counts):
            n_bytes = (n + 7) // 8 if k < n_levels - 1 else 0
            self.levels.append((at, at + n, at + n + n_bytes))  # chunks, bitmap, directory
            at += n + n_bytes + 4 * -(-n_bytes // (RANK_BITS // 8))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << (8 * k)
            if k == len(self.levels) - 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            bits = self.read(bitmap + first, (i >> 3) - first + 1)
            if not bits[-1] >> (i & 7) & 1:
                break
            before = int.from_bytes(bits, "little") & ((1 << (i % RANK_BITS)) - 1)
            i = struct.unpack("<I", self.read(directory + 4 * (i // RANK_BITS), 4))[0] + before.bit_count()
        return value


def _write_blocks(vocabulary: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(vocabulary), TaskContext.get().partitionId()
        seq = start = held = 0
        docs, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, docs, lengths, ids, held
            block = dac_encode(np.concatenate(ids))
            row = {
                "part": [part], "seq": [seq], "part_start": [start], "n_ids": [held], "n_bytes": [len(block)],
                "doc_ids": [docs], "doc_lengths": [np.concatenate(lengths).tolist()], "block": [block],
            }
            seq, start = seq + 1, start + held
            docs, lengths, ids, held = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for batch in batches:
            for rows in text_slices(batch):
                flat, offsets = encoder.batch(rows.column("text"))
                ids.append(np.insert(flat, offsets[1:], end_id))
                docs += rows.column("doc_id").to_pylist()
                lengths.append(np.diff(offsets) + 1)
                held += len(ids[-1])
                if held >= block_ids:
                    yield flush()
        if held:
            yield flush()

    return run


_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("block", pa.binary()),
])
SCHEMA = "part int, seq long, part_start long, n_ids long, n_bytes long, doc_ids array<long>, doc_lengths array<long>, block binary"
#: Parquet as it is written: one row group, one page a block, the bytes as they are.
CONTAINER = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.row.count.limit": "1", "maxRecordsPerFile": "0"}


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs and write their ids under path/blocks in ascending doc_id order by (part, seq), and path/index.

    The driver sees one count for each partition that was written.
    """
    named = docs.select("doc_id", "text", text_hash(F.col("text")).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "tie", "place"]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = map_arrow(ordered, _write_blocks(vocabulary or default_vocabulary(), end_id, block_ids), SCHEMA)
    written.write.options(**CONTAINER).parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.schema(SCHEMA).parquet(f"{path}/blocks")
    starts, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]
    base = F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in starts.items() for x, t in ((k, "int"), (v, "long"))]), F.col("part")) if starts else F.lit(0)
    first = (base + F.col("part_start")).cast("long").alias("first")
    blocks.select(first, "part", "seq", "n_ids", "n_bytes", F.col("_metadata.file_path").alias("file")).sortWithinPartitions("first").write.parquet(f"{path}/index")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            doc_ids, lengths = batch.column("doc_ids")[r].values, batch.column("doc_lengths")[r].values
            ids = DacReader(batch.column("block")[r].as_buffer().to_pybytes()).all().astype("<u4")
            lengths = lengths.to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            data = memoryview(ids.tobytes())
            sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            first = batch.column("first")[r].as_py()
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks").select("part", "part_start", "doc_ids", "doc_lengths", "block")
    bases = spark.read.parquet(f"{path}/index").filter("seq = 0").select("part", F.col("first").alias("base"))  # a row for each file
    blocks = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("first"), "doc_ids", "doc_lengths", "block")
    return map_arrow(blocks, _read_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")


class _Stream(io.RawIOBase):
    """A file of any store that Spark can open, read on the driver; counts the bytes."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size, self.at, self.count = store.getFileStatus(where).getLen(), 0, 0
        self.stream, self.bytes_of = store.open(where), jvm.org.apache.commons.io.IOUtils.toByteArray

    def range(self, first: int, n: int) -> bytes:
        self.stream.seek(first)
        self.count += n
        return bytes(self.bytes_of(self.stream, n)) if n else b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(n if n >= 0 else self.size, self.size - self.at)
        data = self.range(self.at, n)
        self.at += n
        return data


class TokenFiles:
    """Any id of all files by its number, from some dozen bytes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index = spark, spark.read.parquet(f"{path}/index")
        self._open: dict[str, tuple[_Stream, pq.FileMetaData]] = {}
        self._blocks: dict[tuple[str, int], DacRanges] = {}
        self._known: list[tuple[int, int, str, int, int]] = []

    @property
    def bytes_read(self) -> int:
        """Of the files with blocks, footers included."""
        return sum(s.count for s, _ in self._open.values())

    def _block(self, i: int) -> tuple[int, DacRanges]:
        found = next((k for k in self._known if k[0] <= i < k[0] + k[1]), None)
        if found is None:
            rows = self.index.filter((F.col("first") <= i) & (F.col("first") + F.col("n_ids") > i)).select("first", "n_ids", "file", "seq", "n_bytes").take(1)
            if i < 0 or not rows:
                raise IndexError(i)
            found = tuple(rows[0])
            self._known.append(found)
        first, _, file, seq, n_bytes = found
        if file not in self._open:
            stream = _Stream(self.spark, file)
            self._open[file] = (stream, pq.read_metadata(stream))
        stream, meta = self._open[file]
        if (file, seq) not in self._blocks:
            group = meta.row_group(seq)
            chunk = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "block")
            begin = chunk.data_page_offset + chunk.total_compressed_size - n_bytes  # the block's bytes end its page
            self._blocks[file, seq] = DacRanges(lambda at, n: stream.range(begin + at, n))
        return first, self._blocks[file, seq]

    def token_at(self, i: int) -> int:
        first, block = self._block(i)
        return block[i - first]


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary)
    return read_token_files(spark, path)
