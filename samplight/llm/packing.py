"""Packing documents into sequences: first-fit decreasing in random groups.

A document's ids (with one end id) are cut every ``width``; the full pieces
are sequences of their own and the rests are packed. Pieces are dealt into
groups of about GROUP_PIECES by a hash of their place in the staged table; each group is packed by first-fit
decreasing, where a tournament tree over the free room of the group's bins
finds the first bin that a piece fits in with one walk from the root.

Edge cases: null and empty texts are one piece of the end id; an empty table
gives an empty result; rows that repeat a document are packed each; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import map_arrow, ship, stage, text_slices
from samplight.llm.tokens import default_vocabulary, library_encoder

WIDTH = 2048
END_ID = 1
#: Pieces in a group, on average: what one call packs in memory.
GROUP_PIECES = 4096
#: Words whose ids a worker keeps.
STORE_WORDS = 200_000
#: Text bytes that one step of cutting works on.
CUT_BYTES = 3 << 20


class Tournament:
    """Free room of up to n bins; each inner node holds the larger of its two."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put size in the first bin that has room: (bin, room it had)."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        had = most[node]
        most[node] = had - size
        at = node >> 1
        while at:
            most[at] = max(most[2 * at], most[2 * at + 1])
            at >>= 1
        return node - self.leaves, had


def first_fit_decreasing(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces given in descending order of length."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    if len(lengths):
        tree = Tournament(len(lengths), width)
        for k, size in enumerate(lengths.tolist()):
            bins[k], had = tree.place(size)
            offsets[k] = width - had
    return bins, offsets


def _cut(vocabulary: str, end_id: int, width: int, store_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary, store_words)
        for batch in batches:
            for rows in text_slices(batch, limit=CUT_BYTES):
                flat, offsets = encoder.batch(rows.column("text"))
                sizes = np.diff(offsets) + 1
                data = memoryview(np.insert(flat, offsets[1:], end_id).astype("<u4").tobytes())
                n_pieces = -(-sizes // width)
                row = np.repeat(np.arange(len(sizes)), n_pieces)
                starts = (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * width
                lengths = np.minimum(width, sizes[row] - starts)
                at = (np.cumsum(sizes) - sizes)[row] + starts
                sums = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64()), pa.array(sizes[row])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pack(width: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), width)
        group = group.drop_columns(["pack_group"])
        return group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, width: int = WIDTH, vocabulary: str | None = None, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, store_words: int = STORE_WORDS) -> DataFrame:
    """One row for each piece: its document's part and its place in a sequence.

    Only the pieces' numbers are shuffled, never ids or texts.
    """
    ship(docs.sparkSession)
    pieces = stage(map_arrow(docs.select("doc_id", "text"), _cut(vocabulary or default_vocabulary(), end_id, width, store_words), PIECES), "pieces")
    groups = -(-max(1, pieces.count()) // group_pieces)
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # the row's own place: equal rows are spread
    return dealt.groupBy("pack_group").applyInArrow(_pack(width), f"{PIECES}, sequence_id long, offset long")
