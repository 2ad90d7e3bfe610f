"""Prediction by partial matching over running texts, pretrained on the corpus.

A text is its words (runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z
in lower case), each ended by a space, and one end (a line feed), as one
sequence of bytes after ORDER line feeds. The context of a byte is the ORDER
bytes before it, across words, with escapes (distinct followers over followers
plus distinct) through every order down to none, where the symbols seen in the
longer context are excluded; the last resort is uniform.

A byte after its context is a *gram*: one number, the nearest byte of the
context in the highest place, so that sorted grams are the context trie and
grams that share their nearest bytes lie together. Documents are read in blocks.
A block's distinct grams and how often they were learnt are dealt into buckets
by the nearest NEAR bytes of the context; a bucket therefore has all grams that
the orders above NEAR need, and the orders below (256 ** NEAR grams at most,
whatever the input) are broadcast.

1. The blocks' parts of a bucket are merged one after the other, in groups
   first, then the groups: a task holds one bucket's distinct grams.
2. The merged bucket meets the blocks' parts again, dealt with copies of it by
   groups of blocks; each part gets a logarithm a gram and goes back to its block.
3. The block's grams are looked up among its distinct ones and summed by text.

Words, for the base score, go the same way, in buckets of their own by a hash of
the word: a part is a list of distinct words with their counts, and gets the
whole corpus's counts back. Nothing but their sums goes to the driver.

Edge cases: null and empty texts are one end; a null doc_id is never held out;
rows that repeat a document are scored, and learnt from, each; without training
documents counts are 0 and the model is uniform; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import Words, hash_strings, map_arrow, mix64, ragged_take, ship, stage, text_slices

#: Bytes of the longest context; 6 at most, as a gram with a mark is a long.
ORDER = 5
#: Bytes of context that a bucket's grams share, so that orders below it are broadcast: 256 ** NEAR grams at most.
NEAR = 3
#: Text bytes of one block, about.
BLOCK_BYTES = 8 << 20
#: Buckets of grams, and as many of words, at least and at most; between them as many as there are blocks.
BUCKETS = (64, 4_096)
#: Blocks whose parts of a bucket one task takes.
GROUP_BLOCKS = 64
#: Grams that are merged, and that are looked up, at a time.
MERGE, LOOKUP = 1 << 21, 1 << 20
END = 0x0A
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1, false)"


def grams_of(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each byte, first byte of each text)."""
    spaced = pa.concat_arrays([pc.binary_join_element_wise(words.uniq, "", " ")])
    at = np.frombuffer(spaced.buffers()[1], np.int32)[: len(spaced) + 1].astype(np.int64) if len(spaced) else np.zeros(1, np.int64)
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8) if len(spaced) else np.zeros(0, np.uint8)
    sizes = np.diff(at)[words.codes]
    ends = np.concatenate(([0], np.cumsum(sizes)))[words.offsets]
    lengths = np.diff(ends) + 1  # with the end
    firsts = np.concatenate(([0], np.cumsum(lengths)))
    padded = np.full(int(firsts[-1]) + order * len(lengths), END, np.uint8)
    own = np.ones(len(padded), bool)
    starts = firsts[:-1] + order * np.arange(len(lengths))
    for k in range(order):
        own[starts + k] = False
    inner = own.copy()
    inner[starts + order + lengths - 1] = False
    padded[inner] = ragged_take(data, at[:-1][words.codes], sizes)
    del inner
    if not len(lengths):
        return np.zeros(0, np.int64), firsts
    out = padded[order:].astype(np.int64)
    for k in range(1, order + 1):
        out |= padded[order - k : len(padded) - k].astype(np.int64) << (8 * (order - k + 1))
    return out[own[order:]], firsts


def bucket_of(grams: np.ndarray, order: int, buckets: int) -> np.ndarray:
    return (mix64((grams >> (8 * (order - NEAR + 1))).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def squeeze(numbers: np.ndarray) -> bytes:
    """An array in few bytes: its bytes by place, compressed."""
    raw = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()
    return struct.pack("<Q", len(numbers)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expand(data: bytes, kind: type) -> np.ndarray:
    (n,), size = struct.unpack_from("<Q", data), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data[8:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def squeeze_sorted(numbers: np.ndarray) -> bytes:
    return squeeze(np.diff(numbers, prepend=0))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.int64))


def squeeze_words(words: pa.Array) -> bytes:
    """Words in few bytes; they have no line feeds."""
    raw = "\n".join(words.to_pylist()).encode()
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expand_words(data: bytes) -> pa.Array:
    raw = pa.Codec("zstd").decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True)
    ends = np.flatnonzero(np.frombuffer(raw + b"\n", np.uint8) == END)
    sizes = np.diff(ends, prepend=-1) - 1
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw.replace(b"\n", b""))).cast(pa.string())


_ROWS = pa.schema([
    ("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()),
    ("bucket", pa.int32()), ("keys", pa.binary()), ("times", pa.binary()),
])
ROWS = "block long, row long, doc_id long, held_out boolean, text string, bucket int, keys binary, times binary"


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


def _parts(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket, (bucket, first, last and one) of each in it)."""
    place = np.argsort(buckets, kind="stable")
    ranked = buckets[place]
    cuts = [0, *(np.flatnonzero(np.diff(ranked)) + 1).tolist(), len(ranked)]
    return place, [(int(ranked[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def word_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """Buckets of words come after those of grams."""
    return (hash_strings(words) % np.uint64(buckets)).astype(np.int64) + buckets


def _used(words: Words) -> np.ndarray:
    """The distinct words that occur."""
    return np.flatnonzero(np.bincount(words.codes, minlength=len(words.uniq)))


def _blocks(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block a row a document, and one a bucket with its grams or words."""
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, limit=BLOCK_BYTES):
                n, block = rows.num_rows, (part << 32) + seq
                seq += 1
                yield _batch(n, block=pa.array(np.full(n, block)), row=pa.array(np.arange(n)), doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), text=rows.column("text"))
                words = Words(rows.column("text"), lower=True)
                train = ~np.asarray(rows.column("held_out"))
                out = []
                used = _used(words)
                if len(used):
                    counts = np.bincount(words.codes[np.repeat(train, np.diff(words.offsets))], minlength=len(words.uniq))[used]
                    own = words.uniq.take(pa.array(used))
                    place, cuts = _parts(word_bucket(own, buckets))
                    own, counts = own.take(pa.array(place)), counts[place]
                    out += [(k, squeeze_words(own.slice(a, b - a)), squeeze(counts[a:b])) for k, a, b in cuts]
                    del own, counts
                marked, firsts = grams_of(words, order)
                del words
                marked <<= 1
                marked |= np.repeat(train, np.diff(firsts))
                marked.sort()
                begins = np.flatnonzero(np.concatenate(([True], marked[1:] >> 1 != marked[:-1] >> 1)))
                grams = marked[begins] >> 1
                times = np.add.reduceat(marked & 1, begins)
                del marked, begins
                place, cuts = _parts(bucket_of(grams, order, buckets))
                grams, times = grams[place], times[place]
                out += [(k, squeeze_sorted(grams[a:b]), squeeze(times[a:b])) for k, a, b in cuts]
                which, packed, often = zip(*out, strict=True)
                yield _batch(len(out), block=pa.array(np.full(len(out), block)), bucket=pa.array(which, pa.int32()), keys=pa.array(packed, pa.binary()), times=pa.array(often, pa.binary()))

    return run


def _sum_equal(grams: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted grams and their summed times."""
    all_grams, all_times = np.concatenate(grams), np.concatenate(times)
    order = np.argsort(all_grams, kind="stable")
    all_grams, all_times = all_grams[order], all_times[order]
    begins = np.flatnonzero(np.concatenate(([True], all_grams[1:] != all_grams[:-1]))) if len(all_grams) else np.zeros(0, np.int64)
    return all_grams[begins], np.add.reduceat(all_times, begins) if len(begins) else all_times


def _sum_equal_words(words: list[pa.Array], times: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    encoded = pa.concat_arrays(words).dictionary_encode()
    return encoded.dictionary, np.bincount(np.asarray(encoded.indices), np.concatenate(times), len(encoded.dictionary)).astype(np.int64)


def _merge(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a bucket (and group) with what was learnt, from rows sorted by both."""
        key, keys, times, held = None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                k, t = (_sum_equal_words if key[0] >= buckets else _sum_equal)(keys, times)
                if len(k):
                    packed = squeeze_words(k) if key[0] >= buckets else squeeze_sorted(k)
                    row = {"bucket": pa.array([key[0]], pa.int32()), "keys": pa.array([packed], pa.binary()), "times": pa.array([squeeze(t)], pa.binary()), "distinct": [len(k)], "total": [int(t.sum())]}
                    yield pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for bucket, group, k, t in zip(*(batch.column(c) for c in ("bucket", "group", "keys", "times")), strict=True):
                if (bucket.as_py(), group.as_py()) != key:
                    yield from flush()
                    key, keys, times, held = (bucket.as_py(), group.as_py()), [], [], 0
                t = expand(t.as_py(), np.int64)
                learnt = t > 0
                k = expand_words(k.as_py()).filter(pa.array(learnt)) if key[0] >= buckets else expand_sorted(k.as_py())[learnt]
                keys.append(k)
                times.append(t[learnt])
                held += len(k)
                if held > MERGE and len(keys) > 1:
                    k, t = (_sum_equal_words if key[0] >= buckets else _sum_equal)(keys, times)
                    keys, times, held = [k], [t], 0
        yield from flush()

    return run


def shorten(grams: np.ndarray, order: int, to: int) -> np.ndarray:
    """Grams of an order as those of a shorter one: without the farthest bytes of the context."""
    return (grams >> (8 * (order - to + 1)) << 8) | (grams & 255)


class Levels:
    """Counts of some orders; chance() goes down from the longest to the ones below, and to uniform."""

    def __init__(self, below: Levels | None = None):
        self.below = below
        self.first = below.first + len(below.tables) if below else 0  # the shortest order here
        self.tables: list[tuple[np.ndarray, ...]] = []

    def build(self, grams: np.ndarray, times: np.ndarray, order: int) -> Levels:
        """Counts of the orders up to order from its sorted grams."""
        for k in range(self.first, order + 1):
            here, of = np.unique(shorten(grams, order, k), return_inverse=True)
            c = np.bincount(of, times, len(here))
            contexts, of = np.unique(here >> 8, return_inverse=True)
            n = len(contexts)
            total, followers = np.bincount(of, c, n), np.bincount(of, minlength=n)
            excluded = np.bincount(of, self.chance(shorten(here, k, k - 1), k - 1), n) if k else np.bincount(of, np.full(len(here), 1 / 256), n)
            self.tables.append((here, c / (total + followers)[of], contexts, followers / (total + followers), excluded))
        return self

    def chance(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Probability of each gram's byte after its context."""
        if order < 0:
            return np.full(len(grams), 1 / 256)
        if order < self.first:
            return self.below.chance(grams, order)
        low = self.chance(shorten(grams, order, order - 1), order - 1) if order else self.chance(grams, -1)
        here, p, contexts, escape, excluded = self.tables[order - self.first]
        if not len(here):
            return low
        at = np.minimum(np.searchsorted(contexts, grams >> 8), len(contexts) - 1)
        out = np.where(contexts[at] == grams >> 8, low * escape[at] / np.maximum(1 - excluded[at], low), low)
        at = np.minimum(np.searchsorted(here, grams), len(here) - 1)
        return np.where(here[at] == grams, p[at], out)


def _low_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, t in zip(batch.column("keys"), batch.column("times"), strict=True):
                short, of = np.unique(shorten(expand_sorted(g.as_py()), order, NEAR - 1), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(short), pa.array(np.bincount(of, expand(t.as_py(), np.int64)).astype(np.int64))], names=["gram", "n"])

    return run


def _score_parts(low, order: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Logarithms of a part's grams, or counts of its words; what was learnt (no block) comes before the parts."""
        key, learnt = None, None

        def model(keys: bytes | None, times: bytes | None):
            counts = np.zeros(0, np.int64) if times is None else expand(times, np.int64)
            if key[0] >= buckets:
                return (pa.array([], pa.string()) if keys is None else expand_words(keys)), counts
            return Levels(low.value).build(np.zeros(0, np.int64) if keys is None else expand_sorted(keys), counts, order)

        for batch in batches:
            of, which, values = [], [], []
            for bucket, group, block, k, t in zip(*(batch.column(c) for c in ("bucket", "group", "block", "keys", "times")), strict=True):
                if (bucket.as_py(), group.as_py()) != key:
                    key, learnt = (bucket.as_py(), group.as_py()), None
                if not block.is_valid:
                    learnt = model(k.as_py(), t.as_py())
                    continue
                if learnt is None:  # nothing of this bucket was learnt
                    learnt = model(None, None)
                if key[0] >= buckets:
                    at = pc.fill_null(pc.index_in(expand_words(k.as_py()), learnt[0]), len(learnt[1]))
                    value = np.append(learnt[1], 0)[np.asarray(at)]
                else:
                    value = np.log10(learnt.chance(expand_sorted(k.as_py()), order)).astype(np.float32)
                of.append(block.as_py())
                which.append(key[0])
                values.append(squeeze(value))
            if of:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(which, pa.int32()), pa.array(values, pa.binary())], names=["of", "bucket", "found"])

    return run


def _learn(parts: DataFrame, groups: int, buckets: int) -> DataFrame:
    """bucket, keys, times over all blocks, with how many keys and what sum of times."""
    schema = "bucket int, keys binary, times binary, distinct long, total long"
    by = lambda df: df.repartition("bucket", "group").sortWithinPartitions("bucket", "group")
    if groups > 1:
        parts = map_arrow(by(parts.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))), _merge(buckets), schema)
    return stage(map_arrow(by(parts.select("bucket", "keys", "times", F.lit(0).alias("group"))), _merge(buckets), schema), "ppm-model", "zstd")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(HELD_OUT).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = min(max(BUCKETS[0], size // BLOCK_BYTES), BUCKETS[1])
    staged = stage(map_arrow(rows, _blocks(order, buckets), ROWS), "ppm-blocks", "zstd")
    counted = staged.agg(F.count(F.when(~F.col("held_out"), 1)).alias("ends"), F.count(F.when(F.col("row") == 0, 1)).alias("blocks")).first()
    ends, groups = counted["ends"], -(-counted["blocks"] // GROUP_BLOCKS)
    parts = staged.filter("bucket is not null").select("block", "bucket", "keys", "times")
    model = _learn(parts, groups, buckets)

    known = model.filter(F.col("bucket") >= buckets).agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    total, distinct = (known["n"] or 0) + ends, (known["v"] or 0) + (ends > 0)
    base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    end_base, end_known = float(base(ends)), int(ends > 0)
    grams = map_arrow(model.filter(F.col("bucket") < buckets).select("keys", "times"), _low_counts(order), "gram long, n long")
    short = grams.groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")  # 256 ** NEAR rows at most
    low = spark.sparkContext.broadcast(Levels().build(short.column("gram").to_numpy(), short.column("n").to_numpy(), NEAR - 1))

    copies = model.select(F.lit(None).cast("long").alias("block"), "bucket", "keys", "times", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))).alias("group"))
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(max(groups, 1))).cast("int")).unionByName(copies)
    dealt = dealt.repartition("bucket", "group").sortWithinPartitions("bucket", "group", F.col("block").asc_nulls_first())
    back = map_arrow(dealt, _score_parts(low, order, buckets), "of long, bucket int, found binary")

    def in_place(values: pa.Table, of: np.ndarray, kind: type) -> np.ndarray:
        """The parts' values, in the order of what they were dealt out from."""
        out = np.empty(len(of), kind)
        out[np.argsort(of, kind="stable")] = np.concatenate([np.zeros(0, kind), *(expand(x.as_py(), kind) for x in values.sort_by("bucket").column("found"))])
        return out

    def of_block(texts: pa.Table, values: pa.Table) -> pa.Table:
        texts = texts.sort_by("row").combine_chunks()
        n = texts.num_rows
        split = Words(texts.column("text").combine_chunks(), lower=True)
        is_word = pc.greater_equal(values.column("bucket"), buckets)
        used, c = _used(split), np.zeros(len(split.uniq), np.int64)
        if len(used):
            c[used] = in_place(values.filter(is_word), word_bucket(split.uniq.take(pa.array(used)), buckets), np.int64)
        n_words = np.diff(split.offsets)
        of = np.repeat(np.arange(n), n_words)
        known, low_sums = (np.bincount(of, x[split.codes], n) for x in (c > 0, base(c)))
        grams, firsts = grams_of(split, order)
        ranked = np.sort(grams)
        distinct_grams = ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))]
        del ranked
        found = in_place(values.filter(pc.invert(is_word)), bucket_of(distinct_grams, order, buckets), np.float32)
        sums, owner = np.zeros(n), np.repeat(np.arange(n, dtype=np.int32), np.diff(firsts))
        for k in range(0, len(grams), LOOKUP):
            some = grams[k : k + LOOKUP]
            by_gram = np.argsort(some)
            sums += np.bincount(owner[k : k + LOOKUP][by_gram], found[np.searchsorted(distinct_grams, some[by_gram])].astype(np.float64), n)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n_words + 1, "n_known": known.astype(np.int64) + end_known,
            "train_tokens": np.full(n, total, np.int64), "base_score": low_sums + end_base, "score": sums,
        })

    documents = staged.filter("row is not null").select("block", "row", "doc_id", "held_out", "text")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return documents.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(of_block, schema)
