"""Near-duplicates by MinHash bands and sequential Bayesian verification.

A document is the set of its distinct 5-word shingles (words are runs of
characters other than ``[\\x20\\x09-\\x0D]``, A-Z in lower case; a text with
fewer words is one shingle). Two documents are linked when
100 * |A and B| >= percent * |A or B|; groups are the connected components.

1. One scan gives each document the size of its set, a 128-bit digest of it,
   BANDS band keys and a code of one byte for each of the hashes. Documents with
   equal sets are collapsed into one.
2. Documents that share a band key form a bucket. In each, every member is
   paired with one centre: the member whose buckets are largest in all.
3. A pair's codes are compared in batches; after each, it is dropped if the
   posterior probability of a similarity at or above the threshold (uniform
   prior) is below MISS. Survivors are verified on the full sets.
4. Components of those links are labelled. Where a bucket still has members of
   several components, all pairs between components go through 3 in place:
   first on the codes, which leaves the members that have a surviving pair,
   then on the full sets of those. Only pairs with a member outside the bucket's
   largest component are looked at: such members, in blocks of bounded size, meet
   the blocks of all members. A pair of documents is looked at in the first band
   it shares, and only links that join components are written.

A pair at the threshold is missed by all bands with probability
(1 - s**ROWS)**BANDS: 7e-8 at 0.85, 1.5e-5 at 0.8.
Sets are kept as 64-bit hashes of shingles.

Edge cases: texts without a word (null, empty) have no shingle and are linked
with nothing, not even each other; rows that repeat a doc_id with the same text
are one document; rows of one doc_id with different texts have a set each and the
links of all of them; rows without a doc_id get a null component and are kept; an
empty table gives an empty result; ``keep_representatives`` carries all other
columns untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import Words, hash_strings, map_arrow, mix64, one_of_each, ragged_take, stage, text_hash, text_slices, without
from samplight.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
#: Hashes that one step of the verification compares.
BATCH = 20
#: A pair is dropped when its posterior chance of a link falls below this.
MISS = 1e-6
#: Members that one block holds; two blocks are compared in one task.
BLOCK = 1_024
#: Shingles that one block holds, about (8 bytes each).
BLOCK_SHINGLES = 1 << 20
#: Documents whose ids (8 bytes each) may be broadcast.
BROADCAST_IDS = 2_000_000
#: Text bytes that one step of a scan works on.
SCAN_BYTES = 3 << 20

_HORNER = np.uint64(0x9DDFEA08EB382D69)
_RANDOM = np.random.default_rng(517)
_SEEDS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    with np.errstate(over="ignore"):
        h = hash_strings(words.uniq)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        rolled = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _HORNER + h[k : len(h) - SHINGLE + 1 + k]
        rolled = mix64(rolled)
        out = []
        for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(rolled[a : b - SHINGLE + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = whole * _HORNER + x
                out.append(mix64(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """(band keys, one-byte codes) of a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(low), 2_048):
            np.minimum(least, ((low[None, k : k + 2_048] ^ _SEEDS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
            keys = keys * _HORNER + row
    return mix64(keys).tobytes(), (least & np.uint32(255)).astype(np.uint8).tobytes()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, limit=SCAN_BYTES):
            out: list[list] = [[], [], [], [], []]
            for s in shingle_sets(rows.column("text")):
                keys, codes = signature(s) if len(s) else (None, None)
                with np.errstate(over="ignore"):
                    first, second = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(97)))
                for column, x in zip(out, (len(s), int(first.astype(np.int64)), int(second.astype(np.int64)), keys, codes), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands", "codes"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, limit=SCAN_BYTES):
            sets = [s.tobytes() for s in shingle_sets(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "shingles"])


def least_matches(percent: int) -> list[int]:
    """After 1, 2, ... batches, the matches below which a pair is dropped.

    With a uniform prior, m matches of n make the chance of a rate at or above
    t that of at most m successes in n + 1 trials at t. Codes of one byte also
    match by accident, which raises the rate that the threshold stands for.
    """
    t = percent / 100
    t += (1 - t) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= MISS:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (left[a], right[b]) of codes survive all batches, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, enough in enumerate(least):
        columns = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[a[alive], columns] == right[b[alive], columns]).sum(axis=1)
        alive = alive[matches[alive] >= enough]
        if not len(alive):
            break
    return alive, matches[alive]


def _codes(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays([column])
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[: len(column) * HASHES].reshape(-1, HASHES)


def _prune(percent: int):
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.arange(batch.num_rows)
            if len(i):
                alive, _ = survivors(i, i, _codes(batch.column("codes_a")), _codes(batch.column("codes_b")), least)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _grouped(run_group):
    """Hands whole groups of rows sorted by grp to run_group, some groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            group = t.column("grp").to_numpy()
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield run_group(t.slice(0, whole).combine_chunks())
            held = t.slice(whole)
        if held is not None:
            yield run_group(held.combine_chunks())

    return run


def _pairs_across(t: pa.Table, percent: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group, of different sides and components, that survive the batches.

    A pair meets in every band that it shares; it is looked at in the first.
    """
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group, band, side, comp, size = (t.column(c).to_numpy() for c in ("grp", "band", "side", "comp", "n_shingles"))
    codes = _codes(t.column("codes").chunk(0))
    keys = np.frombuffer(pa.concat_arrays([t.column("bands").chunk(0)]).buffers()[2], np.uint64).reshape(-1, BANDS)
    ends = np.searchsorted(group, group, side="right")
    idx, lag = np.arange(len(group)), 0
    left, right = [], []
    while len(idx):
        lag += 1
        idx = idx[idx + lag < ends[idx]]
        a, b = idx, idx + lag
        ok = (comp[a] != comp[b]) & (side[a] != side[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        if len(a):
            first = (keys[a] == keys[b]).argmax(axis=1) == band[a]
            a, b = a[first], b[first]
            alive, _ = survivors(a, b, codes, codes, least)
            left.append(a[alive])
            right.append(b[alive])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _needed(percent: int):
    """Rows with a surviving pair in their group."""
    least = least_matches(percent)

    def of(t: pa.Table) -> pa.RecordBatch:
        rows = pa.array(np.unique(np.concatenate(_pairs_across(t, percent, least))))
        return pa.RecordBatch.from_arrays([t.column(c).take(rows).combine_chunks() if len(rows) else pa.array([], t.schema.field(c).type) for c in t.column_names], names=t.column_names)

    return _grouped(of)


def _link_across(percent: int):
    """Links that join the components in each group, verified on the sets.

    A member is compared with all its pairs at once; pairs of components that
    a link has joined meanwhile are passed over.
    """
    least = least_matches(percent)

    def of(t: pa.Table) -> pa.RecordBatch:
        left, right = _pairs_across(t, percent, least)
        out: list[tuple[int, int]] = []
        if len(left):
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            group, label, ids = t.column("grp").to_numpy(), t.column("comp").to_numpy().copy(), t.column("id").to_numpy()
            column = pa.concat_arrays([t.column("shingles").chunk(0)])
            offsets = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1].astype(np.int64) // 8
            flat = np.frombuffer(column.buffers()[2], np.uint64)
            size = np.diff(offsets)
            begins = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
            for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(left)], strict=True):
                a, others = left[lo], right[lo:hi]
                others = others[label[others] != label[a]]
                if not len(others):
                    continue
                own = flat[offsets[a] : offsets[a + 1]]
                theirs = ragged_take(flat, offsets[others], size[others])
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                both = np.add.reduceat((own[at] == theirs).astype(np.int64), np.cumsum(size[others]) - size[others])
                linked = others[100 * both >= percent * (len(own) + size[others] - both)]
                if len(linked):
                    first, last = np.searchsorted(group, [group[a], group[a] + 1])
                    mine = label[first:last]
                    for b in linked.tolist():
                        if label[b] != label[a]:
                            out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                            mine[mine == label[b]] = label[a]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _grouped(of)


class Linker:
    """Verifies candidate pairs of some documents."""

    def __init__(self, docs: DataFrame, reps: DataFrame, members: DataFrame, percent: int):
        self.percent = percent
        ids = stage(members.select("id").distinct(), "candidate-ids")
        few = ids.count() <= BROADCAST_IDS
        ids = F.broadcast(ids) if few else ids
        self.codes = stage(reps.join(ids, "id", "left_semi").select("id", "n_shingles", "codes", "bands"), "codes")
        texts = docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        self.sets = stage(map_arrow(texts, _sets, "id long, shingles binary"), "sets")

    def _joined(self, pairs: DataFrame, table: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select([F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in table.columns]), side)
        return pairs

    def prune(self, pairs: DataFrame) -> DataFrame:
        sized = self._joined(pairs, self.codes.drop("bands"))
        smaller, larger = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
        sized = sized.filter(100 * smaller >= self.percent * larger).select("a", "b", "codes_a", "codes_b")
        return stage(map_arrow(sized, _prune(self.percent), "a long, b long"), "survivors")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        with_sets = self._joined(pairs, self.sets).select("a", "b", "shingles_a", "shingles_b")
        return stage(map_arrow(with_sets, _confirm(self.percent), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash for every row of docs."""
    docs = docs.select("doc_id", "text")
    hashed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    scanned = stage(map_arrow(hashed, _scan, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands binary, codes binary"), "signatures")
    reps = scanned.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles")
    reps = stage(reps.agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("codes").alias("codes")), "distinct-sets")
    keys = reps.select("id", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(bands, 8 * i + 1, 8)))")).alias("band", "key"))
    buckets = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = stage(keys.join(buckets, "key"), "members")
    linker = Linker(docs, reps, members, percent)

    weights = stage(members.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    weighted = stage(members.join(weights, "id"), "weighted")
    centres = stage(weighted.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("c")).select("key", F.col("c.id").alias("centre")), "centres")
    pairs = members.join(centres, "key").filter("id != centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    tried = stage(pairs.distinct(), "pairs")
    links = linker.confirm(linker.prune(tried))
    labels = components(links)

    crowded = members.filter("n > 2").join(labels.select("id", F.col("label").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    crowded = stage(crowded.join(linker.codes.select("id", "n_shingles"), "id"), "crowded")
    parts = stage(crowded.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")), "bucket-components")
    still_open = parts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp", "shingles")).alias("main"), F.sum("n").alias("all"), F.sum("shingles").alias("shingles")).filter("comps > 1")
    still_open = stage(still_open.select(
        "key", F.col("main.comp").alias("main"),
        F.expr(f"cast(ceil(greatest((all - main.n) / {BLOCK}, (shingles - main.shingles) / {BLOCK_SHINGLES}, 1)) as int)").alias("outer_blocks"),
        F.expr(f"cast(ceil(greatest(all / {BLOCK}, shingles / {BLOCK_SHINGLES}, 1)) as int)").alias("all_blocks"),
    ), "open")
    dealt = crowded.select("id", "comp", "band", "key").join(still_open, "key").withColumn("outside", F.col("comp") != F.col("main"))
    dealt = dealt.withColumn("outer", F.expr("cast(pmod(xxhash64(id, 1L), outer_blocks) as int)")).withColumn("inner", F.expr("cast(pmod(xxhash64(id), all_blocks) as int)"))
    # a member outside the main component meets all blocks of members; of two such members the pair is met once, or twice in one block
    as_outer = F.expr("if(outside, transform(sequence(0, all_blocks - 1), x -> struct(outer as o, x as i, 0 as side)), array())")
    as_inner = F.expr("transform(sequence(if(outside, outer, 0), outer_blocks - 1), x -> struct(x as o, inner as i, 1 as side))")
    dealt = dealt.withColumn("place", F.explode(F.concat(as_outer, as_inner)))
    dealt = dealt.select("id", "comp", "band", F.col("place.side").alias("side"), F.xxhash64("key", "place.o", "place.i").alias("grp"))
    dealt = dealt.join(linker.codes, "id").repartition("grp").sortWithinPartitions("grp")
    needed = stage(map_arrow(dealt, _needed(percent), dealt.schema), "needed")
    met = needed.join(linker.sets, "id").repartition("grp").sortWithinPartitions("grp")
    more = stage(map_arrow(met, _link_across(percent), "a long, b long").distinct(), "links")
    if more.limit(1).count():
        labels = components(links.union(more))

    named = reps.join(labels, "id", "left").filter("copies > 1 or label is not null").select("d1", "d2", "n_shingles", F.coalesce("label", "id").alias("component"))
    named = stage(named, "components")
    rows = scanned.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


#: Ids of rows without one are this many bits of their text's hash, above all others.
NULL_ID_BITS = 62


def keep_representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of every group, of the smallest doc_id; all columns as they were.

    Rows without a doc_id take part and stay only where no row of their group has one.
    """
    found = docs.agg(F.max("doc_id").alias("top"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    own, columns = "__own_id", docs.columns
    if found["nulls"]:
        bits = min(NULL_ID_BITS, (2**63 - 1 - max(found["top"] or 0, 0)).bit_length() - 1)
        surrogate = F.lit(max(found["top"] or 0, 0) + 1) + text_hash(F.col("text")).bitwiseAND(F.lit((1 << max(bits, 0)) - 1))
        docs = docs.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", surrogate))
    decided = stage(near_duplicates(docs, percent).select("doc_id", "component_id", "kept", "text_hash"), "near-decided")
    same = decided.filter("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = same.select("doc_id", "text_hash", F.xxhash64("doc_id", "text_hash").alias("group"))
    out = one_of_each(without(docs, decided.filter("not kept")), same)
    return out.withColumn("doc_id", F.col(own)).select(*columns) if found["nulls"] else out
