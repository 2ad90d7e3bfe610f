"""Exact dedup by progressive refinement, in DataFrame functions only.

Two texts are equal when they are identical after every run of white space
``[\\x20\\x09-\\x0D]+`` is replaced by one space; null counts as empty. Groups
are refined by length, then by the hash of a prefix, then by the hash of the
whole text, which is read for the groups that are still shared only. Of equal
texts the smallest doc_id stays.

Edge cases: an empty table gives an empty result. Rows without a doc_id take
part; a null doc_id is never chosen over another, and a group of nulls keeps a
null keep_id with every row kept. Rows that repeat both doc_id and text are the
same document and get the same decision; ``drop_exact_copies`` leaves one of
such rows, and one of a group of nulls. It carries other columns untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import one_of_each, stage, text_hash, without

#: Characters of the normalised text that the second refinement hashes.
PREFIX_CHARS = 64
#: Surviving (length, prefix) groups that may be broadcast, 16 bytes each.
BROADCAST_GROUPS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The key combinations that two rows or more have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def exact_groups(docs: DataFrame) -> DataFrame:
    """The groups of two rows or more: text_len, prefix_hash, full_hash, keep_id, group_size.

    Each shuffle carries only lengths and hashes, aggregated before it, so a
    group that holds a third of all rows costs one row for each task.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    by_prefix = text.select(F.length("t").cast("long").alias("text_len"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"))
    pairs = stage(by_prefix.groupBy("text_len", "prefix_hash").agg(F.count(F.lit(1)).alias("rows")), "exact-prefix")
    lengths = pairs.groupBy("text_len").agg(F.sum("rows").alias("of_length")).filter("of_length > 1").drop("of_length")
    survivors = pairs.join(lengths, "text_len", "left_semi").filter("rows > 1").select("text_len", "prefix_hash")
    survivors = stage(survivors, "exact-survivors")
    keys = ["text_len", "prefix_hash"]
    full = text.select("doc_id", F.length("t").cast("long").alias("text_len"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"), "t")
    digest = F.unhex(F.sha2(F.col("t"), 256)).alias("full_hash")
    if survivors.count() <= BROADCAST_GROUPS:  # then only the survivors' content is hashed
        full = full.join(F.broadcast(survivors), keys, "left_semi").select("doc_id", *keys, digest)
    else:  # hash first, as digests are cheaper to move than texts
        full = full.select("doc_id", *keys, digest).join(survivors, keys, "left_semi")
    groups = full.groupBy("text_len", "prefix_hash", "full_hash").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stage(groups.filter("group_size > 1"), "exact-groups")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash for every row of docs."""
    groups = exact_groups(docs).select("full_hash", "keep_id", "group_size")
    rows = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("full_hash"), text_hash(F.col("text")).alias("text_hash"))
    rows = rows.join(groups, "full_hash", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("full_hash")).alias("text_sha256"),
        "text_hash",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of every group of equal texts, of the smallest doc_id; all columns as they were.

    Only texts of the length and prefix of a group are hashed as a whole.
    """
    groups = exact_groups(docs)
    keys = ["text_len", "prefix_hash"]
    shared = groups.select(*keys).distinct()
    if shared.count() <= BROADCAST_GROUPS:
        shared = F.broadcast(shared)
    text = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), normalised(F.col("text")).alias("t"))
    text = text.select("doc_id", "text_hash", F.length("t").cast("long").alias("text_len"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"), "t").join(shared, keys, "left_semi")
    rows = text.select("doc_id", "text_hash", *keys, F.unhex(F.sha2("t", 256)).alias("full_hash")).join(groups, [*keys, "full_hash"])
    rows = stage(rows.select("doc_id", "text_hash", "full_hash", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "exact-shared")
    several = rows.filter("kept").groupBy("full_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("full_hash")
    same = rows.filter("kept").join(several, "full_hash").select("doc_id", "text_hash", F.hex("full_hash").alias("group"))
    return one_of_each(without(docs, rows.filter("not kept")), same)
