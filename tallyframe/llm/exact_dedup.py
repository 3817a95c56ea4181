"""Exact duplicates by two passes over a Bloom filter.

The first pass counts, for every position of the filter and up to two, how many keys fall there. A key whose positions all have
a count of two may be repeated; a key with a lower count cannot be. Only rows that may be repeated are shuffled in the second
pass, the rest go straight through. A false positive costs a shuffled row and never changes the result.

The filter has 16 positions a row, up to ``max_bits`` (2**30: 128 MB as bits), so what is broadcast has a fixed bound; beyond
that many rows more of them are shuffled and the result stays exact.

Defined cases: a null text counts as empty, and empty texts are one group. A null doc_id sorts after all others. Repeated rows
are members of the group each; of rows equal in length and doc_id, the first that was read stays. An empty table gives an empty
result. Extra columns pass through ``drop_duplicates`` and are ignored by ``duplicate_groups``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ASCII_SPACE, materialize, numbered, text_of, with_group

RID = "__dedup_row"
HASHES = 4
SEGMENT = 1 << 16
PER_ROW = 16


def normalized(text: str = "text") -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text_of(text), f"{ASCII_SPACE}+", "")


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES positions for each 64-bit key, by double hashing; bits is a power of two."""
    a = keys.astype(np.uint64)
    b = (a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return (((a >> np.uint64(7))[:, None] + b[:, None] * steps) & np.uint64(bits - 1)).astype(np.int64)


def _counted(bits: int, every: int = 1 << 20):
    """Per task: for each segment of the filter, the offsets that are hit once and those hit more often."""

    def flush(keys: list[np.ndarray]) -> pa.RecordBatch:
        own, times = np.unique(np.concatenate(keys), return_counts=True)
        # a row's own positions are distinct but for rare collisions, which only make a false positive
        pos, first = np.unique(np.sort(positions(own, bits).ravel()), return_index=True)
        hits = np.zeros(len(pos), np.int64)
        flat = positions(own, bits)
        np.add.at(hits, np.searchsorted(pos, flat.ravel()), np.repeat(np.minimum(times, 2), HASHES))
        segment = pos // SEGMENT
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        ends = np.r_[starts[1:], len(pos)]
        offsets = (pos % SEGMENT).astype("<u2")
        many = (hits > 1).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array(segment[starts], pa.int64()), pa.array([offsets[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([many[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
            names=["segment", "offsets", "many"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], 0
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
            if n >= every:
                yield flush(keys)
                keys, n = [], 0
        if n:
            yield flush(keys)

    return run


def _summed(tab: pa.Table) -> pa.Table:
    """One segment of the filter: a bit for each position that two keys or more share."""
    count = np.zeros(SEGMENT, np.uint8)
    for offsets, many in zip(tab.column("offsets"), tab.column("many")):
        at = np.frombuffer(offsets.as_py(), "<u2")
        count[at] = np.minimum(2, count[at] + 1 + np.frombuffer(many.as_py(), np.uint8))
    return pa.table({"segment": tab.column("segment").slice(0, 1), "twice": pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())})


def repeated_filter(keys: DataFrame, n: int, max_bits: int = 1 << 30) -> tuple[np.ndarray, int]:
    """The filter of keys that may occur more than once, as bytes, and its number of positions."""
    bits = min(max_bits, max(SEGMENT, 1 << math.ceil(math.log2(max(2, PER_ROW * n)))))
    parts = keys.mapInArrow(_counted(bits), "segment long, offsets binary, many binary").groupBy("segment").applyInArrow(_summed, "segment long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # max_bits / 8 bytes at most
        out[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.twice, np.uint8)
    return out, bits


def maybe_repeated(spark, twice: np.ndarray, bits: int):
    """A column function: may this 64-bit key occur more than once?"""
    shared = spark.sparkContext.broadcast(twice.tobytes())

    @F.pandas_udf("boolean")
    def probe(key: pd.Series) -> pd.Series:
        at = positions(key.to_numpy().astype(np.int64).view(np.uint64), bits)
        table = np.frombuffer(shared.value, np.uint8)
        return pd.Series(((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    return probe


def _digests(docs: DataFrame, rid: Column, doc_id: str, text: str) -> DataFrame:
    sha = F.unhex(F.sha2(normalized(text), 256))
    return docs.select(rid.alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.length(text_of(text)).cast("long").alias("size"), sha.alias("sha")).withColumn("key", F.xxhash64("sha"))


def _marked(digests: DataFrame, max_bits: int) -> tuple[DataFrame, int, object]:
    """The digests, kept in the shared folder, their number, and a flag for rows that may be repeated."""
    digests = materialize(digests, "digests")
    n = digests.count()
    twice, bits = repeated_filter(digests.select("key"), n, max_bits)
    return digests, n, maybe_repeated(digests.sparkSession, twice, bits)


def _winners(rows: DataFrame) -> DataFrame:
    best = F.struct(-F.col("size"), F.col("doc_id").isNull(), "doc_id", "rid")
    return rows.groupBy("sha").agg(F.min(best).alias("best"), F.count("*").alias("group_size")).select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, n, probe = _marked(_digests(docs, F.monotonically_increasing_id(), doc_id, text), max_bits)
    again = materialize(digests.where(probe("key")).drop("key"), "repeated")
    groups = materialize(_winners(again), "groups")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    through = digests.where(~probe("key")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    grouped = with_group(again, groups, "sha", "group_size", n).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), sha)
    return through.unionByName(grouped)


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """The documents that stay, with all their columns. Rows that cannot be repeated are not shuffled."""
    docs = numbered(docs, RID, "numbered")
    digests, _, probe = _marked(_digests(docs, F.col(RID), doc_id, text), max_bits)
    again = digests.where(probe("key")).select("rid", "doc_id", "size", "sha")
    stay = materialize(_winners(again).select(F.col("keep_rid").alias("__keep")), "winners")
    tagged = docs.withColumn("__again", probe(F.xxhash64(F.unhex(F.sha2(normalized(text), 256)))))
    once = tagged.where(~F.col("__again"))
    rest = tagged.where(F.col("__again")).join(stay, F.col(RID) == F.col("__keep"), "left_semi")
    return once.unionByName(rest).drop(RID, "__again")
