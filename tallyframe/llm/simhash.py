"""Near duplicates by SimHash, found through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits are cut into two halves. Either one half is equal, or both differ in
exactly one bit. So each distinct fingerprint is indexed under its two halves and under the 32 variants of its upper half with
one bit wild; an equality join on these keys gives all candidates, and each is verified by counting the differing bits. For a
wild bit, only fingerprints that differ in that bit are paired, so a pair is met once.

A key with more than ``bucket`` fingerprints is not expanded into pairs. Its members get longer keys that also wildcard the
other half, over those bits that vary in the bucket: two fingerprints share such a key only if they differ in no other bit, so
at most four fingerprints meet, and every link is still found. Documents with equal fingerprints are one class throughout.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other. Repeated rows
and rows with a null doc_id are documents of their own; a null doc_id is never the smallest unless there is no other. Of rows
that share the smallest doc_id, the first that was read stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyframe.llm.common import join_hint, materialize, numbered, with_group

RID = "__simhash_row"
SEED = 42
WORDS = 3
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Of all shingles of n words, repeats included: a bit is set if it is set in over half the hashes."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    if len(words) <= n:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total, count = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, count, 65_280):
        upto = min(count, at + 65_280)
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at:upto], ends[at + n - 1 : upto + n - 1])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["rid", "doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rid: str | None = None) -> DataFrame:
    """rid (a column's, or the row's number), doc_id and fp (as a signed long) of every document."""
    rows = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "rid long, doc_id long, fp long")


def _clear(fp: str, bit: str) -> str:
    return f"({fp} & ~shiftleft(1L, {bit}))"


def links(prints: DataFrame, bucket: int = 32) -> DataFrame:
    """All pairs a, b of distinct fingerprints with 1 or 2 differing bits. prints: one row per distinct fp."""
    # kind 0: upper half equal, 1: lower half equal, 2 + p: upper half equal but for bit 32 + p
    high, low = "shiftrightunsigned(fp, 32)", f"fp & {LOW}L"
    keyed = prints.select("fp", F.expr(f"""explode(concat(
        array(struct(0 as kind, {high} as part), struct(1 as kind, {low} as part)),
        transform(sequence(0, 31), p -> struct(2 + p as kind, shiftrightunsigned({_clear('fp', '32 + p')}, 32) as part))))""").alias("k")).select("fp", "k.kind", "k.part")
    buckets = keyed.groupBy("kind", "part").agg(F.count("*").alias("n"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("varied")).where("n > 1")
    buckets = materialize(buckets, "keys")
    shared = materialize(keyed.join(buckets.hint(join_hint(buckets)), ["kind", "part"]), "buckets")
    small = shared.where(F.col("n") <= bucket).select("kind", "part", "fp", F.expr("if(kind < 2, 0L, shiftrightunsigned(fp, 30 + kind) & 1L)").alias("side"))
    a, b = small.where("kind < 2 or side = 0").alias("a"), small.where("kind < 2 or side = 1").alias("b")
    near = F.expr("a.kind = b.kind and a.part = b.part and (a.kind > 1 or a.fp < b.fp) and bit_count(a.fp ^ b.fp) <= 2")
    pairs = a.join(b.hint("merge"), near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    # large buckets: wildcard the bits that vary there as well, two in the free half, or one there beside the wild one
    free = "if(kind = 1, shiftrightunsigned(varied, 32), varied & 4294967295L)"
    base = "if(kind = 1, 32, 0)"
    large = shared.where(F.col("n") > bucket).withColumn("bits", F.expr(f"transform(filter(sequence(0, 31), q -> shiftright({free}, q) & 1L = 1L), q -> q + {base})"))
    two = F.expr("""flatten(transform(bits, (q, i) -> transform(slice(bits, i + 2, size(bits)), r -> struct(q as q, r as r, fp & ~shiftleft(1L, q) & ~shiftleft(1L, r) as rest))))""")
    single = F.expr("if(size(bits) = 1, array(struct(bits[0] as q, bits[0] as r, fp & ~shiftleft(1L, bits[0]) as rest)), array())")
    beside = F.expr("transform(bits, q -> struct(q as q, 30 + kind as r, fp & ~shiftleft(1L, q) & ~shiftleft(1L, 30 + kind) as rest))")
    wild = large.where("kind < 2 or shiftrightunsigned(varied, 30 + kind) & 1L = 1L").select("fp", F.explode(F.when(F.col("kind") < 2, F.concat(two, single)).otherwise(beside)).alias("w")).select("fp", "w.q", "w.r", "w.rest")
    met = wild.groupBy("q", "r", "rest").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # four at most
    more = met.select(F.explode(F.expr("flatten(transform(array_sort(fps), (x, i) -> transform(slice(array_sort(fps), i + 2, 4), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    both = pairs.unionByName(more)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node with an edge; label is the least node that can be reached.

    In a round a node takes the least label around it, the label it had takes that too (so a whole tree of labels is hooked to another,
    from wherever they touch), and labels jump to the label of the label. Of flat trees each is joined with another within two rounds,
    and jumps halve the depth of others; so the rounds grow with logarithms, not with the length of a path.
    A node's edges are bounded (2,080 fingerprints lie within two bits), and what gathers at one label is a join that AQE splits.
    """
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    how = join_hint(labels)
    while True:
        told = edges.join(labels.hint(how), edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(told.hint(how), "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        lower = materialize(lower, "lower")
        hooks = lower.where("label < was").groupBy(F.col("was").alias("node")).agg(F.min("label").alias("hook"))
        hooked = materialize(lower.join(hooks.hint(how), "node", "left").select("node", "was", F.least("label", "hook").alias("label")), "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialize(hooked.join(jump.hint(how), "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        if moved.where("was != label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = 32, rid: str | None = None) -> DataFrame:
    """rid, doc_id, fp, component_id and keep_rid of every document.

    component_id is the smallest doc_id that links reach from the document, keep_rid the row that carries it.
    """
    rows = materialize(fingerprints(docs, doc_id, text, rid), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    classes = materialize(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("size")), "classes")
    labels = components(links(classes.select("fp"), bucket))
    linked = classes.join(labels.hint(join_hint(labels)), classes.fp == labels.node, "left").select("fp", "size", "first", F.coalesce("label", "fp").alias("label"))
    linked = materialize(linked, "linked")
    heads = linked.groupBy("label").agg(F.min("first").alias("head"))
    named = materialize(linked.join(heads.hint("merge"), "label").select("fp", "size", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("keep_rid")), "named")
    return with_group(rows, named, "fp", "size", max(1, rows.count())).select("rid", "doc_id", "fp", "component_id", "keep_rid")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = 32) -> DataFrame:
    """The documents, all columns, that carry their component's smallest doc_id."""
    docs = numbered(docs, RID, "numbered")
    drop = materialize(near_duplicates(docs, doc_id, text, bucket, RID).where("rid != keep_rid").select(F.col("rid").alias("__drop")), "dropped")
    return docs.join(drop, F.col(RID) == F.col("__drop"), "left_anti").drop(RID)
