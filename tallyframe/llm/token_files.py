"""Token ids as Parquet list columns, in ascending doc_id order.

A file's columns: doc_id, part and row (its place), start_in_part (ids before it in its file), n_tokens, token_ids. The ids are
dictionary-encoded (a page's ids are then packed to the bits that the vocabulary needs); the running columns are delta-encoded
(Parquet's second data page version). Row groups and pages have fixed sizes and page indexes are written, so a reader that asks
for the metadata reads no ids, and one that asks for a range of doc_id reads only the pages that hold it.

Files are ranges of doc_id and, of rows that share one, of a hash of the row's number; so a doc_id that many rows share, or null, is
dealt over files, and the number of files grows with the input.

Defined cases: a null text counts as empty and has its end id only; null doc_ids come first; rows with equal doc_id follow each other
in any order; repeated rows are kept; an empty table gives files without rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import numbered, parts_for, ranges
from tallyframe.llm.tokens import encoder, offsets_of

RID = "__token_row"
#: Bytes of input for each file of ids.
FILE_BYTES = 128 << 20

FILE = "doc_id long, part int, row long, start_in_part long, n_tokens long, token_ids array<int>"
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#token_ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.columnindex.truncate.length": "64",
    "compression": "snappy",
}


def _encoded(path: str, pattern: str, end: int, most: int = 4 << 20):
    """Some megabytes of texts at a time; a batch that goes out has ``most`` bytes of ids, or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, tail = encoder(path, pattern), np.asarray([end], "<u4").tobytes()
        row, start = 0, 0

        def rows(docs: pa.Array, codes: pa.Array) -> pa.RecordBatch:
            nonlocal row, start
            ends = offsets_of(codes) >> 2
            n = np.diff(ends).astype(np.int64)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1] - ends[0]), [None, codes.buffers()[2]], offset=int(ends[0]))
            columns = [docs, pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.ListArray.from_arrays(pa.array(ends - ends[0]), ids)]
            row, start = row + len(n), start + int(n.sum())
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FILE.split(", ")])

        for batch in batches:
            docs, done = batch.column(0), 0
            for codes in encode.batches(batch.column(1), tail):
                ends, at = offsets_of(codes), 0
                while at < len(codes):
                    upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
                    yield rows(docs.slice(done + at, upto - at), codes.slice(at, upto - at))
                    at = upto
                done += len(codes)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pattern: str, end: int = 0, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode docs and write their ids below path. The texts are sorted, not the ids: they take less room in the shuffle."""
    docs = numbered(docs, RID, "numbered")
    at, mix = F.coalesce(F.col(doc_id).cast("long"), F.expr("-9223372036854775808L")), F.xxhash64(RID)  # of one long: no two rows have the same
    keyed = docs.select(at.alias("at"), mix.alias("mix"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = parts or parts_for(docs, FILE_BYTES)
    found, _ = ranges(keyed, parts, "at", "mix")
    ordered = keyed.withColumn("range", found).repartitionById(parts, "range").sortWithinPartitions("at", "mix").select("doc_id", "text")
    ordered.mapInArrow(_encoded(tokenizer, pattern, end), FILE).write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the ids, with start: the ids of all documents before it."""
    rows = spark.read.schema(FILE).parquet(path).drop("token_ids")
    return _with_start(rows, path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and token_ids of documents from first to last; other pages are skipped by their index."""
    rows = spark.read.schema(FILE).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "token_ids")


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    spark = rows.sparkSession
    sums = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each file
    before, at = [], 0
    for r in sums:
        before.append((r.part, at))
        at += r.n
    base = spark.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = spark.read.schema(FILE).parquet(path).select("doc_id", "part", "start_in_part", "token_ids")
    sums = rows.mapInArrow(_checks, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return _with_start(sums, path).select("doc_id", "start", "n_tokens", "ids_crc32")
