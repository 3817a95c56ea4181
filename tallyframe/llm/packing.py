"""Vector best-fit packing of token sequences.

A piece asks for (tokens, one document, attention cost = tokens squared); a bin has a capacity for each. Pieces are placed longest
first, each into the open bin where it fits under every capacity and that scores best: by the norm of what would remain, relative
to the capacities ("residual"), or by the product of request and residual, weighted ("dot"). Both prefer the fullest bin that fits
or the best-matched one; ties go to the bin with fewer tokens left.

A piece's request depends on its length only, and there are at most ``tokens`` lengths. So the corpus is summed up as a histogram
of lengths, the driver packs the histogram (equal pieces into equal bins at once, so its work and memory depend on the number of
lengths and not on the number of documents), and each piece finds its place by its rank among the pieces of its length. Ranks are
taken within (length, salt), so that a length that a third of the corpus shares is dealt over many tasks; the ranks before each salt
are sums of a window over the salts' counts, and no more than the histogram comes to the driver.

Defined cases: a null text counts as empty and still has its end id; a null doc_id stays null; repeated rows are packed each; an
empty table gives an empty result; extra columns are ignored. Long texts are cut into pieces of ``tokens``, the first may be
shorter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize
from tallyframe.llm.tokens import encoder

#: Bytes of texts that are encoded at a time: the pipeline's other stages leave an executor less memory than token files alone have.
MOST = 4 << 20
PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, pattern: str, end: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path, pattern), np.asarray([end], "<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for codes in encode.batches(batch.column(2), tail, MOST):
                rows = []
                for code, (rid, doc) in zip(codes, keys):
                    ids = memoryview(code.as_buffer())
                    n = len(ids) // 4
                    at, upto, k = 0, (n - 1) % tokens + 1, 0
                    while at < n:
                        rows.append((rid, doc, k, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto])))
                        at, upto, k = upto, upto + tokens, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end: int, tokens: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces, without the ids: what packing needs."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, pattern, end, tokens), PIECES)


def best_fit(histogram: dict[int, int], tokens: int, documents: int, attention: int, rule: str = "residual") -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins of equal content as (number of bins, [(length, pieces of it in each bin)]), for a histogram of lengths."""
    content: dict[tuple[int, int, int], list] = defaultdict(list)  # residual capacities -> [[number of bins, content]]
    done = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        need = (length, 1, length * length)
        while left:
            fitting = [r for r in content if all(x >= y for x, y in zip(r, need))]
            if not fitting:
                state, bins = (tokens, documents, attention), [[left, []]]
                if any(x < y for x, y in zip(state, need)):
                    raise ValueError(f"a piece of {length} tokens fits no bin")
                # open the bins that this length needs by itself: each takes as many as fit
                each = min(tokens // length, documents, attention // (length * length))
                whole, rest = divmod(left, each)
                for number, k in ((whole, each), (1 if rest else 0, rest)):
                    if number:
                        content[tuple(x - k * y for x, y in zip(state, need))].append([number, [(length, k)]])
                break
            scale = (tokens, documents, attention)
            if rule == "residual":
                state = min(fitting, key=lambda r: (sum(((x - y) / s) ** 2 for x, y, s in zip(r, need, scale)), r))
            else:
                state = min(fitting, key=lambda r: (-sum(x * y / s / s for x, y, s in zip(r, need, scale)), r))
            bins = content[state]
            number, inside = bins[-1]
            take = min(number, left)
            bins.pop()
            if number > take:
                bins.append([number - take, inside])
            if not bins:
                del content[state]
            filled = [*inside[:-1], (length, inside[-1][1] + 1)] if inside and inside[-1][0] == length else [*inside, (length, 1)]
            state = tuple(x - y for x, y in zip(state, need))
            if state[0] and state[1] and state[2]:
                content[state].append([take, filled])
            else:
                done.append((take, filled))
            left -= take
    return done + [(number, inside) for bins in content.values() for number, inside in bins]


def runs(packed: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of bins, first sequence, offset of its first piece, pieces in each bin) of each run of ranks."""
    out, rank, sequence = [], defaultdict(int), 0
    for number, inside in packed:
        offset = 0
        for length, each in inside:
            out.append((length, rank[length], number, sequence, offset, each))
            rank[length] += number * each
            offset += length * each
        sequence += number
    return out


def pack(cut: DataFrame, tokens: int = 1024, documents: int = 1024, attention: int | None = None, rule: str = "residual", rows_a_salt: int = 200_000) -> DataFrame:
    """Give each piece (PIECES) a sequence_id and an offset. documents and attention bound each sequence besides its tokens."""
    spark = cut.sparkSession
    attention = attention or tokens * tokens
    cut = materialize(cut, "pieces")
    full = cut.where(F.col("length") == tokens)
    part = cut.where(F.col("length") < tokens)
    salts = 8 + part.count() // rows_a_salt
    part = part.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(salts)).cast("int"))
    counts = materialize(part.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length, fewer than tokens
    found = runs(best_fit(histogram, tokens, documents, attention, rule))
    places = spark.createDataFrame(found, "p_length long, first long, bins long, sequence long, at long, each long") if found else spark.createDataFrame([], "p_length long, first long, bins long, sequence long, at long, each long")
    opened = max((s + n for _, _, n, s, _, _ in found), default=0)

    # the ranks before a salt's: a length's salts in order; a row a salt, so the window is short
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid", "piece")) - 1
    ranked = part.withColumn("own", rank).join(base, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
    # a length has one run of ranks for each group of equal bins: look it up by binary search in its sorted starts
    starts = places.groupBy("p_length").agg(F.array_sort(F.collect_list(F.struct("first", "bins", "sequence", "at", "each"))).alias("runs"))
    at = F.expr("aggregate(sequence(1, 20), struct(0 as lo, size(runs) as hi), (s, i) -> if(s.hi - s.lo <= 1, s, if(element_at(runs, cast((s.lo + s.hi) div 2 as int) + 1).first <= rank, struct(cast((s.lo + s.hi) div 2 as int) as lo, s.hi as hi), struct(s.lo as lo, cast((s.lo + s.hi) div 2 as int) as hi))), s -> runs[s.lo])")
    placed = ranked.join(F.broadcast(starts), F.col("length") == F.col("p_length")).withColumn("run", at).withColumn("k", F.col("rank") - F.col("run.first"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    small = placed.select(*columns, F.expr("run.sequence + k div run.each").alias("sequence_id"), F.expr("run.at + (k % run.each) * length").alias("offset"))
    # a full piece is a sequence by itself: any number that is not taken
    large = full.select(*columns, (F.monotonically_increasing_id() + F.lit(opened)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(large)
