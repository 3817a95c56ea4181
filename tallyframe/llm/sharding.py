"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at ``vnodes`` points of the ring, and a key belongs to the first point clockwise from its own. A shard that has
its share is full, and what overflows continues clockwise to the next point of a shard with room. The shares add up to the number
of rows and differ by one at most, so the counts do as well; a new shard or a lost one moves the rows of its points and what those
displace.

The rows between two points, an arc, are counted by a grouped sum; the driver walks over the arcs (shards * vnodes of them,
whatever the number of rows) and gives each the shards that take its ranks. A row then needs its rank in its arc only. Equal rows share
a place, and an arc with it; a place with a thousandth of all rows or more (there are a thousand at most) is dealt over ``SALTS`` by row
number, which of equal rows can be any order, and its rows rank after the arc's others.

Defined cases: a null text has no bytes and size 16; a null doc_id is a key like any other; repeated rows are rows each, and rows
that are equal in all respects are ranked in any order (they are the same); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, text_of

RING = 1 << 60
SALTS = 64
#: A place with this share of all rows is hot.
SHARE = 1000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in clockwise order."""
    return sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(vnodes))


def deal(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, number of rows, shard, first slot). counts: rows of each arc; owners: the shard of each arc's point."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, waiting = [], defaultdict(int)

    def give(arc: int, first: int, n: int, shard: int) -> None:
        out.append((arc, first, n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    left = {}
    for arc in sorted(counts):  # own rows first
        n = min(counts[arc], room[owners[arc]])
        if n:
            give(arc, 0, n, owners[arc])
        if counts[arc] > n:
            left[arc] = n
    # what overflows goes on clockwise together: a queue that passes each point at most twice
    queue: list[list[int]] = []
    for step in range(2 * len(owners) if left else 0):
        arc = step % len(owners)
        if step < len(owners) and arc in left:
            queue.append([arc, left[arc], counts[arc] - left[arc]])
        shard = owners[arc]
        while queue and room[shard]:
            own, first, n = queue[0]
            take = min(n, room[shard])
            give(own, first, take, shard)
            queue[0] = [own, first + take, n - take]
            if n == take:
                queue.pop(0)
    assert not queue and not any(room)
    return out


def bounded_ring(docs: DataFrame, shards: int = 40, vnodes: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; counts of shards differ by one at most."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    at, owners = [p for p, _ in points], [s for _, s in points]
    raw = F.encode(text_of(text), "utf-8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # the text counts for the place as well, so that a doc_id that many rows share is spread
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32").cast("binary"))
    place = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    # a point's arc: cells of the ring that hold a point's boundary are told apart by the exact comparison
    cells = 1 << 14
    low = [bisect.bisect_left(at, c * (RING // cells)) for c in range(cells)]
    inside = [at[low[c] : bisect.bisect_left(at, (c + 1) * (RING // cells))] for c in range(cells)]
    grid = spark.createDataFrame([(c, low[c], inside[c]) for c in range(cells)], "cell int, low int, inside array<long>")
    rows = rows.withColumn("place", place).withColumn("cell", F.expr(f"cast(place div {RING // cells} as int)")).join(F.broadcast(grid), "cell")
    rows = rows.withColumn("arc", F.expr(f"(low + size(filter(inside, p -> p < place))) % {len(at)}")).drop("cell", "low", "inside")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "arcs")
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most shards * vnodes rows
    dealt = spark.createDataFrame(deal(counts, owners, shards), "arc int, first long, n long, shard int, slot0 long")
    per_arc = dealt.groupBy("arc").agg(F.collect_list(F.struct("first", "n", "shard", "slot0")).alias("parts"))
    found = _ranked(rows, counts).join(F.broadcast(per_arc), "arc").withColumn("part", F.expr("filter(parts, p -> p.first <= rank and rank < p.first + p.n)[0]"))
    return found.select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("rank") - F.col("part.first") + F.col("part.slot0")).alias("slot"))


def _ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows with their rank in their arc: by place, hot places last. counts: rows of each arc."""
    least = max(sum(counts.values()) / SHARE, SHARE)
    full = [arc for arc, n in counts.items() if n >= least]  # a hot place is in one of these, SHARE at most
    places = rows.where(F.col("arc").isin(full)) if full else rows.limit(0)
    hot = materialize(places.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("place").alias("hot")), "hot")  # SHARE rows at most
    segments = rows.join(F.broadcast(hot), F.col("place") == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("rid"), F.lit(SALTS))).otherwise(F.lit(-1)))
    segments = segments.withColumn("hot", F.coalesce("hot", F.lit(-1)))
    sizes = segments.groupBy("arc", "hot", "salt").agg(F.count("*").alias("n"))  # shards * vnodes + SHARE * SALTS rows at most
    before = Window.partitionBy("arc").orderBy("hot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sizes.select("arc", "hot", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    rank = F.row_number().over(Window.partitionBy("arc", "hot", "salt").orderBy("place", "doc_id", "size", "text_crc32")) - 1
    return segments.withColumn("own", rank).join(F.broadcast(bases), ["arc", "hot", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
