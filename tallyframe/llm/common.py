"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space that the corpus contracts name.
ASCII_SPACE = r"[\x20\x09-\x0D]"

#: The folders of this driver, in the order they were made.
MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, opened by Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file:///tmp/checkpoints/tallyframe"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; it goes when the driver's JVM ends in good order."""
    path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    MADE.append(path)
    return path


def consume(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the folders that were made after the first ``since`` of MADE, but for the last ``keep``: nothing reads them any more."""
    gone = MADE[since : len(MADE) - keep]
    del MADE[since : len(MADE) - keep]
    for path in gone:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _is_files(df: DataFrame) -> bool:
    """Is df nothing but files as they are read?"""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("SubqueryAlias", "View"):
        plan = plan.child()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


SPLITS = "spark.sql.files.minPartitionNum"


def stable(df: DataFrame, what: str) -> DataFrame:
    """df with partitions that are the same, row by row, in every plan made of the result.

    How plain files are split depends on the files, the session's settings, and the number of cores where ``SPLITS`` is unset, which
    changes when executors come or go; so it is set to what it stands at. After a shuffle partitions depend on the sizes that a plan's
    columns happen to have, and on which task came first; so any other rows are written once.
    """
    spark = df.sparkSession
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, spark.sparkContext.defaultParallelism)
    return df if _is_files(df) else materialize(df, what)


def numbered(df: DataFrame, name: str, what: str) -> DataFrame:
    """df with a row number that stays the same in every plan made of the result."""
    if _is_files(df):
        return stable(df, what).withColumn(name, F.monotonically_increasing_id())
    return stable(df.withColumn(name, F.monotonically_increasing_id()), what)


def size_of(df: DataFrame) -> int:
    """The bytes of the files that df reads, as the optimizer knows them without a job; df: numbered() or materialize()."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, bytes_a_part: int) -> int:
    """How many partitions a shuffle of df takes for about so many bytes of its files each; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(df) // bytes_a_part))


#: A join side of so many rows may be broadcast; what a driver holds for it doesn't grow with the input.
FEW = 100_000


def join_hint(side: DataFrame) -> str:
    """The hint for a join with side, by the rows it has: broadcast if they are few, else a shuffle of both sides, which AQE splits.

    The optimizer would go by the bytes of compressed files, and take what explode makes for as many rows as it was made of.
    """
    return "broadcast" if side.limit(FEW + 1).count() <= FEW else "merge"


def literal(values, kind: str = "bigint") -> Column:
    """An array of numbers, or of strings without commas, that the optimizer folds to a literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def ranges(keyed: DataFrame, parts: int, at: str, mix: str) -> tuple[Column, list[tuple[int, int]]]:
    """The range (from 0) of a row by two longs, no two rows the same, and each range's first key; about ``parts`` equal ranges.

    Spark's range partitioner finds them on the two longs alone. The driver sees each range's first key, 16 bytes, and a row finds its
    range by binary search.
    """
    dealt = keyed.select(at, mix).repartitionByRange(parts, at, mix)
    firsts = sorted(tuple(r.first) for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(at, mix)).alias("first")).collect())
    if len(firsts) < 2:
        return F.lit(0), firsts
    ats, mixes = literal(f[0] for f in firsts), literal(f[1] for f in firsts)

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        upto = (F.get(ats, mid) < F.col(at)) | (F.get(ats, mid) == F.col(at)) & (F.get(mixes, mid) <= F.col(mix))
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.struct(F.when(upto, mid).otherwise(s["lo"]).alias("lo"), F.when(upto, s["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(firsts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(firsts)).alias("hi")), halved, lambda s: s["lo"]), firsts


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Join rows to one row per key without a task that holds all rows of a hot key.

    groups[size] is the number of rows with that key and total the number of all rows. A key with at least total / share
    rows is hot; there can be no more than ``share`` of those, so their groups are broadcast. The others are joined by a shuffle.
    """
    is_hot = F.col(size) * F.lit(share) >= F.lit(total)
    hot, rest = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
