"""Operators that drop rows, on input that is shuffled anew each time it is read."""

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bpe, common, exact_dedup, langid, near_texts, sharding, simhash
from tallyframe.llm.tokens import default_path, tokenizer_pattern

N = 2000


@pytest.fixture
def shuffled(spark):
    """2,000 rows, 1,000 texts, a wide column that a pruned plan doesn't carry, and partitions that follow from sizes."""
    known = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in known}
    for k, v in known.items():
        spark.conf.set(k, v)
    words = "the house and the garden were there for all of us"
    rows = spark.range(N).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 == 3, F.concat(F.lit("qx zzkw vvqj xxzq jjwk qqzx wvkj "), (F.col("id") % 1000).cast("string"))).otherwise(F.concat(F.lit(words + " "), (F.col("id") % 1000).cast("string"))).alias("text"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
        F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("wide"),
    )
    yield rows.repartition("doc_id")
    for k, v in before.items():
        spark.conf.set(k, v)


def test_exact(shuffled):
    kept = [(r.doc_id, r.text, r.wide) for r in exact_dedup.drop_duplicates(shuffled).collect()]
    every = {r.doc_id: (r.doc_id, r.text, r.wide) for r in shuffled.collect()}
    assert sorted(kept) == [every[i] for i in range(1000)]


def test_near(shuffled):
    want = {}
    for r in simhash.near_duplicates(shuffled).collect():
        want[r.component_id] = min(want.get(r.component_id, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in simhash.one_of_each(shuffled).collect()) == sorted(want.values())


def test_near_texts(shuffled):
    # texts differ in their last word: 6 of 8 shingles in common (0.75) or 2 of 4
    assert sorted(r.doc_id for r in near_texts.one_of_each(shuffled).collect()) == list(range(1000))


def test_language(shuffled):
    kept = sorted(r.doc_id for r in langid.keep_known(shuffled, langid.fit()).collect())
    assert kept == [i for i in range(N) if i % 4 != 3]


def test_bpe(shuffled):
    ranks, pattern = default_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    import hashlib

    got = {r.doc_id: r.decoded_sha256 for r in bpe.encoded(shuffled, ranks, pattern).collect()}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in shuffled.collect()}


def test_files_are_numbered_in_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert common._is_files(docs) and not common._is_files(docs.repartition(3)) and not common._is_files(docs.where("doc_id > 3"))
    rows = common.numbered(docs, "n", "docs")
    assert common.size_of(rows) < 10**8 and int(spark.conf.get(common.SPLITS)) > 0  # the loss of an executor doesn't move the splits
    assert [r.n for r in rows.select("n").collect()] == [r.n for r in rows.collect()]


def test_equal_rows_share_a_place(spark):
    """A third of all rows are one row; another third are two thousand times one doc_id and text each."""
    from collections import Counter

    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, id % 2, id)) AS doc_id", "if(id % 3 = 2, cast(id AS string), 'same') AS text")
    got = sharding.bounded_ring(rows.repartition(5), 40, 128).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 9000 and set(counts.values()) == {225}
    assert Counter((r.shard, r.slot) for r in got) == Counter((s, k) for s in range(40) for k in range(225))
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows.collect())
