"""Threshold-scaled sketches: all shingle hashes below a fixed fraction of the hash range.

A shingle is five words, separated by ASCII white space; a text with fewer words is one shingle. The fraction is 1 / 2**level, and a
text's level follows from the number of its distinct shingles: 0 (all hashes) up to KEEP of them, one more for each doubling, and
LEVELS at most. So a short text keeps all it has and a long one an eighth, and no hash above its sketch's threshold is ever kept.
Two sketches are compared, or merged by a union, below the lower of their thresholds; what they have in common there estimates
resemblance, and containment also where one text is far longer than the other. Where that leaves nothing of the sketches to compare
there is no evidence, and the estimates are null.

All work is done by DataFrame functions in the JVM. The word hashes of a text are computed once, and a shingle's hash is the hash
of its five word hashes.

Defined cases: a null text counts as empty; two texts without words are alike (1), one without and another are not (0). Rows that
share a doc_id follow each other in any order; a null doc_id comes first; repeated rows are rows each; a table of one row is its own
next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyframe.llm.common import ASCII_SPACE, literal, numbered, parts_for, ranges, text_of

WORDS = 5
KEEP = 64
LEVELS = 3
ROW = "__sketch_row"
#: Bytes of input for each range of doc_id.
RANGE_BYTES = 128 << 20


def threshold(level: Column) -> Column:
    """Hashes (signed) of 1 / 2**level of the range are below it; null at level 0, where all are."""
    return F.get(F.array(F.lit(None).cast("long"), *(F.lit(-(2**63) + 2 ** (64 - k)) for k in range(1, LEVELS + 1))), level)


def _below(hashes: Column, level: Column) -> Column:
    return F.when(level == 0, hashes).otherwise(F.transform(F.array(threshold(level)), lambda t: F.filter(hashes, lambda h: h < t))[0])


def with_sketch(df: DataFrame, text: Column, out: str, n: int = WORDS, keep: int = KEEP, levels: int = LEVELS) -> DataFrame:
    """Add ``out``: struct of the level and the sorted hashes below its threshold (array<long>)."""
    words, hashes, full, level = (f"__{out}_{x}" for x in "whsl")
    shingle = ", ".join(f"{hashes}[i + {k}]" if k else f"{hashes}[i]" for k in range(n))
    df = df.withColumn(words, F.array_remove(F.split(text, f"{ASCII_SPACE}+"), ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    df = df.withColumn(full, F.array_distinct(F.expr(f"CASE WHEN size({hashes}) = 0 THEN {hashes} WHEN size({hashes}) < {n} THEN array(aggregate({hashes}, 0L, (a, h) -> xxhash64(a, h))) ELSE transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({shingle})) END"))).drop(hashes)
    df = df.withColumn(level, sum(((F.size(full) > (keep << k)).cast("int") for k in range(1, levels)), (F.size(full) > keep).cast("int")))
    return df.withColumn(out, F.struct(F.col(level).alias("level"), F.array_sort(_below(F.col(full), F.col(level))).alias("hashes"))).drop(full, level)


def _wordless(a: str) -> Column:
    return (F.col(a)["level"] == 0) & (F.size(F.col(a)["hashes"]) == 0)


def _met(a: str, b: str) -> Column:
    """The hashes of both sketches below the lower threshold, as a struct (x, y)."""
    level = F.greatest(F.col(a)["level"], F.col(b)["level"])
    return F.struct(_below(F.col(a)["hashes"], level).alias("x"), _below(F.col(b)["hashes"], level).alias("y"))


def _shared(met: Column) -> Column:
    return F.size(F.array_intersect(met["x"], met["y"]))


def resemblance(a: str, b: str, met: Column | None = None) -> Column:
    """Estimated share of the shingles of either text that both have; null without evidence. met: a column of _met(a, b), if at hand."""
    both, either = _shared(_met(a, b) if met is None else met), evidence(a, b, met)
    return F.when(_wordless(a) | _wordless(b), (_wordless(a) & _wordless(b)).cast("double")).otherwise(both / F.when(either > 0, either))


def containment(a: str, b: str, met: Column | None = None) -> Column:
    """Estimated share of the shingles of text a that text b has as well; null without evidence."""
    met = _met(a, b) if met is None else met
    return F.when(_wordless(a), F.lit(1.0)).otherwise(_shared(met) / F.when(F.size(met["x"]) > 0, F.size(met["x"])))


def evidence(a: str, b: str, met: Column | None = None) -> Column:
    """How many hashes of either sketch a comparison rests on."""
    met = _met(a, b) if met is None else met
    return (F.size(met["x"]) + F.size(met["y"]) - _shared(met)).cast("long")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts taken together, below the lower of the two thresholds."""
    level = F.greatest(a["level"], b["level"])
    return F.struct(level.alias("level"), F.array_sort(F.array_union(_below(a["hashes"], level), _below(b["hashes"], level))).alias("hashes"))


def as_hex(sketch: str) -> Column:
    """The level, and the hashes; empty for a text without words."""
    listed = F.array_join(F.transform(F.col(sketch)["hashes"], lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")
    return F.when(_wordless(sketch), F.lit("")).otherwise(F.concat(F.col(sketch)["level"].cast("string"), F.lit(":"), listed))


def in_order(rows: DataFrame, parts: int, doc_id: str = "doc_id", row: str = ROW) -> tuple[DataFrame, WindowSpec]:
    """Rows and a window in which lead() is the row that follows by doc_id; the last row is followed by the first.

    Marked rows (__extra = 1) are only there to be followed to and are to be dropped after. ``row`` numbers the rows (numbered()).

    Ranges of (doc_id, hash of the row's number) are windows of their own, so a doc_id that many rows share is dealt over ranges as
    well; the first row of each range is also dealt, marked, to the range before it. The ranges are of fixed size, and the driver sees
    their first keys only.
    """
    keyed = rows.withColumn("__at", F.coalesce(doc_id, F.expr("-9223372036854775808L"))).withColumn("__mix", F.xxhash64(row))  # of one long: no two rows have the same
    b, firsts = ranges(keyed, parts, "__at", "__mix")
    dealt = keyed.withColumn("__b", b)
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("extra"))
    if firsts:
        first = (F.get(literal(f[0] for f in firsts), F.col("__b")) == F.col("__at")) & (F.get(literal(f[1] for f in firsts), F.col("__b")) == F.col("__mix"))
        before = F.struct(F.pmod(F.col("__b") - 1, F.lit(len(firsts))).alias("b"), F.lit(1).alias("extra"))
        dealt = dealt.withColumn("__to", F.when(first, F.array(own, before)).otherwise(F.array(own)))
    else:
        dealt = dealt.withColumn("__to", F.array(own))
    dealt = dealt.withColumn("__to", F.explode("__to")).withColumn("__b", F.col("__to.b")).withColumn("__extra", F.col("__to.extra")).drop("__to")
    return dealt, Window.partitionBy("__b").orderBy("__extra", "__at", "__mix")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every text's sketch beside that of its edited form (its last quarter replaced by the start of the next text).

    near_edited and near_next are 0 where there is no evidence; evidence_edited and evidence_next tell how many hashes they rest on.
    """
    docs = numbered(docs, ROW, "numbered")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), ROW)
    parts = parts_for(docs, range_bytes)
    dealt, by = in_order(rows, parts)
    # a range is a partition, and the shuffle carries texts only: sketches are made beyond it
    dealt = dealt.repartitionById(parts, "__b").select("doc_id", "text", "__b", "__extra", "__at", "__mix")
    sketched = with_sketch(dealt, F.col("text"), "sketch")
    follow = sketched.select("doc_id", "text", "sketch", "__extra", F.lead("text").over(by).alias("next"), F.lead("sketch").over(by).alias("next_sketch")).where("__extra = 0")
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k))
    follow = follow.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    out = with_sketch(follow, F.col("edited"), "edited_sketch")
    out = out.withColumn("e", _met("sketch", "edited_sketch")).withColumn("f", _met("sketch", "next_sketch"))
    e, f, backwards = F.col("e"), F.col("f"), F.struct(F.col("f.y").alias("x"), F.col("f.x").alias("y"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex("sketch").alias("fingerprint"), as_hex("edited_sketch").alias("edited_fingerprint"),
        F.coalesce(resemblance("sketch", "edited_sketch", e), F.lit(0.0)).alias("near_edited"), F.coalesce(resemblance("sketch", "next_sketch", f), F.lit(0.0)).alias("near_next"),
        containment("sketch", "edited_sketch", e).alias("kept_in_edited"), containment("next_sketch", "sketch", backwards).alias("next_in_text"),
        evidence("sketch", "edited_sketch", e).alias("evidence_edited"), evidence("sketch", "next_sketch", f).alias("evidence_next"),
    )
