"""Sketches against brute force, and containment of short texts in long ones."""

import random
import re
import struct

import xxhash

from tallyframe.llm import sketch

MASK = 2**64 - 1


def hashed(values, first=None):
    """Spark's xxhash64 of longs, each with the hash before it as the seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<Q", v & MASK), seed=seed).intdigest()
    return seed


def shingles(text):
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return set()
    if len(words) < 5:
        total = 0
        for w in words:
            total = hashed((total, w))
        return {total}
    return {hashed(words[i : i + 5]) for i in range(len(words) - 4)}


def below(hashes, level):
    return {h for h in hashes if (h + 2**63) & MASK < 2 ** (64 - level)}


def slow(text):
    full = shingles(text)
    level = sum(len(full) > 64 * 2**k for k in range(3))
    return level, below(full, level)


def alike(a, b):
    if not a[1] and not a[0] or not b[1] and not b[0]:
        return float(a == b)
    level = max(a[0], b[0])
    x, y = below(a[1], level), below(b[1], level)
    return len(x & y) / len(x | y) if x | y else 0.0


def printed(s):
    signed = sorted((h - 2**64 if h >> 63 else h) for h in s[1])
    return "" if s == (0, set()) else f"{s[0]}:" + ",".join(f"{h & MASK:016x}" for h in signed)


def texts(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(1, 5)))
    out = [" ".join(word() for _ in range(rnd.choice((0, 1, 3, 5, 6, 40, 68, 69, 140, 270, 600, 900)))) for _ in range(120)]
    out += [out[7], out[9] + " tail", "x " * 2000, "x\t\n" * 3, "", " \n "]
    rnd.shuffle(out)
    return out


def check(spark, rows, range_bytes):
    """rows: (doc_id, text) in order."""
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    got = {r.doc_id: r for r in sketch.fingerprints(spark.createDataFrame(shuffled, "doc_id long, text string"), range_bytes=range_bytes).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = slow(text), slow(edited), slow(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (printed(a), printed(b))
        assert abs(r.near_edited - alike(a, b)) < 1e-12 and abs(r.near_next - alike(a, c)) < 1e-12


def test_against_brute_force(spark):
    rows = list(zip(range(-5, 1000, 7), texts()))
    check(spark, rows, 16 << 20)
    check(spark, rows, 2000)  # many ranges


def test_one_doc_id_in_many_ranges(spark):
    rows = [(None if k % 3 else 7, f"text {k % 11} and more of it") for k in range(900)]
    out = sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=500).collect()
    assert sorted(r.doc_id is None for r in out) == sorted(i is None for i, _ in rows)


def test_containment_of_short_in_long(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(400):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(606)]
        at = rnd.randrange(600)
        rows.append((k, " ".join(words[at : at + 6]), " ".join(words), "six words of another text entirely"))
    df = spark.createDataFrame(rows, "k int, short string, long string, other string")
    for name in ("short", "long", "other"):
        df = sketch.with_sketch(df, df[name], f"{name}_s")
    got = df.select(sketch.containment("short_s", "long_s").alias("inside"), sketch.containment("other_s", "long_s").alias("outside"), sketch.evidence("short_s", "long_s").alias("n")).collect()
    told = [r.inside for r in got if r.inside is not None]
    assert told and sum(told) >= 0.9 * len(told)
    assert all(r.outside in (None, 0.0) for r in got)
    assert len(told) < len(got)  # a hash of the two is below the long text's threshold or not: the rest is no evidence, not zero


def test_merged_and_unequal_levels(spark):
    words = [f"w{k}" for k in range(900)]
    rows = [(" ".join(words[:700]), " ".join(words[600:760]), " ".join(words[:760]))]
    df = spark.createDataFrame(rows, "a string, b string, whole string")
    for name in ("a", "b", "whole"):
        df = sketch.with_sketch(df, df[name], f"{name}_s")
    r = df.select(sketch.merged(df.a_s, df.b_s).alias("m"), "whole_s").first()
    assert r.m == r.whole_s
