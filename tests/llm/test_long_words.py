"""Byte-level BPE of words of any length, in groups of any size, against the library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from tallyframe.llm import bpe  # noqa: E402
from tallyframe.llm.tokens import default_path, tokenizer_pattern  # noqa: E402

RANKS = default_path("byte_bpe_50k.tiktoken")


def texts():
    rnd = random.Random(12)
    letters = "etaoinshrdlucmfw"
    word = lambda n, of=letters: "".join(rnd.choice(of) for _ in range(n))
    out = [word(n) for n in (63, 64, 65, 66, 70, 100, 300, 1500)] + ["a" * n for n in (64, 65, 66, 67, 1000)]
    out += [" " + word(80) + " " + word(90, "abc") + ", end", word(200, "ACGT"), word(70, "é中ß"), "aab" * 60, "=" * 200, "1234567890" * 30, "ab" * 100 + "a", "x" + " " * 90 + "y"]
    out += [None, "", " ", "\n", "one  two", "it's  a\n\nline ", " lead", "a <|endoftext|> b", "\x85\xa0 z"]
    return out + [" ".join(word(rnd.randint(1, 9)) + rnd.choice(("", ",", ".", ".\nNext", "'s", "!!")) for _ in range(rnd.randint(1, 60))) for _ in range(120)]


@pytest.mark.parametrize("group", [12 << 20, 700])
def test_words_of_any_length(spark, monkeypatch, group):
    library = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = list(enumerate(texts()))
    if group < 1000:  # groups of a few texts: the least group is a megabyte otherwise
        monkeypatch.setattr(bpe, "_distinct", lambda pattern, most, buckets, f=bpe._distinct: f(pattern, group, buckets))
        monkeypatch.setattr(bpe, "_folded", lambda most, f=bpe._folded: f(group))
    got = Counter(tuple(r) for r in bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, tokenizer_pattern()).collect())
    want = Counter()
    for i, text in rows:
        ids = np.asarray(library.encode_ordinary(text or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want


def test_decoding_concatenates_pieces(spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})
    own = [t or "" for t in texts()]
    df = spark.createDataFrame([(k, library.encode_ordinary(t)) for k, t in enumerate(own)], "k int, ids array<int>")
    got = {r.k: bytes(r.raw) for r in df.select("k", bpe.decode_ids(F.col("ids"), ranks).alias("raw")).collect()}
    assert got == {k: t.encode() for k, t in enumerate(own)}
