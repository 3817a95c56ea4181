"""Ids against the library as it comes."""

import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tallyframe.llm import packing  # noqa: E402
from tallyframe.llm.tokens import Encoder, default_path, tokenizer_pattern  # noqa: E402

JSON = default_path("byte_bpe_50k.json")
END = "<|endoftext|>"


def texts(seed=4, n=2500):
    rnd = random.Random(seed)
    letters = "ab. ,\n\t'sé1   \x1c　中-A9\x85ß"
    out = [None, "", " ", "  ", " a", "a ", "a\n", "word.\nNext one", f"a {END} b", END, f"x{END}{END} y", "don't  stop", "a" * 3000, "x " * 5000, " lead and trail "]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 18))) for _ in range(n)]
    words = ["the", "Ort.\nÉch", "tion,", "über", "中文", "12.5", END, "it's", "a\nb\nc", "end."]
    out += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("known, longest, most", [(1_200_000, 40, 8 << 20), (40, 40, 900), (5, 3, 20)])
def test_encoder_is_the_plain_library(known, longest, most):
    plain, encode, own = Tokenizer.from_file(JSON), Encoder(JSON, tokenizer_pattern(), known, longest), texts()
    got = [np.frombuffer(code.as_py(), "<u4").tolist() for codes in encode.batches(pa.array(own, pa.string()), b"\x07\0\0\0", most) for code in codes]
    assert len(got) == len(own)
    for text, ids in zip(own, got):
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 7], text


def test_slices_and_nothing():
    encode, column = Encoder(JSON, tokenizer_pattern()), pa.array(["a b", None, "c d e", "f"])
    assert list(encode.batches(column.slice(4))) == []
    assert [x.as_py() for codes in encode.batches(column.slice(2)) for x in codes] == [encode("c d e"), encode("f")]
    assert encode("") == b"" and encode(" ") == encode.whole(" ")


def test_added_tokens_keep_their_ids():
    encode = Encoder(JSON, tokenizer_pattern())
    assert np.frombuffer(encode(f"a {END} b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_packing_under_three_capacities(spark):
    """Sequences where documents and attention bind as well as tokens, through the whole operator."""
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(("a", "b", "c")) for _ in range(rnd.choice((1, 3, 5, 15, 20, 30, 60))))) for k in range(700)]
    plain = Tokenizer.from_file(JSON)
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), JSON, tokenizer_pattern(), 2, 64)
    packed = packing.pack(cut, tokens=100, documents=6, attention=4600, rows_a_salt=40).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    bound = [0, 0, 0]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        cost = sum(n * n for _, n in own)
        assert at <= 100 and len(own) <= 6 and cost <= 4600
        bound = [bound[0] + (at == 100), bound[1] + (len(own) == 6), bound[2] + (cost + (100 - at) ** 2 > 4600)]
    assert all(bound), bound  # each of the three stops some sequence
    assert sum(r.length for r in packed) == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
