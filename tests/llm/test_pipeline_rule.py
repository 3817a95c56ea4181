"""The whole pipeline against brute force: which documents stay, and what is packed of them after redaction."""

import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_near_texts import slow_kept  # noqa: E402
from test_pii_candidates import slow_redacted  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tallyframe.llm import pii  # noqa: E402
from tallyframe.llm.tokens import default_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = {}
    for i, t in texts.items():  # all of them are in a known language
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    once = sorted(min(g)[1] for g in groups.values())
    kept = [once[k] for k in sorted(slow_kept([texts[i] for i in once]))]
    spans = {r.doc_id: [(a, int(b), int(c)) for a, b, c in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.find(docs).collect()}
    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = set()
    for i in kept:
        text = slow_redacted(texts[i], spans[i])
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at, upto, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want.add((i, piece, at, upto - at, zlib.crc32(ids[at:upto].tobytes())))
            at, upto, piece = upto, upto + 1024, piece + 1
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024
