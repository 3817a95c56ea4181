"""op9's Arrow stages hold a small part of a group as split words, and the portions don't show in the result."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from tallyframe.llm import bpe  # noqa: E402
from tallyframe.llm.tokens import default_path, tokenizer_pattern  # noqa: E402

RANKS = default_path("byte_bpe_50k.tiktoken")

#: Runs a task's rows through _distinct in a process of its own, and prints by how many MB that raised its peak.
TASK = """
import random, resource, types
import pyarrow as pa, pyspark
from tallyframe.llm import bpe
from tallyframe.llm.tokens import tokenizer_pattern
pyspark.TaskContext.get = staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0))
rnd = random.Random(5)
text = lambda: " ".join(f"{rnd.randrange(10**6)}" if rnd.random() < 0.2 else f"w{rnd.randrange(10**4)}" for _ in range(400)) + " \\n"
rows = pa.record_batch([pa.array([text() for _ in range(6000)])], names=["text"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before, made = peak(), 0
for batch in bpe._distinct(tokenizer_pattern(), 12 << 20, 64)(iter([rows])):
    made += batch.num_rows
assert made >= 64 and rows.nbytes > 12 << 20
print(peak() - before)
"""


def test_room_of_a_group():
    ran = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=300)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 100


def test_portions_of_a_few_bytes(spark, monkeypatch):
    library = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinß1,'.\n中 ") for _ in range(rnd.randint(1, 7)))
    rows = list(enumerate([None, "", " ", "\n", "one", " one  two", "x" * 300, *(" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(150)), None, ""]))
    monkeypatch.setattr(bpe, "A_TIME", 90)
    monkeypatch.setattr(bpe, "STEP", 3)
    got = Counter(tuple(r) for r in bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, tokenizer_pattern()).collect())
    want = Counter()
    for i, text in rows:
        ids = np.asarray(library.encode_ordinary(text or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want


@pytest.mark.parametrize("step", [1, 7, 20_000])
def test_buckets_of_portions(monkeypatch, step):
    import pyarrow as pa

    words = pa.array([f" {k * k}".encode() for k in range(1, 200)], pa.binary()).slice(20)
    whole = bpe._hashed(words, 13).tolist()
    monkeypatch.setattr(bpe, "STEP", step)
    assert bpe._hashed(words, 13).tolist() == whole
