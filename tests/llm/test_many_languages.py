"""Language identification with more labels than a task holds, and with a text that many rows share."""

import random

from tallyframe.llm import langid


def test_every_label_is_fitted(spark):
    rnd, rows = random.Random(2), []
    for k in range(70):
        code = f"{chr(97 + k // 26)}{chr(97 + k % 26)}x"
        some = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 7))) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(rnd.choice(some) for _ in range(60)), code, f"src{k}") for i in range(3 if k > 64 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    assert {r[2] for r in rows} <= set(model.languages)
    assert langid.keep_known(docs, model).count() == len(rows)


def test_sample_is_bounded_for_a_shared_text(spark, monkeypatch):
    rows = [(i, "one text that a third of the rows share" if i % 3 == 0 else f"text {i} of its own", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    seen = {}
    for number in (100, 300):
        model = langid.fit(docs, per_language=number)
        # trigrams of the shared text alone, over those of all rows: in a fair sample a third of the rows have them
        en = model.weights[:, model.languages.index("en")]
        bucket = langid.trigrams(b"third")[2]
        seen[number] = float(en[bucket] - en[langid.trigrams(b"text")[1]])
    assert abs(seen[100] - seen[300]) < 0.5 and all(-1.8 < x < -0.5 for x in seen.values()), seen
