"""The fused posterior of pages against numpy."""

import random
from collections import defaultdict

import numpy as np

from tallyframe.llm import langid


def slow(rows, model, least=0.5):
    """rows: (key, text, declared, suffix, host, domain), cleaned."""
    names = [*model.languages, langid.UND]
    width = len(names)
    logs = []
    for _, text, *_ in rows:
        own = langid.trigrams(text.encode())
        n = int((own != langid.BUCKETS).sum())
        total = model.weights[own].astype(np.float64).sum(axis=0)
        logs.append(np.round(total * min(1, langid.EVIDENCE / n) if n else total, 6))
    logs = np.array(logs)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    n, s = len(rows), p.sum(axis=0)

    def sums(keys):
        out, count = defaultdict(lambda: np.zeros(width)), defaultdict(int)
        for key, own in zip(keys, p):
            out[key] += own
            count[key] += 1
        return out, count

    post = logs.copy()
    for column in (2, 3):
        keys = [r[column] for r in rows]
        by, _ = sums(keys)
        for i, key in enumerate(keys):
            post[i] += np.log((np.maximum(by[key] - p[i], 0) + 0.5) / (np.maximum(s - p[i], 0) + 0.5 * max(2, len(by))))
    hosts, host_n = sums([(r[4], r[5]) for r in rows])
    domains, domain_n = sums([r[5] for r in rows])
    overall, k = (s + 1) / (n + width), langid.STRENGTH
    out = {}
    for i, r in enumerate(rows):
        parent = (np.maximum(domains[r[5]] - p[i], 0) + k * overall) / (domain_n[r[5]] - 1 + k)
        post[i] += np.log((np.maximum(hosts[r[4], r[5]] - p[i], 0) + k * parent) / (host_n[r[4], r[5]] - 1 + k))
        confidence = 1 / np.exp(post[i] - post[i].max()).sum()
        blank = p[i].max() == p[i].min()
        lang = langid.UND if blank and r[2] == "" and r[4] == "" or round(confidence, 6) < least else names[int(post[i].argmax())]
        out[r[0]] = lang, confidence
    return out


def test_posteriors(spark):
    rnd = random.Random(15)
    words = {k: v.split() for k, v in langid.SEEDS.items()}
    rows = []
    for i in range(240):
        lang = rnd.choice("en de fr es".split())
        host = f"h{rnd.randint(0, 9)}"
        text = " ".join(rnd.choice(words[rnd.choice([lang, lang, "en"])]) for _ in range(rnd.choice((0, 1, 3, 12, 300))))
        rows.append((i, text if rnd.random() < 0.9 else "qzx vwk zzq " * rnd.randint(1, 9), rnd.choice([lang, "", "en"]), rnd.choice(["com", lang, ""]), f"{host}.{lang}-site.com" if rnd.random() < 0.8 else "", f"{lang}-site.com"))
    rows += [(1000, "", "", "", "", ""), (1001, "the", "", "com", "one.example.com", "example.com")]
    model = langid.fit()
    df = spark.createDataFrame(rows, "key int, text string, declared string, suffix string, host string, domain string")
    from pyspark.sql import functions as F

    got = {r.key: (r.lang, r.confidence) for r in langid.identify(df, model, "key", *map(F.col, ("text", "declared", "suffix", "host", "domain"))).collect()}
    want = slow(rows, model)
    assert set(got) == set(want)
    for key, (lang, confidence) in want.items():
        assert abs(got[key][1] - confidence) < 1e-5, key
        assert got[key][0] == lang or abs(confidence - 0.5) < 1e-4, key
