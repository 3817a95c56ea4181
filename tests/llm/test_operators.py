"""The corpus operators against brute force, and on rows that are odd."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.llm import bpe, exact_dedup, langid, licenses, packing, pii, sharding, simhash, sketch, token_files  # noqa: E402
from tallyframe.llm.tokens import Encoder, default_path, tokenizer_pattern  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, part int, size string"
SPACE = r"[\x20\x09-\x0D]"
JSON, RANKS = default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken")


def made(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(("the", "er", "on", "an", "re", "ß", "é", "st")) for _ in range(rnd.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.choice((1, 2, 4, 30, 200)))) for _ in range(n)]
    texts += [texts[5], texts[5].replace(" ", "\n"), texts[6] + " more", texts[7].upper()]
    return texts


ODD = [None, "", " \n\t ", "word", "word", "two words", "a" * 3000, "x " * 5000, "Ünï 😀 cödé　\x85 \x1c z", "tab\tend ", "  lead", "<|endoftext|> it's 12.5"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + made()
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), -1, "k", 7, "s") for i, t in enumerate(texts)]
    rows += [rows[4], rows[20], (None, "no id here", None, None, None, None, None, None, None)]  # repeated rows, nulls everywhere
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def first(i):
    return (i is None, i if i is not None else 0)


# exact dedup ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bits", [1 << 30, 1 << 16])
def test_exact_dedup(docs, nothing, bits):
    groups = {}
    for i, t in pairs(docs):
        groups.setdefault(re.sub(SPACE, "", t), []).append((-len(t), first(i), i))
    want = Counter()
    for norm, members in groups.items():
        keep = min(members)[2]
        done = False
        for size, _, i in sorted(members):
            kept = not done
            done = True
            want[(i, keep, len(members), kept, hashlib.sha256(norm.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup.duplicate_groups(docs, max_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    stay = exact_dedup.drop_duplicates(docs, max_bits=bits)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.duplicate_groups(nothing).count() == 0 and exact_dedup.drop_duplicates(nothing).count() == 0


def test_bloom_passes_all_that_repeat(spark):
    keys = spark.createDataFrame([(i * 7919 % 5000,) for i in range(7000)], "key long").selectExpr("xxhash64(key) AS key")
    twice, bits = exact_dedup.repeated_filter(keys, 7000)
    all_keys = np.array([r.key for r in keys.collect()], np.int64)
    at = exact_dedup.positions(all_keys.view(np.uint64), bits)
    maybe = ((twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
    times = Counter(all_keys.tolist())
    again = np.array([times[k] > 1 for k in all_keys.tolist()])
    assert maybe[again].all() and (maybe & ~again).sum() < 0.05 * (~again).sum()


# simhash ----------------------------------------------------------------------------------------------------------------------
def slow_print(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Least member of each fingerprint's component, by all pairs."""
    known = sorted(set(prints))
    root = {p: p for p in known}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in known}


def test_simhash(docs, nothing):
    own = pairs(docs)
    prints = [slow_print(t) for _, t in own]
    assert [simhash.fingerprint(t) for _, t in own] == prints
    roots = linked(prints)
    least = {}
    for (i, _), p in zip(own, prints):
        least[roots[p]] = min(least.get(roots[p], (True, 0)), first(i))
    want = Counter((i, p, None if least[roots[p]][0] else least[roots[p]][1]) for (i, _), p in zip(own, prints))
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns and stay.count() == len(set(roots.values()))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_links_are_whole_in_buckets_of_any_size(spark, bucket):
    rnd = random.Random(5)
    known = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            known.add(base ^ sum(1 << b for b in rnd.sample(range(0, 64, 5), rnd.randint(0, 3))))
    signed = [p - 2**64 if p >> 63 else p for p in known]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys(range(300), 0) | {1000: 1000, 1001: 1000}


# tokens -----------------------------------------------------------------------------------------------------------------------
def test_encoder_is_the_library():
    encode = Encoder(JSON, tokenizer_pattern(), pieces=50)
    rnd = random.Random(4)
    letters = "ab. ,\n\t'sé1   \x1c　中-<|endoftext|>A9\x85ß"
    for text in [t or "" for t in ODD] + made() + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 16))) for _ in range(3000)]:
        assert encode(text) == (encode.whole(text) if text else b""), text


def ids_of(encode, text):
    return np.frombuffer(encode.whole(text) if text else b"", "<u4")


def test_packing(docs, nothing):
    encode = Encoder(JSON, tokenizer_pattern())
    rows = packing.pack(packing.pieces(docs, JSON, tokenizer_pattern(), 2, 128), 128).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    texts = dict(pairs(docs))
    for i, own in by.items():
        ids = np.r_[ids_of(encode, texts[i]), 2].astype("<u4")
        assert sum(r.length for r in own) % len(ids) == 0
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert all(r.length == 128 for r in own if r.piece)  # only the first may be shorter
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.05 * -(-total // 128) + 1
    assert packing.pack(packing.pieces(nothing, JSON, tokenizer_pattern(), 2, 128), 128).count() == 0


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rnd = random.Random(6)
    histogram = Counter(rnd.randint(1, 40) for _ in range(2000))
    seen = Counter()
    for number, inside in packing.best_fit(dict(histogram), 64, 5, 1800, rule):
        assert sum(n * k for n, k in inside) <= 64 and sum(k for _, k in inside) <= 5 and sum(n * n * k for n, k in inside) <= 1800
        for n, k in inside:
            seen[n] += number * k
    assert seen == histogram
    with pytest.raises(ValueError):
        packing.best_fit({50: 1}, 64, 5, 1800, rule)


def test_token_files(spark, docs, nothing, tmp_path):
    encode = Encoder(JSON, tokenizer_pattern())
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, JSON, tokenizer_pattern(), 0, parts=3)
    got = token_files.checked(spark, path).collect()
    at = 0
    ordered = sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for r, (i, text) in zip(sorted(got, key=lambda r: (r.start)), ordered):
        ids = np.r_[ids_of(encode, text), 0].astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(ordered)
    some = {r.doc_id: r.token_ids for r in token_files.read_tokens(spark, path, 14, 16).collect()}
    assert set(some) == {14, 15, 16} and some[14] == [*map(int, ids_of(encode, dict(pairs(docs))[14])), 0]
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan
    token_files.write_tokens(nothing, path + "0", JSON, tokenizer_pattern(), 0)
    assert token_files.checked(spark, path + "0").count() == 0


def test_bpe_folds(docs, nothing):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})

    def want(i, text):
        ids = np.asarray(library.encode_ordinary(text), "<u4")
        return i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    got = Counter(tuple(r) for r in bpe.encoded(docs, RANKS, tokenizer_pattern()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == Counter(want(i, t) for i, t in pairs(docs))
    assert bpe.encoded(nothing, RANKS, tokenizer_pattern()).count() == 0


# sharding ---------------------------------------------------------------------------------------------------------------------
def test_ring_in_order_of_keys(docs, nothing):
    rows = sharding.bounded_ring(docs, 7, 16).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(7)) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    texts = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in pairs(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    assert sharding.bounded_ring(nothing, 7, 16).count() == 0


def test_ring_moves_little(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    before = {r.doc_id: r.shard for r in sharding.bounded_ring(docs, 10).collect()}
    after = {r.doc_id: r.shard for r in sharding.bounded_ring(docs, 11).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.35 * len(before)  # a modulo would move ten of eleven


def test_deal_by_hand():
    assert sharding.deal({0: 5, 1: 1, 2: 0}, [0, 1, 2], 3) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 1, 1, 1), (0, 3, 2, 2, 0)]


# sketches ---------------------------------------------------------------------------------------------------------------------
def test_sketches(docs, nothing):
    ordered = sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    rows = sketch.fingerprints(docs).collect()
    want = Counter()
    for k, (i, text) in enumerate(ordered):
        q = len(text) // 4
        want[(i, len(text), hashlib.sha256((text[: len(text) - q] + ordered[(k + 1) % len(ordered)][1][:q]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by_text = {}
    texts = dict(pairs(docs))
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert bool(r.fingerprint) == bool(re.sub(SPACE, "", texts[r.doc_id]))
    assert sketch.fingerprints(nothing).count() == 0
    assert sketch.fingerprints(docs.where("doc_id = 3")).first().near_next == 1


def test_sketch_estimates(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(4000)]
    a, b = " ".join(words), " ".join(words[1000:3000])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, df.a, "s"), df.b, "t")
    r = df.select(sketch.containment("t", "s").alias("c"), sketch.resemblance("s", "t").alias("r"), sketch.merged(df.s, df.t).alias("m"), "s").first()
    assert r.c == 1 and r.r == pytest.approx(0.5, abs=0.08) and r.m == r.s


# personal data ----------------------------------------------------------------------------------------------------------------
def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark, docs, nothing):
    rnd = random.Random(9)
    bits = ["a@b.co", "@", ".", "-", "_", "1.2.3.4", "255", "999", " ", "+1 (743) 555-3824", "4111 1111 1111 1111", "x", "😀", "4", "(", ")", "+", "0001.2.3.4.5", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(1500)] + ["a@b.c_d@e.f", "a@b.c-d@e.f", "a@b." + "c." * 3000 + "d", "1" * 5000, "1 " * 4000, "+1" + " " * 3000]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (odd, docs.select("doc_id", "text")):
        by = dict(pairs(df))
        for r in pii.find(df).collect():
            want = base_spans(by[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), by[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]
            assert set(want) <= set(filter(None, r.spans.split(",")))
    assert pii.find(nothing).count() == 0


def test_pii_adds_and_redacts(spark):
    texts = ["write to jane [at] example [dot] org today", "call (743) 555-3824 now", "order 743-555-38241 shipped", "mail a@b.co and +1 (743) 555-3824.", "nothing", None]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert spans[0].startswith("email:") and spans[1].startswith("phone:") and spans[2] == "" and spans[4] == "" and spans[5] == ""
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[3].text == "mail [EMAIL] and [PHONE]." and out[3].n_chars == len(out[3].text)
    assert out[1].text == "call [PHONE] now" and out[4].text == "nothing" and out[5].text is None


def test_pii_model_holds_out(spark):
    _, thresholds = pii.scorer(spark)
    assert sum(t < float("inf") for t in thresholds) >= 3


# language ---------------------------------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(small.where("doc_id % 2 = 0"))
    held = small.where("doc_id % 2 = 1 AND n_chars > 60")
    from pyspark.sql import functions as F

    none = F.lit("")
    got = {r.key: r.lang for r in langid.identify(held, model, "doc_id", F.col("text"), none, none, none, none).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_language_fuses_evidence(spark):
    pages = [(i, f"https://a{i % 3}.example.com/{i}", f'<html lang="de-AT"><body>{t}</body></html>') for i, t in enumerate(["der Hund und die Katze sind nicht mehr hier", "das ist eine Frage für den Mann"] * 20)]
    pages += [(100, "https://a1.example.com/x", "<html><script>var the = of;</script></html>"), (101, None, None), (102, "https://q.example.net/", '<html lang="en"><p>the cat was not there</p></html>')]
    got = {r.key: r for r in langid.pages_language(spark.createDataFrame(pages, "page_id long, url string, html string"), langid.fit()).collect()}
    assert len(got) == len(pages) and got[0].lang == "de" and got[102].lang == "en"
    assert got[100].lang == "de" and got[100].text_lang == langid.UND  # the host alone speaks


def test_language_keeps_known(spark, docs, nothing):
    model = langid.fit()
    rows = [(1, "the house and the garden were there for all of us", "en", "s", 3), (2, "qx zzkw vvqj xxzq jjwk qqzx wvkj zzxq", None, None, None), (3, "", None, None, None), (4, "la casa de los abuelos", "es", "s", 1), (4, "la casa de los abuelos", "es", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = langid.keep_known(df, model)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 4, 4]
    assert langid.keep_known(docs, model).columns == docs.columns and langid.keep_known(nothing, model).count() == 0


# licenses ---------------------------------------------------------------------------------------------------------------------
def test_alignment_is_common_subsequence():
    rnd = random.Random(10)
    for _ in range(300):
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        c = rnd.sample("abcdefghijkl", rnd.randint(0, 12))
        assert len(licenses.align(c, c)) == len(c)


def test_increasing():
    rnd = random.Random(11)
    for _ in range(200):
        v = rnd.sample(range(30), rnd.randint(0, 9))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        got = [v[i] for i in licenses.increasing(v)]
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_licenses(spark, docs, nothing):
    mit = licenses.TEMPLATES["MIT"]
    broken = mit.split()
    broken[10], broken[40] = "XX", "YY"
    texts = ["see " + mit, " ".join(broken), "Released under the MIT License. Released under the MIT License.\nReleased under the MIT License.", "filler " * 3000 + "Licensed under CC BY-NC 4.0." + " filler" * 3000, "the license of the version is a license", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage))
        assert texts[r.doc_id][r.start : r.end]
    assert got[0] == [("MIT", 1.0)] and got[1][0][0] == "MIT" and 0.95 < got[1][0][1] < 1
    assert got[2] == [("MIT-line", 1.0)] * 3 and got[3] == [("CC-BY-NC-4.0-line", 1.0)] and set(got) == {0, 1, 2, 3}
    assert licenses.scan(docs).count() == 0 and licenses.scan(nothing).count() == 0


def test_license_prefilter_loses_nothing():
    scan = licenses.Scanner(licenses.TEMPLATES)
    for name, own in scan.templates.items():
        rest = [w for w in own if w not in scan.rare[name]]
        assert len(rest) < scan.least * len(own)


# pipeline ---------------------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(SPACE, "", t), []).append((-len(t), i, t))
    once = {min(g)[1]: min(g)[2] for g in groups.values()}
    prints = {i: slow_print(t) for i, t in once.items()}
    roots = linked(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert {r.doc_id for r in rows} == set(least.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.createDataFrame([], SCHEMA)
        assert stage(spark, empty, sf).columns == empty.columns
