"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each text: the likelihood of its character trigrams in each language, the declared markup
language, the suffix of its address, and a prior of its host. The reliability of the last three isn't assumed: grouped sums of the
texts' own posteriors give P(declared | language), P(suffix | language) and the host's prior. A host's prior is smoothed towards its
domain's, and that towards the corpus's. Each row's own part is taken out of the sums that it is judged by.

The hypothesis UND stands for text in no known language: its trigrams are equally likely. A text is rejected if UND wins or if no
language reaches ``least`` of the posterior.

The trigram model is fitted on a bounded sample of labelled rows (``per_language`` of each label, by hash of text and row) and on a few words of each
language, so that it exists without labels too.

Defined cases: a null text counts as empty; without a trigram only the other evidence counts; a text without any evidence is UND.
Null or unknown declarations, hosts and suffixes are one value each, which is learnt like any other. Repeated rows are rows each; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, numbered

UND = "und"
RID = "__language_row"
BUCKETS = 1 << 16
PER_LANGUAGE = 1000
#: Labels that a task counts at once; the sums of more go out in parts.
HELD = 64
SMOOTH = 0.05
#: Trigrams of a text that count in full; neighbours overlap, so a long text is not worth its length.
EVIDENCE = 100
#: The weight of a parent's prior, in rows.
STRENGTH = 10.0

#: Frequent words of each language.
SEEDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or had by not but what all were we when your can said there",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou si leur elle nous",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ha me si sin sobre este ya entre cuando",
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: bytes) -> np.ndarray:
    """The bucket of each trigram of letters (UTF-8 bytes, a run of others is one space); BUCKETS where its middle is a space."""
    a = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint32)
    a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
    if len(a) < 3:
        return np.zeros(0, np.int64)
    mixed = (a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:]) * np.uint32(2654435761)
    return np.where(a[1:-1] == 32, BUCKETS, mixed >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log likelihoods: a row for each bucket and one of zeros, a column for each language, and UND last."""

    languages: tuple[str, ...]
    weights: np.ndarray


def _parts(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for label, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([own.astype("<i8").tobytes()], pa.binary())], names=["label", "counts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.bincount(trigrams((text.as_py() or "").encode()), minlength=BUCKETS + 1)[:BUCKETS]
            sums[label] = sums.get(label, 0) + own
            if len(sums) > HELD:
                yield from _parts(sums)
                sums = {}
    yield from _parts(sums)


def _summed(tab: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in tab.column("counts"))
    return pa.table({"label": tab.column("label").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(labelled: DataFrame | None = None, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a sample of about ``per_language`` rows of each label, all labels."""
    counts = {k: np.bincount(trigrams(v.encode()), minlength=BUCKETS + 1)[:BUCKETS].astype(np.float64) for k, v in SEEDS.items()}
    if labelled is not None:
        rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).where(f"label is not null and label != '{UND}'")
        sizes = rows.groupBy("label").count().collect()
        share = F.create_map(*(F.lit(x) for r in sizes for x in (r["label"], per_language / r["count"]))) if sizes else None
        if sizes:
            # with the row's number, so that rows of one text are chosen apart
            chosen = rows.withColumn("rid", F.monotonically_increasing_id()).where(F.pmod(F.xxhash64("text", "rid"), F.lit(1_000_000)) < F.try_element_at(share, F.col("label")) * 1_000_000).select("label", "text")
            for r in chosen.mapInArrow(_counted, "label string, counts binary").groupBy("label").applyInArrow(_summed, "label string, counts binary").collect():
                counts[r.label] = counts.get(r.label, 0) + np.frombuffer(r.counts, "<i8").astype(np.float64)
    names = tuple(sorted(counts))
    weights = np.zeros((BUCKETS + 1, len(names) + 1), np.float32)
    for k, name in enumerate(names):
        own = counts[name] + SMOOTH
        weights[:BUCKETS, k] = np.log(own / own.sum())
    weights[:BUCKETS, -1] = -np.log(26.0**3)
    return Model(names, weights)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = list(np.ascontiguousarray(model.weights.T))
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                own = trigrams((text.as_py() or "").encode())
                total, n = np.zeros(len(columns)), int((own != BUCKETS).sum())
                for at in range(0, len(own), 1 << 18):
                    part = own[at : at + (1 << 18)]
                    total += [c.take(part).sum(dtype=np.float64) for c in columns]
                out.append((total * min(1, EVIDENCE / n) if n else total).round(6).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "loglik"])

    return run


def identify(rows: DataFrame, model: Model, key: str, text: Column, declared: Column, suffix: Column, host: Column, domain: Column, least: float = 0.5, rid: str | None = None) -> DataFrame:
    """key, rid, lang, confidence, text_lang of every row. rid is a column's, or the row's number."""
    names = [*model.languages, UND]
    width = len(names)
    clean = lambda c: F.coalesce(F.lower(c.cast("string")), F.lit(""))
    primary = F.regexp_extract(clean(declared), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    base = rows.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.col(key).alias("key"), primary.alias("declared"), clean(suffix).alias("suffix"), clean(host).alias("host"), clean(domain).alias("domain"), text.cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    scored = base.mapInArrow(_scored(model), f"rid long, key {kind}, declared string, suffix string, host string, domain string, loglik array<double>")
    # a column for each language from here on: plain arithmetic, which is compiled, where array functions are interpreted
    each = range(width)
    scored = scored.withColumn("top", F.array_max("loglik")).withColumns({f"e{k}": F.exp(F.col("loglik")[k] - F.col("top")) for k in each})
    total_e = sum((F.col(f"e{k}") for k in each), F.lit(0.0))
    seen = scored.withColumns({f"p{k}": F.col(f"e{k}") / total_e for k in each} | {f"l{k}": F.col("loglik")[k] for k in each}).drop("top", "loglik", *(f"e{k}" for k in each))
    seen = materialize(seen, "likelihoods")

    mass = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(f"p{k}") for k in each)).alias("s"))
    total = mass(seen).collect()[0]
    n = total["n"]
    if not n:
        return seen.select("key", "rid", F.lit(UND).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(UND).alias("text_lang"))
    overall = [((x or 0.0) + 1) / (n + width) for x in total["s"]]
    hosts = materialize(mass(seen, "host", "domain"), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.array(*(F.sum(F.col("s")[k]) for k in each)).alias("ds"))
    hosts = materialize(hosts.join(domains, "domain"), "hosts")
    # what a value tells of a language is judged without the row itself; the sums are tables of their own, so that the
    # joins below read two shuffles each and AQE can split a value that many rows share
    for what in ("declared", "suffix"):
        table = materialize(mass(seen, what).select(F.col(what).alias(f"{what}_v"), F.col("s").alias(f"{what}_s")), what)
        seen = seen.join(table, F.col(what) == F.col(f"{what}_v"))
        values = max(2, table.count())
        # the share of a language's other rows that have this value
        own = {k: F.greatest(F.col(f"{what}_s")[k] - F.col(f"p{k}"), F.lit(0.0)) + 0.5 for k in each}
        seen = seen.withColumns({f"l{k}": F.col(f"l{k}") + F.ln(own[k] / (F.greatest(F.lit(total["s"][k] or 0.0) - F.col(f"p{k}"), F.lit(0.0)) + 0.5 * values)) for k in each})
    h = hosts.select(F.col("host").alias("h"), F.col("domain").alias("d"), F.col("n").alias("hn"), F.col("s").alias("hs"), "dn", "ds")
    seen = seen.join(h, (F.col("host") == F.col("h")) & (F.col("domain") == F.col("d")))

    def prior(k: int) -> Column:
        """The host's other rows, drawn to the domain's, which are drawn to all."""
        parent = (F.greatest(F.col("ds")[k] - F.col(f"p{k}"), F.lit(0.0)) + STRENGTH * overall[k]) / (F.col("dn") - 1 + STRENGTH)
        return F.ln((F.greatest(F.col("hs")[k] - F.col(f"p{k}"), F.lit(0.0)) + STRENGTH * parent) / (F.col("hn") - 1 + STRENGTH))

    seen = seen.withColumns({f"post{k}": F.col(f"l{k}") + prior(k) for k in each})
    seen = seen.withColumn("best", F.greatest(*(F.col(f"post{k}") for k in each)))
    confidence = 1 / sum((F.exp(F.col(f"post{k}") - F.col("best")) for k in each), F.lit(0.0))
    seen = seen.withColumn("confidence", F.round(confidence, 6))

    def first(values: str, top: Column) -> Column:
        return F.coalesce(*(F.when(F.col(f"{values}{k}") == top, F.lit(names[k])) for k in each), F.lit(UND))

    # without a trigram all likelihoods are equal
    blank = F.greatest(*(F.col(f"p{k}") for k in each)) == F.least(*(F.col(f"p{k}") for k in each))
    nothing = blank & (F.col("declared") == "") & (F.col("host") == "")
    lang = F.when(nothing | (F.col("confidence") < least), F.lit(UND)).otherwise(first("post", F.col("best")))
    told = F.when(blank, F.lit(UND)).otherwise(first("p", F.greatest(*(F.col(f"p{k}") for k in each))))
    return seen.select("key", "rid", lang.alias("lang"), "confidence", told.alias("text_lang"))


#: The part of a page that is read: no scripts, styles, comments or tags.
_HIDDEN = r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->|<[^>]*+>|&[a-z]{1,8}+;|&#x?[0-9a-f]{1,8}+;"


def pages_language(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared_lang of web pages (page_id, url, html)."""
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]{2,15})", 1)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    text = F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, " ")
    return identify(pages, model, "page_id", text, declared, suffix, host, domain)


def keep_known(docs: DataFrame, model: Model, text: str = "text", declared: str = "lang", host: str = "source", least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language is known."""
    none = F.lit("")
    of = lambda name: F.col(name) if name in docs.columns else none
    docs = numbered(docs, RID, "numbered")
    found = identify(docs, model, RID, F.coalesce(F.col(text), none), of(declared), none, of(host), of(host), least, RID)
    gone = materialize(found.where(f"lang = '{UND}'").select(F.col("rid").alias("__gone")), "rejected")
    return docs.join(gone, F.col(RID) == F.col("__gone"), "left_anti").drop(RID)
