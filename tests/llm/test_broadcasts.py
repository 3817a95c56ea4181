"""What the steps of op7 broadcast is bounded by rows, whatever the optimizer takes a table's size for."""

import random

import pytest

from tallyframe.llm import common, simhash


def plans_of(monkeypatch):
    plans, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, what))
    return plans


@pytest.mark.parametrize("few", [-1, 100_000])
def test_no_table_that_grows_is_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few, raising=False)
    plans = plans_of(monkeypatch)
    rnd = random.Random(8)
    prints = [rnd.getrandbits(63) for _ in range(500)]
    prints += [p ^ 3 << rnd.randrange(60) for p in prints[:50]]
    frame = simhash.materialize(spark.createDataFrame([(p,) for p in prints], "fp long"), "prints")
    labels = {r.node: r.label for r in simhash.components(simhash.links(frame)).collect()}
    assert labels == {p: min(own) for own in zip(prints[:50], prints[500:]) for p in own}
    broadcast = [p.split("BroadcastExchange")[1:] for p in plans]
    assert not any("Generate explode" in below.split("Exchange")[0] for own in broadcast for below in own)  # 34 rows a fingerprint
    assert few > 0 or not any(broadcast)


def test_no_class_table_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", -1, raising=False)
    plans = plans_of(monkeypatch)
    docs = spark.createDataFrame([(k, f"text number {k} of {k % 7}") for k in range(100)] + [(200, "text number 5 of 5")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 101 and got[200] == got[5]
    assert not any("BroadcastExchange" in p for p in plans)
