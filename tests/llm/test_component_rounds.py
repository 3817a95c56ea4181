"""Components, which op7 and the pipeline's near stage share: whole trees are hooked, so a long path takes few rounds."""

import random

import pytest

from tallyframe.llm import simhash


def reversed_bits(n):
    return [int(f"{k:07b}"[::-1], 2) for k in range(n)]


@pytest.mark.parametrize("path", [[*range(1, 100), 0], [*range(1, 100, 2), 0, *range(2, 100, 2)], reversed_bits(128)], ids=["least_last", "least_between", "reversed_bits"])
def test_a_path_takes_few_rounds(spark, monkeypatch, path):
    rounds, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, what: rounds.append(what) or write(df, what))
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")).collect()}
    assert got == dict.fromkeys(path, 0)
    assert rounds.count("lower") <= 10


def test_components_of_random_graphs(spark):
    rnd = random.Random(3)
    edges = {tuple(rnd.sample(range(-500, 500), 2)) for _ in range(450)}
    edges |= {(900, k) for k in range(600, 700)}  # a star whose centre is its greatest node
    root = {n: n for e in edges for n in e}
    for _ in root:
        least = [min(root[a], root[b]) for a, b in edges]
        before = dict(root)
        for (a, b), m in zip(edges, least):
            root[a], root[b] = min(root[a], m), min(root[b], m)
        if root == before:
            break
    assert {r.node: r.label for r in simhash.components(spark.createDataFrame(list(edges), "a long, b long")).collect()} == root
