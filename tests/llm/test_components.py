"""Linked groups against union-find, and the passes they take."""

import random

import pytest

import corpus_pipeline
from pulseframe.llm import base, near_copies, simhash
from pulseframe.llm.base import components


def plain_labels(edges):
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        group[high] = low
    return {x: top(x) for edge in edges if edge[0] != edge[1] for x in edge}


def graphs():
    rng = random.Random(3)
    names = rng.sample(range(-(10**6), 10**6), 900)
    path = [(names[i], names[i + 1]) for i in range(699)]
    yield path
    yield [(min(names[:50]), x) for x in names[:50]] + [(names[60], names[61])] * 3
    yield [(rng.choice(names), rng.choice(names)) for _ in range(700)]
    yield [(max(names), x) for x in names[:300]] + [(x, x) for x in names[:5]]
    yield []


@pytest.mark.parametrize("edges", list(graphs()))
def test_smallest_linked_node(spark, edges):
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert found.count() == len(plain_labels(edges))
    assert {r.node: r.label for r in found.collect()} == plain_labels(edges)


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *args, **kw: (calls.append(args), real(*args, **kw))[1])
    return calls


def test_stars_take_no_round(spark, monkeypatch):
    """Each round stores a file a partition; what needs no round makes none to find that out."""
    passes = counted(monkeypatch, base, "settle")
    stars = [(10 * k, 10 * k + i) for k in range(5) for i in range(1, 9)]
    assert components(spark.createDataFrame(stars, "a bigint, b bigint")).count() == 45
    assert len(passes) == 2


def test_stage_follows_both_kinds_of_links_together(spark, monkeypatch):
    passes = [counted(monkeypatch, module, "components") for module in (near_copies, simhash)]
    base_text = [f"w{i}" for i in range(300)]
    texts = [" ".join(base_text), " ".join([*base_text[:-1], "end"]), "something else altogether in here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2]
    assert [len(p) for p in passes] == [1, 0]
