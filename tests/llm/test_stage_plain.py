"""The pipeline's quality and mixing stages against plain versions of them, row by row."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from pulseframe.llm import quality_fm
from pulseframe.llm.base import table
from pulseframe.llm.words import Words

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Target of every source: shares by weight, those above three times their size held there and the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {source: (1, 2, 3)[i % 3] for i, source in enumerate(order)}
    held = {}
    while True:
        left = sum(sizes.values()) - sum(held.values())
        heavy = sum(w for s, w in weight.items() if s not in held)
        even = {s: Fraction(left * w, heavy) for s, w in weight.items() if s not in held}
        above = {s: 3 * sizes[s] for s, target in even.items() if target > 3 * sizes[s]}
        if not above:
            return {**held, **even}
        held |= above


def plain_mix(rows):
    sizes = {}
    for row in rows:
        sizes[row.source] = sizes.get(row.source, 0) + len(WORDS.findall(row.text or ""))
    targets, out = plain_targets(sizes), []
    for row in rows:
        rate = float(targets[row.source]) / sizes[row.source] if sizes[row.source] else 0.0
        said = f"{row.doc_id}|{hashlib.md5((row.text or '').encode()).hexdigest()}|1|17|mix"
        draw = int(hashlib.md5(said.encode()).hexdigest()[:13], 16) / 16**13
        out += [(row.doc_id, copy) for copy in range(1, int(rate) + (draw < rate - int(rate)) + 1)]
    return out


def test_mixing_equals_the_plain_version(spark):
    docs = table(spark, SMALL, "documents")
    more = spark.createDataFrame(
        [(-1, None, "xx", None, 0), (-2, "", "xx", None, 0), (-3, "a few words without a source", "xx", None, 28), (-4, "one", "xx", "zz tiny", 3), (-5, None, "xx", "zz wordless", 0)],
        docs.schema,
    )
    docs = docs.unionByName(more)
    mixed = corpus_pipeline.mixing(spark, docs, SMALL)
    want = plain_mix(docs.collect())
    assert sorted((r.doc_id, r.copy) for r in mixed.collect()) == sorted(want)
    assert len({copy for _, copy in want}) > 1 and not {-1, -2, -5} & {d for d, _ in want} - {-1, -2}


def plain_features(text, n_chars):
    """One text at a time: bucket counts of length one, then the statistics in their order."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    counts = np.zeros(quality_fm.BUCKETS)
    for word in words:
        counts[int(Words([word], quality_fm.AS_IS).hashes()[0]) % quality_fm.BUCKETS] += 1
    share = [sum(map(test, raw)) / max(len(raw), 1) for test in quality_fm.CLASSES]
    n = max(len(words), 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    stats = [
        *share, *map(math.sqrt, share), sum(map(len, words)) / n / 10, sum(len(w) > 12 for w in words) / n, sum(len(w) <= 2 for w in words) / n,
        again, math.sqrt(again), np.count_nonzero(counts) / min(n, quality_fm.BUCKETS), counts.max() / n, math.log1p(len(words)) / 10,
        0 if n_chars is None else math.log1p(max(n_chars, 0)) / 10,
    ]
    return np.concatenate([counts / max(math.sqrt((counts**2).sum()), 1e-6), stats])


def plain_score(machine, x):
    """All pairs of features, one by one."""
    spots = np.flatnonzero(x)
    value = machine.bias + sum(float(machine.linear[i]) * x[i] for i in spots)
    for at, i in enumerate(spots):
        rest = spots[at + 1 :]
        value += x[i] * float(((machine.factors[rest].astype(float) @ machine.factors[i].astype(float)) * x[rest]).sum())
    return 1 / (1 + math.exp(-min(max(value, -30), 30)))


def test_quality_equals_the_plain_version(spark):
    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(-1, None, "xx", "a", None), (-2, "", "xx", "a", 0), (-3, "so so so so", "xx", None, None)], docs.schema)
    docs = docs.unionByName(odd)
    machine = quality_fm.fit(docs, table(spark, SMALL, "labels"))
    want = {r.doc_id: plain_score(machine, plain_features(r.text, r.n_chars)) for r in docs.collect() if len(r.text or "") < 20_000}
    got = {r.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    assert len(want) > 150 and {d: got[d] for d in want} == pytest.approx(want, abs=1e-4)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SMALL).collect()}
    sure = {d for d, score in want.items() if abs(score - corpus_pipeline.QUALITY) > 1e-3}
    assert kept & sure == {d for d in sure if want[d] >= corpus_pipeline.QUALITY} and 0 < len(kept & sure) < len(sure)
