"""Near copies against every pair of texts compared."""

import random

import pytest

import corpus_pipeline
from pulseframe.llm import near_copies
from pulseframe.llm.base import table


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, one in enumerate(sets):
        for j in range(i):
            two = sets[j]
            if one == two or 5 * min(len(one), len(two)) >= 4 * max(len(one), len(two)) and 5 * len(one & two) >= 4 * len(one | two):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def edited(words, changes, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"edit{rng.random()}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(300)]
        found += [base, base, edited(base, 2, rng), edited(base, 5, rng), edited(base, 12, rng)]
    chain = [f"w{rng.randrange(500)}" for _ in range(400)]
    found += [chain[at : at + 200] for at in range(0, 200, 15)]  # neighbours are alike, the ends are not
    texts = [" ".join(words) for words in found] + [None, "", " \n", "one", "One", "a b c", "a b c d", "A  b c d"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("parts", [1, 5])
def test_stage_keeps_one_of_each_group(spark, rows, parts):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_sf001_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == plain_kept(rows)


def test_large_group_of_copies_is_no_list_of_pairs(spark):
    """Copies edited a little link with their lead; those edited too much are left out before any pair is made."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    found = [edited(base, rng.randrange(1, 9), rng) for _ in range(220)]
    rows = list(enumerate(" ".join(words) for words in found))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    compared, alike = [], near_copies.alike
    near_copies.alike = lambda pairs, sets: (compared.append(pairs.count()), alike(pairs, sets))[1]
    try:
        kept = sorted(r.doc_id for r in near_copies.keep_one(docs).collect())
    finally:
        near_copies.alike = alike
    assert kept == plain_kept(rows)
    assert sum(compared) < 20 * len(rows)


def test_stage_links_by_fingerprints_too(spark):
    """Shingles count as often as they occur in a fingerprint, once in a set: texts of one chorus differ in their sets alone."""
    rng = random.Random(9)
    chorus = ["never", "gonna", "give", "you", "up"] * 200
    texts = [" ".join(chorus + [f"w{rng.randrange(9000)}" for _ in range(12)]) for _ in range(3)] + ["something else altogether in here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert near_copies.keep_one(docs).count() == 4
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs.union(docs), "").collect()) == [0, 3]
