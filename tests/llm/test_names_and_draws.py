"""Columns of the caller named like own ones, rules with long paths, and draws of rows that share an id."""

import pytest

from pulseframe.llm import decontaminate, mixture, near_copies, quality_fm, simhash, suffix_dedup, url_cascade

WORDS = [f"word{i * i % 97}" for i in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(WORDS), " ".join(WORDS), " ".join(WORDS[::-1]), " ".join(WORDS[40:]) + " other words", None, ""]
    rows = [(i, t, f"s{i % 2}", "id", i * 10, 3.0, "m", 9, 8.5, [1], "r") for i, t in enumerate(texts)]
    kinds = "doc_id bigint, text string, source string, _id string, _mark int, _stated double, _key string, _Rate int, _draw double, _spans array<int>, _number string"
    return spark.createDataFrame(rows, kinds).repartition(3)


def test_columns_named_like_own_ones_stay(spark, docs):
    given = {r.doc_id: r for r in docs.collect()}
    bench = spark.createDataFrame([(1, " ".join(WORDS[::-1]))], "item_id int, text string")
    machine = quality_fm.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, quality int"))
    stages = {
        "near copies": near_copies.keep_one, "simhash": simhash.keep_one, "repeats": suffix_dedup.without_repeats, "mix": lambda d: mixture.mix(d).drop("copy"),
        "contamination": lambda d: decontaminate.decontaminate(d, bench), "quality": lambda d: quality_fm.score(d, machine, "score").drop("score"),
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found, name
        for row in found:
            assert row[3:] == given[row.doc_id][3:], name


def test_a_rule_path_of_any_length(spark):
    path = "/" + "x" * 70_001
    rules = spark.createDataFrame([("a.org", path, "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    urls = [(1, "http://a.org" + path + "y", 5), (2, "http://a.org" + path[:-1], 5)]
    found = {r.page_id: (r.rule, r.verdict, r._keys) for r in url_cascade.judge_urls(spark.createDataFrame(urls, "page_id int, url string, _keys int"), rules).collect()}
    assert found == {1: ("a.org" + path, "block", 5), 2: ("org/", "allow", 5)}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_have_draws_of_their_own(spark, doc_id):
    rows = [(doc_id, "a b c d " * 5 + f"w{i % 3}", "small") for i in range(900)] + [(i, "x " * 10, "large") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {}
    for parts in (2, 5):
        rates = mixture.repetition(docs.repartition(parts)).collect()
        for source_size in {r.source_size for r in rates}:
            own = [r for r in rates if r.source_size == source_size]
            got = sum(r.size * r.copies for r in own)
            assert abs(got - own[0].target) < 0.1 * own[0].target
            assert taken.setdefault(source_size, got) == got
        assert max(r.copies for r in rates) <= 3
        assert mixture.mix(docs.repartition(parts)).count() == sum(r.copies for r in rates)
