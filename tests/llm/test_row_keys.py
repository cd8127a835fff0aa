"""Stages that drop rows, on rows of one id with different texts and rows without id."""

from pulseframe.llm import decontaminate, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ONE, TWO, THREE = (" ".join(WORDS[(i * step + i * i) % 20] + str(i * step % 13) for i in range(90)) for step in (1, 3, 7))


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rows = [(1, ONE), (2, ONE), (2, TWO), (3, TWO), (5, ONE), (5, THREE), (7, None), (7, THREE), (None, ONE), (2, TWO)]
    want = sorted([("1", ONE), ("2", TWO), ("5", THREE), ("7", None), ("None", ONE)], key=str)
    for parts in (1, 4):
        assert sorted(((str(r.doc_id), r.text) for r in simhash.keep_one(frame(spark, rows, parts)).collect()), key=str) == want


def test_decontaminate_judges_rows_and_not_ids(spark):
    bench = spark.createDataFrame([("b", ONE)], "item_id string, text string")
    rows = [(None, ONE), (None, TWO), (4, ONE), (4, TWO), (6, TWO), (6, TWO), (None, None), (8, ONE), (8, ONE)]
    found = decontaminate.decontaminate(frame(spark, rows, 3), bench)
    assert found.columns == ["doc_id", "text"]
    got = sorted(((str(r.doc_id), r.text) for r in found.collect()), key=str)
    assert got == sorted([("None", TWO), ("4", TWO), ("6", TWO), ("6", TWO), ("None", None)], key=str)
