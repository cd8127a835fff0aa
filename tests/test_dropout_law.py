"""Dropout at a probability where 32 draws seldom keep anything."""

from collections import Counter

from pulseframe.operators import windows


def test_dropout_at_high_p_has_the_conditional_distribution(spark):
    rows = [(s, 9, f"v{i}", 0, 1.0) for s in range(6_000) for i in range(4)]
    window = spark.createDataFrame(rows, "stay_id long, t1 int, variable string, minute int, value double").repartition(8)
    p, m, n = 0.995, 4, 6_000
    got = windows.variable_dropout(window, p).toPandas()
    sizes = Counter(got.groupby("stay_id").size())
    some = 1 - p**m
    two = n * 6 * (1 - p) ** 2 * p**2 / some
    assert sum(sizes.values()) == n
    assert abs(sizes[2] - two) < 4 * two**0.5
    for _, count in got["variable"].value_counts().items():
        share = (1 - p) / some
        assert abs(count - n * share) < 4 * (n * share * (1 - share)) ** 0.5
