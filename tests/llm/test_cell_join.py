"""The join of fingerprints by their cells."""

import random

from pulseframe.llm import simhash
from pulseframe.llm.base import store
from pulseframe.session import settle


def test_cells_are_never_broadcast(spark):
    """Each fingerprint is listed in up to 33 cells, which the estimated size leaves out: 805 MB were sent where 10 MB are allowed."""
    rng = random.Random(11)
    prints = {rng.getrandbits(64) - 2**63 for _ in range(60)}
    for fp in list(prints):
        prints |= {fp ^ 1 << rng.randrange(63), fp ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63), fp ^ 0b111}
    prints = sorted(prints)
    classes = settle(store(spark.createDataFrame(list(enumerate(prints)), "node bigint, fp bigint"), "classes"))  # of known size
    found = simhash.links(classes.select("fp", "node"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    near = {(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints) if a < b and ((x ^ y) % 2**64).bit_count() <= 2}
    assert {tuple(sorted(r)) for r in found.collect()} == near and len(near) > 100
