"""Near copies by their word shingles: documents whose sets of five-word shingles have Jaccard similarity 0.8.

The fingerprints of ``simhash`` link what differs in 2 of 64 bits. Edited copies at 0.8 differ in up to 10 bits and
more, and the grid of segment counts would list each fingerprint in all cells within half of that. So for
what lies beyond the fingerprints' reach, candidates come from ``BANDS`` keys of ``ROWS`` least hashes each, which a pair at similarity s
shares with probability 1 - (1 - s ** ROWS) ** BANDS (0.99997 at 0.8), and every candidate is compared
by its whole sets. Texts of equal sets are one class from the start.

A set is taken out of the search if too many of its shingles are in no other candidate: with u such
shingles among n, a partner of m shingles has similarity (n - u) / (m + u) at most. Links are then found
in two steps. All members of a key's bucket are compared with one of them, that with the least share of
such shingles, which is nearest to what the bucket has in common. Sets of buckets that are then still in
different groups are compared by a prefix join: shingles in order of rarity, the rarest shared one lies in
the first fifth of both, and its places bound what can follow. Each of these shingles is joined outside its
largest group only, and only for the sizes that its place allows. So a large group of copies is no list of
pairs, and copies edited too much to link with anything meet nothing. No bucket is cut short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.llm.base import arrow_pass, bytes_of, components, keeps_names, one_of_each, row_keys, store
from pulseframe.llm.simhash import links, simhash
from pulseframe.llm.words import BASE, SPACED, Words, scramble
from pulseframe.operators.joins import attach
from pulseframe.session import settle

#: Words of a shingle; a shorter text is one shingle.
WORDS = 5
#: Similarity from which documents link, as a fraction.
SHARE = (4, 5)
ROWS = 4
BANDS = 20
#: Odd factors that put the hashes in another order for each least hash.
FACTORS = scramble(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; none for a text without words."""
    found = Words(texts, SPACED)
    hashes = found.hashes()
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for size in range(1, WORDS + 1):
        at, values = found.shingles(size, hashes)
        wanted = np.flatnonzero(found.counts >= WORDS if size == WORDS else found.counts == size)
        bounds = np.searchsorted(at, found.first)
        for text in wanted.tolist():
            sets[text] = np.unique(values[bounds[text] : bounds[text + 1]])
    return sets


def bands(values: np.ndarray) -> np.ndarray:
    """The keys of one set: a hash of each band's number and least hashes."""
    least = np.full(ROWS * BANDS, np.uint64(2**64 - 1))
    for at in range(0, len(values), 512):  # bounds the memory of one step
        least = np.minimum(least, (FACTORS[:, None] * values[at : at + 512]).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        total = scramble(total * BASE + least[:, row])
    return total


def signatures(rows: DataFrame, fingerprints: bool = False) -> DataFrame:
    """(doc_id, _id, _mark, same, n, fp, bands) of every row: the hash, size and keys of its set of shingles, and its fingerprint."""
    names = ["doc_id", "_id", "_mark"]

    def scan(batch: pa.RecordBatch):
        texts = bytes_of(batch.column("text"))
        sets = shingle_sets(texts)
        prints = pa.array([simhash(text) for text in texts] if fingerprints else [None] * len(texts), pa.int64())
        same = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
        keys = pa.array([bands(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
        return pa.record_batch([*map(batch.column, names), same, pa.array(map(len, sets), pa.int32()), prints, keys], [*names, "same", "n", "fp", "bands"])

    kinds = "doc_id bigint, _id bigint, _mark bigint, same bigint, n int, fp bigint, bands array<bigint>"
    return arrow_pass(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "_id", "_mark", "text"), scan, kinds, "text")


def sets_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, set) of the classes named by ``nodes``, stored."""

    def scan(batch: pa.RecordBatch):
        sets = [s.view(np.int64) for s in shingle_sets(bytes_of(batch.column("text")))]
        return pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    wanted = classes.join(nodes, "node").select("node", "rep.*")
    texts = attach(rows.select("_id", "_mark", "text"), wanted, ["_id", "_mark"]).select("node", "text")
    sets = arrow_pass(texts, scan, "node bigint, set array<bigint>", "text")
    return store(sets.groupBy("node").agg(F.first("set").alias("set")), "shingle_sets")  # rows repeated whole have equal sets


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of classes whose sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    up, down = SHARE
    enough = shared * (up + down) >= (F.size("set_a") + F.size("set_b")) * up
    return pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b")


def may_link(n: Column, own: Column, partner: Column) -> Column:
    """Whether a set of ``n`` shingles, ``own`` of which no other set has, can be similar to one of ``partner`` shingles."""
    up, down = SHARE
    return (n - own) * down >= (partner + own) * up


def size_cell(n: Column) -> Column:
    """Sizes about 1.5 % apart share a cell."""
    return F.floor(F.log2(n) * 48).cast("int")


def prefix_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the sets ``left`` (node, n, label) of different labels that may be similar enough.

    Similar sets of n and m shingles share at least up / (up + down) of n + m. With the shingles of each in
    order of rarity, none before the rarest shared one at places p and q is shared, so n - p and m - q are
    at least that many; hence p is below a fifth of n, and m is bounded by n and p.
    """
    up, down = SHARE
    listed = sets.join(left, "node").select("node", "n", "label", F.explode("set").alias("shingle"))
    known = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("sets", "shingle")) - 1  # one set a window
    prefix = attach(listed, known.filter("sets > 1"), "shingle", how="left").withColumn("sets", F.coalesce("sets", F.lit(1))).withColumn("place", place)
    prefix = settle(prefix.filter((F.col("sets") > 1) & (F.col("place") * down <= F.col("n") * (down - up))))
    by_label = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("members"))
    largest = by_label.groupBy("shingle").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    open_rows = settle(prefix.join(largest.select("shingle", "main"), "shingle"))
    most = ((up + down) * (F.col("n") - F.col("place")) - up * F.col("n")) / up
    cells = F.sequence(size_cell(F.ceil(F.col("n") * up / down)), F.greatest(size_cell(most), size_cell(F.ceil(F.col("n") * up / down))))
    one = open_rows.filter("label <> main").withColumn("cell", F.explode(cells)).alias("one")
    two = open_rows.withColumn("cell", size_cell(F.col("n"))).alias("two")
    met = (F.col("one.shingle") == F.col("two.shingle")) & (F.col("one.cell") == F.col("two.cell")) & (F.col("one.label") != F.col("two.label"))
    once = (F.col("two.label") == F.col("two.main")) | (F.col("one.node") < F.col("two.node"))
    shared = (F.col("one.n") + F.col("two.n")) * up
    room = (((F.col("one.n") - F.col("one.place")) * (up + down)) >= shared) & (((F.col("two.n") - F.col("two.place")) * (up + down)) >= shared)
    return one.join(two, met & once & room).select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))


def groups(classes: DataFrame, rows: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(node, label) of the classes (node, n, bands, rep) that have links; label is the smallest node linked.

    ``given`` has links (a, b) of classes that hold without a comparison.
    """
    listed = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = listed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("band")
    met = settle(attach(listed, shared, "band"))
    sets = sets_of(met.select("node").distinct(), classes, rows)
    single = sets.select("node", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("node"))
    own = single.filter("sets = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    counted = met.join(settle(own), "node", "left").fillna(0, ["own"])
    members = counted.filter(may_link(F.col("n"), F.col("own"), F.col("n") - F.col("own")))
    leads = members.groupBy("band").agg(F.min_by("node", F.struct(F.col("own") / F.col("n"), -F.col("n"), "node")).alias("lead"))
    members = settle(members.join(leads, "band"))
    first = settle(members.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    near = alike(first, sets)
    known = components(near if given is None else near.union(given.select("a", "b")))
    placed = members.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_bands = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    left = settle(attach(placed, open_bands, "band").select("node", "n", "label").distinct())
    pairs = prefix_pairs(left, sets)
    more = settle(pairs.distinct().join(first, ["a", "b"], "left_anti"))
    return components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).union(alike(more, sets))) if more.head(1) else known


def fingerprint_links(known: DataFrame) -> DataFrame:
    """(a, b): links of classes with equal fingerprints and with near ones, each through the smallest class of a fingerprint.

    The links of ``simhash`` are taken as they are; they are followed together with those by similar sets.
    """
    placed = settle(known.select("fp", F.col("same").alias("node")).distinct())
    least = settle(placed.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("classes")))
    equal = placed.join(least.filter("classes > 1").select("fp", F.col("node").alias("a")), "fp").select("a", F.col("node").alias("b"))
    return equal.union(links(least.select("fp", "node")))


@keeps_names("_id", "_mark")
def keep_one(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """``docs`` with one row per group of near copies, that with the smallest id and, of rows of that id, the smallest hash.

    With ``fingerprints`` the near duplicates that ``simhash`` finds are links too, beside those by similar sets.

    Near copies are linked by others between them. Texts without words, null ones too, are one group. A kept
    row that is repeated whole stays once; documents without an id are kept. Empty in, empty out.
    """
    rows = row_keys(docs)
    known = store(signatures(rows, fingerprints), "signatures")
    by_set = known.groupBy(F.col("same").alias("node"))
    classes = settle(by_set.agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("_id", "_mark")).alias("rep")))
    labels = groups(classes, rows, fingerprint_links(known) if fingerprints else None)
    grouped = known.join(labels, known["same"] == labels["node"], "left").withColumn("group", F.coalesce("label", "same"))
    return one_of_each(rows, grouped.select("doc_id", "_id", "_mark", "group"))
