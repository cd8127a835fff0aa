"""SimHash near-duplicates through a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits becomes 16 counts, the set bits of its segments of 4. Two fingerprints that
differ in d bits lie at most d apart in these counts under Manhattan distance, so a range join in the
grid of counts finds every pair within d = 2. Points at most 2 apart share a cell within 1 of both:
each fingerprint is listed in its own cell and the cells one step away, cells meet in an equi-join,
and every candidate is verified on all 64 bits.

Only distinct fingerprints are joined; equal ones are one class from the start. Cells with more than
``CROWDED`` fingerprints are not paired: their members are listed under every fingerprint at most one
bit away, where members always are within 2 of each other and at most 65 can meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.llm.base import arrow_pass, bytes_of, components, keeps_names, one_of_each, row_keys, store
from pulseframe.operators.joins import attach
from pulseframe.session import settle

BITS = 64
SEGMENT = 4
#: Hamming distance up to which fingerprints link; the steps of the grid are made for it.
NEAR = 2
CROWDED = 256
SEED = 42


def simhash(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text: a bit is set if more than half of the shingles' hashes have it."""
    plain = b" ".join(text.lower().split())  # bytes: A-Z only, ASCII white space only
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(plain)]))
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        hashes = np.fromiter((digest(plain[a:b], seed) for a, b in spans), dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keys, fp): the fingerprint of every whole text as a signed long; null is an empty text, 0. Keys are longs."""
    names = ["doc_id", *keys]

    def scan(batch: pa.RecordBatch):
        found = pa.array([simhash(text, words) for text in bytes_of(batch.column("text"))], pa.int64())
        return pa.record_batch([*map(batch.column, names), found], [*names, "fp"])

    kinds = ", ".join(f"{name} bigint" for name in [*names, "fp"])
    return arrow_pass(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keys, "text"), scan, kinds, "text")


def segment_counts(fp: Column) -> Column:
    """The 16 counts of set bits, packed in a long of 16 segments like the fingerprint itself."""
    single = [F.shiftrightunsigned(fp, place).bitwiseAND(F.lit(0x1111111111111111)) for place in range(SEGMENT)]
    return single[0] + single[1] + single[2] + single[3]


def cells(counts: Column) -> Column:
    """The cell itself and the cells one step away, counts staying between 0 and 4."""
    found = [counts]
    for place in range(0, BITS, SEGMENT):
        here = F.shiftrightunsigned(counts, place).bitwiseAND(15)
        found += [F.when(here < SEGMENT, counts + F.lit(1 << place)), F.when(here > 0, counts - F.lit(1 << place))]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def neighbours(fp: Column) -> Column:
    """All fingerprints at most one bit away."""
    flips = [(1 << bit) - ((1 << 64) if bit == 63 else 0) for bit in range(BITS)]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(flip)) for flip in flips])


def links(classes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between the classes (fp, node) whose fingerprints differ in at most NEAR bits.

    Crowded cells give each member an edge to the smallest node of every neighbourhood it is in, which
    links the same classes with fewer edges.
    """
    listed = classes.select("node", "fp", F.explode(cells(segment_counts(F.col("fp")))).alias("cell"))
    full = settle(listed.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > crowded).select("cell"))
    roomy = attach(listed, full, "cell", how="left_anti") if full.head(1) else listed
    # Catalyst takes the size of the classes for that of their cells, 33 times as many rows, and would broadcast them.
    one, two = roomy.alias("one"), roomy.hint("merge").alias("two")
    near = F.bit_count(F.col("one.fp").bitwiseXOR(F.col("two.fp"))) <= NEAR
    pairs = one.join(two, (F.col("one.cell") == F.col("two.cell")) & (F.col("one.fp") < F.col("two.fp")) & near)
    edges = pairs.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))
    if not full.head(1):
        return edges
    members = attach(listed, full, "cell", how="left_semi").select("node", "fp").distinct()
    met = members.select("node", F.explode(neighbours(F.col("fp"))).alias("middle"))
    first = F.min("node").over(Window.partitionBy("middle"))  # at most 65 rows a window
    return edges.union(met.select(F.col("node").alias("a"), first.alias("b")).filter("a <> b"))


def near_duplicates(docs: DataFrame, words: int = 3, crowded: int = CROWDED, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keys, fp, component_id) of every document; component_id is the smallest doc_id reachable by links.

    Texts without words have fingerprint 0 and link like any other. Null texts count as empty; null ids
    never name a component unless all its ids are null; repeated rows are in one component. Columns
    beyond doc_id, keys and text are not read. Empty in, empty out.
    """
    known = store(fingerprints(docs, words, keys), "fingerprints")
    # A class is named by its smallest id; classes that only have null ids keep a negative stand-in.
    node = F.coalesce(F.min("doc_id"), F.bitwise_not(F.xxhash64("fp").bitwiseAND(F.lit(2**63 - 1))))
    classes = settle(known.groupBy("fp").agg(node.alias("node"), F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fp", "node"), crowded))
    named = classes.join(joined, "node", "left").withColumn("group", F.coalesce("label", "node"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "group").select("fp", "component_id")
    return known.join(by_class, "fp").select("doc_id", *keys, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@keeps_names("_id", "_mark")
def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row per component, that with the smallest id and, of rows of that id, the smallest hash.

    Rows of one id with different texts are told apart. A kept row that is repeated whole stays once;
    documents without an id are kept.
    """
    rows = row_keys(docs)
    found = near_duplicates(rows, keys=("_id", "_mark"), **settings)
    return one_of_each(rows, found.withColumnRenamed("component_id", "group"))
