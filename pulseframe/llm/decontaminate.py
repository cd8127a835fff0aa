"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item (``window`` consecutive words; a shorter item is one window) is a set of word
shingles. A document that contains the window holds all of them, so it is enough to join on the
necessary prefix: the window's rarest shingle by its count over all documents. A hit at word ``p`` of
a shingle at offset ``o`` can only be the window at ``p - o``: the positional bound is that this is not
negative, the length bound that the whole window still fits. What passes is compared word by word.

The documents are passed over twice where they lie, to count the shingles and to find the hits of the
prefixes; a bit map of fixed size lets through only shingles that an item may have. The hits are
joined with the prefixes in Spark; equal hashes only make candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.llm.base import arrow_pass, bytes_of, keeps_names, row_keys, store
from pulseframe.llm.words import ALNUM, Words
from pulseframe.operators.joins import attach
from pulseframe.session import settle

#: Bits of the map that filters shingles (1 MiB), whatever the number of items.
MAP_BITS = 1 << 23


@dataclass(frozen=True)
class Prefixes:
    """The join side of the benchmark: a row per window with its rarest shingle."""

    rows: DataFrame
    sizes: tuple[int, ...]


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Which hashes may occur, one bit each: at most MAP_BITS / 64 rows come to the driver."""
    at = F.col("hash").bitwiseAND(MAP_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    held = np.zeros(MAP_BITS // 64, np.int64)
    for word, bits in hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        held[word] = bits
    return np.unpackbits(held.view(np.uint8), bitorder="little").view(bool)


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, window, offset, size, hash): every shingle of every window of every item."""

    def listed(batch: pa.RecordBatch):
        found = Words(bytes_of(batch.column("text")), ALNUM)
        hashes = found.hashes()
        by_size = {k: dict(zip(*(x.tolist() for x in found.shingles(k, hashes)))) for k in range(1, shingle + 1)}
        rows = []
        for i, item in enumerate(batch.column("item_id").to_pylist()):
            first, count = int(found.first[i]), int(found.counts[i])
            span = min(window, count)
            size = min(shingle, span)
            for start in range(first, first + count - span + 1) if count else ():
                whole = found.span(start, start + span).decode("utf-8", "replace")
                for offset in range(span - size + 1):
                    value = by_size[size][start + offset]
                    rows.append((item, span, whole, offset, size, value - (1 << 64) if value >> 63 else value))
        names = ["item_id", "words", "window", "offset", "size", "hash"]
        return pa.record_batch(list(map(pa.array, zip(*rows))), names) if rows else None

    kinds = "item_id string, words int, window string, offset int, size int, hash bigint"

    def typed(batch):
        out = listed(batch)
        return None if out is None else out.cast(pa.schema([("item_id", pa.string()), ("words", pa.int32()), ("window", pa.string()), ("offset", pa.int32()), ("size", pa.int32()), ("hash", pa.int64())]))

    return arrow_pass(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), typed, kinds, "text")


def shingle_counts(docs: DataFrame, sizes: tuple[int, ...], may: np.ndarray) -> DataFrame:
    """(hash, copies): how often the documents have each shingle that the bit map lets through."""

    def count(batch: pa.RecordBatch):
        found = Words(bytes_of(batch.column("text")), ALNUM)
        hashes = found.hashes()
        hits = [h[may[h & np.uint64(MAP_BITS - 1)]] for _, h in (found.shingles(k, hashes) for k in sizes)]
        values, copies = np.unique(np.concatenate(hits), return_counts=True)
        return pa.record_batch([pa.array(values.view(np.int64)), pa.array(copies)], ["hash", "copies"])

    counted = arrow_pass(docs.select("text"), count, "hash bigint, copies bigint", "text")
    return counted.groupBy("hash").agg(F.sum("copies").alias("copies"))


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> Prefixes:
    """The rarest shingle of each distinct window, with the items that have the window."""
    listed = store(item_windows(benchmark, window, shingle), "windows")
    sizes = tuple(sorted(r[0] for r in listed.select("size").distinct().collect()))  # at most ``shingle`` rows
    if not sizes:
        return Prefixes(listed.select("hash", "offset", "words", "window", F.array("item_id").alias("items")), ())
    known = shingle_counts(docs, sizes, bit_map(listed.select("hash").distinct()))
    counted = listed.join(known, "hash", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    rarest = counted.groupBy("window", "words").agg(
        F.min(F.struct("copies", "hash", "offset")).alias("rarest"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    return Prefixes(settle(rarest.select("rarest.hash", "rarest.offset", "words", "window", "items")), sizes)


def hits(docs: DataFrame, sizes: tuple[int, ...], may: np.ndarray, window: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, keys (longs), n_words, and its prefix hits with the words around each."""
    names = ["doc_id", *keys]
    hit = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.string())])
    schema = pa.schema([*((name, pa.int64()) for name in [*names, "n_words"]), ("hits", pa.list_(hit))])

    def find(batch: pa.RecordBatch):
        found = Words(bytes_of(batch.column("text")), ALNUM)
        hashes = found.hashes()
        lists: list[list] = [[] for _ in range(batch.num_rows)]
        for size in sizes:
            at, values = found.shingles(size, hashes)
            keep = may[values & np.uint64(MAP_BITS - 1)]
            for word, value in zip(at[keep].tolist(), values[keep].view(np.int64).tolist()):
                text = int(found.text[word])
                low, high = max(int(found.first[text]), word - window + 1), min(int(found.first[text + 1]), word + window)
                around = found.span(low, high).decode("utf-8", "replace")
                lists[text].append({"hash": value, "at": word - int(found.first[text]), "left": word - low, "around": around})
        return pa.record_batch([*map(batch.column, names), pa.array(found.counts), pa.array(lists, schema.field("hits").type)], schema=schema)

    kinds = "".join(f"{name} bigint, " for name in [*names, "n_words"])
    return arrow_pass(docs.select(*names, "text"), find, kinds + "hits array<struct<hash:bigint,at:int,left:int,around:string>>", "text")


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keys, n_words, n_hit, items) of every document (doc_id, text).

    A word is hit if any occurrence of an item's window covers it. Null and empty texts have no words,
    nor do items without words have windows; repeated rows are judged one by one. An empty benchmark
    hits nothing. Columns beyond doc_id, keys and text (item_id and text of the benchmark) are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keys, "text")
    known = prefixes(docs, benchmark, window, shingle)
    may = bit_map(known.rows.select("hash").distinct()) if known.sizes else np.zeros(MAP_BITS, bool)
    found = hits(docs, known.sizes, may, window, keys)
    found = store(found.withColumn("row", F.monotonically_increasing_id()), "hits")
    candidates = found.select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    joined = attach(candidates, known.rows, "hash").withColumn("start", F.col("at") - F.col("offset"))
    bounded = joined.filter("start >= 0 AND start + words <= n_words")
    # The words around a hit reach as far as any window does, so the window is cut out of them.
    here = F.array_join(F.slice(F.split("around", " "), F.col("left") - F.col("offset") + 1, F.col("words")), " ")
    matches = bounded.filter(here == F.col("window")).groupBy("row", "start").agg(F.max("words").alias("words"), F.collect_set("items").alias("items"))
    ends = F.col("start") + F.col("words")
    before = F.max(ends).over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), ends - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = matches.withColumn("fresh", fresh).groupBy("row").agg(
        F.sum("fresh").cast("bigint").alias("n_hit"), F.array_distinct(F.flatten(F.flatten(F.collect_set("items")))).alias("items")
    )
    none = F.array().cast("array<string>")
    return found.drop("hits").join(covered, "row", "left").select(
        "doc_id", *keys, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.array_sort(F.coalesce("items", none)).alias("items")
    )


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``contaminated``: some word is hit, and at least one word in ``share``."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


@keeps_names("_id", "_mark")
def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the contaminated documents; every row is judged by its own text, also rows without id or of one id."""
    keys = ("_id", "_mark")
    rows = row_keys(docs)
    gone = judged(overlap(rows, benchmark, keys=keys, **settings)).filter("contaminated").select(*keys).distinct()
    return attach(rows, gone, list(keys), how="left_anti").drop(*keys)
