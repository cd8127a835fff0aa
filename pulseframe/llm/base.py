"""Shared shapes of the text operators: Arrow passes over whole texts, and linked groups."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.operators.joins import attach
from pulseframe.session import scratch_path, settle, tune

#: Bytes of text that one numpy pass handles at a time; longer single texts are one pass of their own.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder all executors share, and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold about ``limit`` bytes of the column each."""
    sizes = np.diff(offsets_of(batch.column(column)))
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def offsets_of(array: pa.Array) -> np.ndarray:
    """Where each value of a string or binary array starts in its data buffer, and where the last ends."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    found = np.frombuffer(array.buffers()[1], dtype=kind, count=len(array) + 1, offset=array.offset * kind().itemsize) if len(array) else np.zeros(1, kind)
    return found.astype(np.int64)


def bytes_of(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value, null as empty."""
    offsets, data = offsets_of(array), array.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    whole = [bytes(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    if array.null_count:
        whole = [b"" if gone else x for x, gone in zip(whole, array.is_null().to_pylist())]
    return whole


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str) -> DataFrame:
    """Run ``fn`` over bounded slices of every batch."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                out = fn(piece)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node each node of ``edges`` (a, b) is linked to, itself included.

    Alternating stars: every node points its larger neighbours, then its smaller ones, at the smallest
    node around it. A row stays one row in both steps and is shuffled once in each, beside the minima, which
    combine before the shuffle; adaptive execution splits the hot keys of the joins and no group is gathered.
    Stops when the edges are stars around their smallest nodes, which a count by node tells; ``rounds`` only
    guards against an endless loop and raises.
    """
    star = settle(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if are_stars(star):
            break
        ways = star.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")).select("way.*")
        low = ways.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = star.join(low, "b").select("a", F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") > F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"))
        star = settle(small.distinct())
    else:
        raise RuntimeError("linked groups did not settle")
    named = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("label")), F.struct(F.col("b").alias("node"), F.col("b").alias("label"))))
    return settle(star.select(named.alias("named")).select("named.*").distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether every larger end a of ``edges`` (a, b) has one edge, and is no smaller end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end"))
    by_node = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.min("end.up").alias("least"))
    return by_node.agg(F.coalesce(F.max((F.col("up") > F.col("least")).cast("int")), F.lit(0))).first()[0] == 0


def keeps_names(*own: str):
    """For a function that takes documents first and returns their columns: columns of the caller that are named
    like its ``own`` ones are set aside under free names while it works."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **settings) -> DataFrame:
            taken, aside = {c.lower() for c in docs.columns} | set(own), {}
            for name in (c for c in docs.columns if c.lower() in own):
                free = name
                while free.lower() in taken:
                    free += "_"
                taken.add(free.lower())
                aside[name] = free
            out = fn(docs.withColumnsRenamed(aside), *args, **settings)
            return out.withColumnsRenamed({free: name for name, free in aside.items()})

        return run

    return wrap


def row_keys(docs: DataFrame) -> DataFrame:
    """Adds ``_id``, the id or -1, and ``_mark``, a hash of the whole row: rows equal in both are equal in every column."""
    mark = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "_mark": mark})


def one_of_each(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """``rows`` (with row keys) with one row per group, that of the smallest id and mark; rows without id are all kept.

    ``grouped`` has doc_id, the row keys and group of every row. A kept row that is repeated whole stays once.
    """
    keys, rank = ["_id", "_mark"], F.struct("_id", "_mark")
    known = grouped.filter("doc_id IS NOT NULL")
    least = known.groupBy("group").agg(F.min(rank).alias("least"))
    gone = known.join(least, "group").filter(rank != F.col("least")).select(*keys).distinct()
    kept = attach(rows, gone, keys, how="left_anti")
    repeated = settle(rows.filter("doc_id IS NOT NULL").groupBy(*keys).count().filter("count > 1").select(*keys))
    if repeated.head(1):
        once = attach(kept, repeated, keys, how="left_semi").dropDuplicates(keys)
        kept = attach(kept, repeated, keys, how="left_anti").union(once)
    return kept.drop(*keys)
