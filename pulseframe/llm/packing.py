"""Packing of token pieces into as few sequences as possible: large items by matching, small ones by best fit.

At most two items above a third of the capacity share a sequence, so these are matched: the largest left
goes with the largest that fits beside it, which makes the most pairs. The other items follow from large
to small, each into the smallest gap that holds it.

Sizes are whole numbers up to the capacity, so all this works on counts of sizes: at most ``capacity``
numbers, however many documents there are. A step of the plan treats all items of a size and all
sequences of a gap alike; it says which numbers of a size go to which sequences, and where. Every item
then finds its place by its size and its number among the items of that size. Numbers are counted per
task while tokenizing, and the tasks' counts are summed up afterwards; no size is gathered anywhere.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.llm.base import bytes_of, pieces, store
from pulseframe.operators.joins import attach

CAPACITY = 2048
END = 0
#: Strings between white space whose ids are remembered, and their longest length in bytes.
KEPT, KEPT_BYTES = 400_000, 64


#: Letters of ASCII and Latin-1, then perhaps marks other than the apostrophe: one word and one run of marks to the tokenizer.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level tokenizers write a byte: as the character of that number if it can be seen, else as one from 256 on.
AS_CHARACTER = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Ids of texts, little-endian 32-bit, from a byte-level tokenizer of lower-case words and runs of marks that drops white space.

    No id reaches over white space, so what lies between is encoded by itself, once for some texts, and
    remembered while it keeps coming: of two generations of ``KEPT`` strings the older one is dropped.
    Strings of plain letters and marks go to the tokenizer's model word by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def whole(self, strings: list[bytes]) -> Iterator[bytes]:
        encoded = self.tokenizer.encode_batch([s.decode("utf-8", "replace") for s in strings], add_special_tokens=False)
        return (array("I", e.ids).tobytes() for e in encoded)

    def plain(self, letters: bytes, marks: bytes) -> bytes:
        letters = letters.decode().lower().encode()
        ids = self.young.get(letters) or self.old.get(letters)
        if ids is None:
            spelled = letters.decode("latin-1").translate(AS_CHARACTER)
            ids = self.young[letters] = array("I", [t.id for t in self.word(spelled)]).tobytes()
        if marks not in self.marks:
            if len(self.marks) > KEPT:
                self.marks = {b"": b""}
            self.marks[marks] = next(self.whole([marks]))
        return ids + self.marks[marks]

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        split = [text.split() for text in texts]  # ASCII white space
        here: dict[bytes, bytes | None] = {}
        for strings in split:
            here.update(dict.fromkeys(strings))
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        other, fresh = [], []
        for s in here:
            known = young.get(s)
            if known is None and (known := old.get(s)) is not None:
                young[s] = known
            if known is None:
                simple = PLAIN.fullmatch(s) if len(s) <= KEPT_BYTES else None
                if simple:
                    known = self.plain(*simple.groups())
                else:
                    other.append(s)
                fresh.append(s)
            here[s] = known
        here.update(zip(other, self.whole(other)))
        young.update((s, here[s]) for s in fresh if len(s) <= KEPT_BYTES)
        for strings in split:
            yield b"".join(map(here.__getitem__, strings))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for a worker process, whatever number of tasks it runs."""
    return Encoder(path)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces (doc_id, piece, start, length, ids_crc32, task, number): ``number`` counts a task's pieces of that length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = encoder(path), TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), known.ids(bytes_of(part.column("text")))):
                    ids = found + END.to_bytes(4, "little")
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), task, int(counts[length])))
                        counts[length] += 1
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Stored once: a task that is run again gives its pieces the same numbers, and later reads find those.
    return store(texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)), "pieces")


@dataclass
class Plan:
    """Places of sizes: numbers ``low`` to ``high`` - 1 of ``size`` lie ``per`` to a sequence, from ``base`` on, at ``offset``."""

    capacity: int
    sequences: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    placed: dict[int, int] = field(default_factory=dict)

    def place(self, size: int, count: int, base: int, offset: int, per: int = 1) -> None:
        low = self.placed.get(size, 0)
        self.rows.append((size, low, low + count, base, offset, per))
        self.placed[size] = low + count

    def open(self, count: int) -> int:
        """The first of ``count`` new sequences."""
        self.sequences += count
        return self.sequences - count


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the items go, from how many there are of each size (1 to ``capacity``)."""
    plan, left = Plan(capacity), {s: n for s, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many) of the sequences that have it
    order: list[int] = []

    def leave(gap: int, base: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((base, count))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        fits = bisect_left(large, capacity - size + 1) - 1
        if fits >= 0 and large[fits] == size and left[size] == 1:
            fits -= 1
        if fits < 0:
            pairs, other = left[size], 0
            base = plan.open(pairs)
            plan.place(size, pairs, base, 0)
            left[size] = 0
        else:
            other = large[fits]
            pairs = left[size] // 2 if other == size else min(left[size], left[other])
            base = plan.open(pairs)
            plan.place(size, pairs, base, 0)
            plan.place(other, pairs, base, size)
            left[size] -= pairs
            left[other] -= pairs
        leave(capacity - size - other, base, pairs)
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):
                per = capacity // size
                leave(capacity, plan.open(-(-left[size] // per)), -(-left[size] // per))
                continue
            gap = order[at]
            base, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = gap // size
            used = min(count, left[size] // per)
            if used:
                plan.place(size, used * per, base, capacity - gap, per)
                left[size] -= used * per
                leave(gap - per * size, base, used)
            elif left[size]:  # fewer than fill one sequence
                plan.place(size, left[size], base, capacity - gap, per)
                leave(gap - left[size] * size, base, 1)
                left[size], used = 0, 1
            leave(gap, base + used, count - used)
    return plan


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document's ids end with ``END``; a null or empty text has only that one. Documents longer than
    ``capacity`` are cut into pieces of that length, the last one may be shorter. Rows of one id,
    repeated rows and rows without id are documents of their own. Other columns are not read. Empty
    in, empty out. ``path`` is the tokenizer's file, which every executor must have.
    """
    cut = cut_pieces(docs, path, capacity)
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("pieces"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("task", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("first"))
    counts = {r["length"]: r["pieces"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("pieces")).collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(pack(counts, capacity).rows), np.int64).reshape(-1, 6)
    # As many rows as sizes meet gaps, both at most ``capacity``; it doesn't grow with the documents.
    plan = docs.sparkSession.sparkContext.broadcast(rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, _, base, offset, per = plan.value.T
        wide = np.int64(1 << 48)
        steps = size * wide + low
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("first").to_numpy() + batch.column("number").to_numpy()
            at = np.searchsorted(steps, length * wide + number, "right") - 1
            past = number - low[at]
            found = [pa.array(base[at] + past // per[at]), pa.array(offset[at] + past % per[at] * length)]
            yield pa.record_batch([*map(batch.column, names[:5]), *found], names)

    placed = attach(cut, firsts, ["task", "length"]).select(*names[:5], "first", "number")
    return placed.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).withColumn("piece", F.col("piece").cast("int"))
