"""Removal of every byte inside a string of ``size`` bytes that also starts elsewhere, by suffix sorting.

Two equal strings hold the same smallest k-gram hash at the same offset. So every text is cut into its
anchors, the places whose k-gram is the smallest of some string, each with the range of starts it
stands for; a string can only repeat where its anchor's hash does, and only anchors whose hash occurs
again go on, with the bytes around them: the prefix of a suffix to the right, and reversed to the left.

Within a range of hashes the suffixes to the right are put in order by deep-shallow sorting: multikey
quicksort on characters of eight bytes down to ``SHALLOW`` bytes, and a blind trie for what is then
still equal. The same is done for the reversed left sides. A string that starts ``o`` bytes before its
anchor repeats if another member agrees with it on at least ``o`` bytes to the left and ``size - o``
to the right: runs of the two orders whose common prefixes are that long. Bytes decide here, hashes only
bring candidates together.

Where all members of an anchor hash have the same bytes for all their strings, the strings repeat as they
are and are not looked at again; digests taken with the anchors tell. Any other anchor
hash with more than ``CROWDED`` members is not sorted in one task. Its members are first classed by
all bytes they stand for: a class of two or more repeats as a whole, and one member speaks for it from then
on. Where an anchor has several classes, the offsets of the speakers are cut into stretches of ``STRETCH``;
all strings of a stretch share a core, and strings with different cores differ. Speakers are classed by core
and by all bytes of the stretch, and only one of each class whose core other classes have too lists its
single strings. Classes are told apart by 128-bit digests, counted with partial sums before the shuffle:
beyond ``CROWDED`` members digests decide, not bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.base import arrow_pass, bytes_of, keeps_names, store
from pulseframe.operators.joins import attach
from pulseframe.session import settle

SIZE = 400
GRAM = 32
SHALLOW = 64
CROWDED = 1000
STRETCH = 64
#: Members sorted together; a block holds whole hash groups, so up to CROWDED more.
BLOCK = 20_000
PLACES = np.uint64((1 << 24) - 1)
SLAB = 1 << 23
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on."""
    h, span, factor = GEAR[text], 1, int(ODD)
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % 2**64
        span *= 2
    h ^= h >> np.uint64(32)
    h *= ODD
    return h ^ (h >> np.uint64(29))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of every anchor; each start of a string belongs to one.

    Long texts go slab by slab; an anchor whose starts lie in two slabs is listed twice, with either part.
    """
    found, array = [], np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(array) - size + 1), SLAB):
        hashes = gram_hashes(array[at : at + SLAB + size - 1])
        keys = (hashes & ~PLACES) | np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the leftmost
        least = sliding_least(keys, size - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:] - 1, [len(least) - 1]))
        place = (least[first] & PLACES).astype(np.int64)
        found.append((hashes[place], place + at, first + at, last + at))
    if not found:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    return tuple(map(np.concatenate, zip(*found)))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Branch:
    """A node of a blind trie: the place where its strings first differ, and a child for each byte there (-1: the end)."""

    __slots__ = ("place", "children")

    def __init__(self, place: int, children: dict):
        self.place, self.children = place, children


def blind_trie(group: list[int], strings: list[bytes]) -> list[int]:
    """Order of strings that share a long prefix. A descent looks at one byte a node, blind to the rest;
    one comparison with the leaf it reaches then tells where the new string really leaves the path."""
    equal: dict[bytes, list[int]] = {}
    for i in group:
        equal.setdefault(strings[i], []).append(i)
    distinct = iter(equal)
    root: Branch | bytes = next(distinct)
    byte = lambda s, place: s[place] if place < len(s) else -1
    for s in distinct:
        node = root
        while isinstance(node, Branch):
            node = node.children.get(byte(s, node.place)) or next(iter(node.children.values()))
        leave = common(s, node)
        parent, node = None, root
        while isinstance(node, Branch) and node.place < leave:
            parent, node = node, node.children[byte(s, node.place)]
        if isinstance(node, Branch) and node.place == leave:
            node.children[byte(s, leave)] = s
            continue
        some = node
        while isinstance(some, Branch):
            some = next(iter(some.children.values()))
        fork = Branch(leave, {byte(some, leave): node, byte(s, leave): s})
        if parent is None:
            root = fork
        else:
            parent.children[byte(s, parent.place)] = fork
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, Branch):
            waiting += [child for _, child in sorted(node.children.items(), key=lambda c: -c[0])]
        else:
            order += equal[node]
    return order


def deep_shallow(strings: list[bytes], matrix: np.ndarray) -> list[int]:
    """The order of ``strings``; ``matrix`` has their bytes, padded with zeros, a row each."""
    characters = np.ascontiguousarray(matrix[:, :SHALLOW]).view(">u8").tolist()
    deepest = SHALLOW // 8
    order: list[int] = []
    waiting = [(list(range(len(strings))), 0)]
    while waiting:
        group, depth = waiting.pop()
        if len(group) == 1:
            order += group
        elif depth == deepest:
            order += blind_trie(group, strings)
        else:
            pivot = characters[group[len(group) // 2]][depth]
            less = [i for i in group if characters[i][depth] < pivot]
            same = [i for i in group if characters[i][depth] == pivot]
            if len(less) + len(same) < len(group):
                waiting.append(([i for i in group if characters[i][depth] > pivot], depth))
            waiting.append((same, depth + 1))
            if less:
                waiting.append((less, depth))
    return order


def ordered(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before) of strings of up to ``width`` bytes."""
    lengths = np.array([len(s) for s in strings])
    width = -(-max(width, SHALLOW) // 8) * 8
    matrix = np.zeros((len(strings), width), np.uint8)
    matrix[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    order = np.array(deep_shallow(strings, matrix))
    shared = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        upto = min(len(order), at + 4096)
        differ = matrix[order[at:upto]] != matrix[order[at - 1 : upto - 1]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[at:upto] = np.minimum(first, np.minimum(lengths[order[at:upto]], lengths[order[at - 1 : upto - 1]]))
    return order, shared


def repeated_starts(left: list[bytes], right: list[bytes], near: np.ndarray, far: np.ndarray, size: int) -> np.ndarray:
    """For every member (row) and offset of the anchor in the string (column): does the string repeat?

    ``left`` ends and ``right`` begins at the anchor; a member stands for offsets ``near`` to ``far``.
    """
    width = size - GRAM + 1
    flags = np.zeros((len(right), width), bool)
    by_right, shared_right = ordered(right, size)
    by_left, shared_left = ordered([r[:GRAM] + x[::-1] for x, r in zip(left, right)], GRAM + width)
    group_right, group_left = np.empty(len(right), np.int64), np.empty(len(right), np.int64)
    for offset in range(int(near.min()), int(far.max()) + 1):
        active = np.flatnonzero((near <= offset) & (offset <= far))
        if len(active) < 2:
            continue
        group_right[by_right] = np.cumsum(shared_right < size - offset)
        group_left[by_left] = np.cumsum(shared_left < GRAM + offset)
        keys = group_right[active] * (len(right) + 1) + group_left[active]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(active), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        flags[active[twice], offset] = True
    return flags


def keyed(docs: DataFrame) -> DataFrame:
    """(id, mark, text): rows are told apart by id and text; rows equal in both are equal in every result."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("id"), F.xxhash64("doc_id", F.col("doc_id").isNull(), text).alias("mark"), text.alias("text"))


def repeated_spans(docs: DataFrame, size: int = SIZE, crowded: int = CROWDED) -> DataFrame:
    """(id, mark, starts, ends): spans whose every byte lies in a repeated string, for documents that have any.

    ``docs`` has id, mark and text; spans may overlap.
    """

    def list_anchors(batch: pa.RecordBatch):
        hashes, places, ids, marks, wholes = [], [], [], [], []
        for text, i, m in zip(bytes_of(batch.column("text")), batch.column("id").to_pylist(), batch.column("mark").to_pylist()):
            h, place, first, last = anchors(text, size)
            hashes.append(h.view(np.int64))
            wholes.append(np.array([xxhash.xxh3_64_intdigest(text[a : b + size], p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())], np.uint64).view(np.int64))
            places.append(place)
            ids.append(np.full(len(h), i, np.int64))
            marks.append(np.full(len(h), m, np.int64))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in (hashes, places, ids, marks, wholes)], ["hash", "place", "id", "mark", "whole"])

    listed = arrow_pass(docs, list_anchors, "hash bigint, place bigint, id bigint, mark bigint, whole bigint", "text")
    # Stored, so that both sides of the join are plain exchanges and a hot hash is split.
    kinds = listed.groupBy("hash").agg(F.count(F.lit(1)).alias("members"), (F.min("whole") == F.max("whole")).alias("same"))
    counts = settle(kinds.filter("members > 1"))
    of = lambda kind: F.collect_set(F.when(kind, F.col("place")))
    few = ~F.col("same") & (F.col("members") <= crowded)
    again = listed.drop("whole").join(counts, "hash").groupBy("id", "mark").agg(
        of(F.col("same")).alias("settled"), of(few).alias("places"), of(~F.col("same") & (F.col("members") > crowded)).alias("crowds")
    )

    def list_members(batch: pa.RecordBatch):
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("id", "mark", "settled", "places", "crowds"))
        for text, i, m, settled, places, crowds in zip(bytes_of(batch.column("text")), *columns):
            h, place, first, last = anchors(text, size)
            few, many = np.isin(place, np.array(places, np.int64)), np.isin(place, np.array(crowds, np.int64))
            known = np.flatnonzero(np.isin(place, np.array(settled, np.int64)))
            for a, b in merged([(int(first[k]), int(last[k]) + size) for k in known]):
                rows.append((i, m, *[None] * 8, a, b - a, None))
            for k in np.flatnonzero(few | many).tolist():
                p, a, b = int(place[k]), int(first[k]), int(last[k])
                if few[k]:
                    rows.append((i, m, int(h[k].view(np.int64)), p, p - b, p - a, text[a:p], text[p : b + size], *[None] * 5))
                if many[k]:
                    rows.append((i, m, int(h[k].view(np.int64)), *[None] * 5, *halves(text[a : b + size] + b"%d %d" % (p - a, p - b)), a, b - a + 1, p))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), MEMBER)], schema=MEMBER) if rows else None

    schema = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in MEMBER)
    # One join with the texts serves both ways, so its rows are stored.
    around = store(arrow_pass(docs.join(again, ["id", "mark"]).select("id", "mark", "settled", "places", "crowds", "text"), list_members, schema, "text"), "members")
    few = around.filter("count IS NULL").select("hash", "id", "mark", "place", "near", "far", "left", "right")
    whole = around.filter("hash IS NULL").select("id", "mark", "start", (F.col("start") + F.col("count")).alias("end"))
    found = whole.union(sorted_spans(few, size))
    rows = around.filter("hash IS NOT NULL AND count IS NOT NULL").select("hash", *WHOLE, "id", "mark", "start", "count", "shared")
    if rows.head(1):
        found = found.union(crowded_spans(docs, rows, size, crowded))
    return found.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def halves(value: bytes) -> tuple[int, int]:
    """A 128-bit digest as two longs."""
    d = xxhash.xxh3_128_digest(value)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


CORE, WHOLE = ["core1", "core2"], ["whole1", "whole2"]
#: What is listed for an anchor: its bytes to both sides, or in a crowded one the digest of all its strings.
MEMBER = pa.schema([
    *((c, pa.int64()) for c in ("id", "mark", "hash", "place", "near", "far")), ("left", pa.binary()), ("right", pa.binary()),
    *((c, pa.int64()) for c in (*WHOLE, "start", "count", "shared")),
])

STRETCHES = [*CORE, *WHOLE, "id", "mark", "start", "count", "shared"]


def stretches(text: bytes, place: int, near: int, far: int, size: int) -> list[tuple[int, ...]]:
    """(core, whole, start, count, start of the core) of each stretch of the offsets ``near`` to ``far`` of an anchor."""
    found = []
    for low in range(near - near % STRETCH, far + 1, STRETCH):
        begin, end = place - min(far, low + STRETCH - 1), place - max(near, low)
        core = halves(text[place - low : place + size - low - STRETCH + 1])
        found.append((*core, *halves(text[begin : end + size] + b"%d %d" % (place - begin, place - end)), begin, end - begin + 1, place - low))
    return found


def sorted_spans(members: DataFrame, size: int) -> DataFrame:
    """(id, mark, start, end) from members (hash, id, mark, place, near, far, left, right) by suffix order, whole hash groups at a time."""

    def sort_blocks(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK:
                block = pa.Table.from_batches(held).combine_chunks()
                hashes = block.column("hash").to_numpy()
                cut = int(np.searchsorted(hashes, hashes[-1]))  # the last group may go on
                if cut:
                    yield from emit(block.slice(0, cut))
                    block = block.slice(cut)
                held, count = block.combine_chunks().to_batches(), block.num_rows
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    def emit(block: pa.Table):
        if not block.num_rows:
            return
        near, far = block.column("near").to_numpy(), block.column("far").to_numpy()
        flags = repeated_starts(block.column("left").to_pylist(), block.column("right").to_pylist(), near, far, size)
        place = block.column("place").to_numpy()
        edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)  # offsets low to high - 1: starts place - high + 1 to place - low
        take = pa.array(row)
        columns = [block.column("id").take(take), block.column("mark").take(take), pa.array(place[row] - high + 1), pa.array(place[row] - low + size)]
        yield from pa.Table.from_arrays(columns, names=["id", "mark", "start", "end"]).combine_chunks().to_batches()

    placed = members.repartition("hash").sortWithinPartitions("hash")
    return placed.mapInArrow(sort_blocks, "id bigint, mark bigint, start bigint, end bigint")


def crowded_spans(docs: DataFrame, ranges: DataFrame, size: int, crowded: int) -> DataFrame:
    """(id, mark, start, end) of the repeated strings of the members ``ranges`` of crowded anchors.

    ``ranges`` has hash, whole1, whole2, id, mark, start, count and shared, the anchor's place. Classes of
    two or more repeat as a whole; where an anchor has other classes, one member of each is compared with
    them stretch by stretch. Repeated classes are joined by broadcast if they are few, else the join is
    split where a class is hot.
    """
    member = F.struct("id", "mark", "start", "count", "shared")
    known = store(ranges.groupBy("hash", *WHOLE).agg(F.count(F.lit(1)).alias("times"), F.min(member).alias("one")), "ranges")
    again = attach(ranges, known.filter("times > 1").select("hash", *WHOLE), ["hash", *WHOLE])
    found = again.select("id", "mark", "start", (F.col("start") + F.col("count") - 1 + size).alias("end"))
    several = settle(known.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("hash"))
    if not several.head(1):
        return found
    speakers = settle(attach(known, several, "hash").select("one.*").groupBy("id", "mark").agg(F.collect_list(F.struct("start", "count", "shared")).alias("asked")))

    def list_stretches(batch: pa.RecordBatch):
        out = []
        for text, i, m, wanted in zip(bytes_of(batch.column("text")), *(batch.column(c).to_pylist() for c in ("id", "mark", "asked"))):
            for a in wanted:
                p, last = a["shared"], a["start"] + a["count"] - 1
                out += [(*s[:4], i, m, *s[4:]) for s in stretches(text, p, p - last, p - a["start"], size)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], STRETCHES) if out else None

    speaking = attach(docs, speakers, ["id", "mark"]).select("id", "mark", "asked", "text")
    rows = store(arrow_pass(speaking, list_stretches, ", ".join(f"{c} bigint" for c in STRETCHES), "text"), "stretches")
    return found.union(stretch_spans(docs, rows, size, crowded))


def stretch_spans(docs: DataFrame, rows: DataFrame, size: int, crowded: int) -> DataFrame:
    """(id, mark, start, end) of the repeated strings in the stretches ``rows``.

    Classes of two or more repeat as a whole. One member of every class whose core other classes have
    too is compared with theirs: by suffix order, or where a core has more than ``crowded`` classes by
    the digests of its single strings. A class of one has no other member to pass the result on to.
    """
    classes = store(rows.groupBy(*CORE, *WHOLE).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "mark", "start", "count", "shared")).alias("one")), "classes")
    contested = settle(classes.groupBy(*CORE).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    speakers = classes.join(contested, CORE).select("core1", "kinds", "one.*")
    asked = settle(speakers.groupBy("id", "mark").agg(F.collect_list(F.struct("core1", "kinds", "start", "count", "shared")).alias("asked")))
    kinds = {"hash": pa.int64(), "id": pa.int64(), "mark": pa.int64(), "place": pa.int64(), "near": pa.int64(), "far": pa.int64(), "left": pa.binary(), "right": pa.binary()}

    def list_members(batch: pa.RecordBatch):
        out = []
        for text, i, m, wanted in zip(bytes_of(batch.column("text")), *(batch.column(c).to_pylist() for c in ("id", "mark", "asked"))):
            for a in wanted:
                begin, last, p = a["start"], a["start"] + a["count"] - 1, a["shared"]
                if a["kinds"] <= crowded:
                    out.append((a["core1"], i, m, p, p - last, p - begin, text[begin:p], text[p : last + size]))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], list(kinds)) if out else None

    def list_strings(batch: pa.RecordBatch):
        out = []
        for text, i, m, wanted in zip(bytes_of(batch.column("text")), *(batch.column(c).to_pylist() for c in ("id", "mark", "asked"))):
            for a in wanted:
                if a["kinds"] > crowded:
                    out += [(*halves(text[at : at + size]), i, m, at) for at in range(a["start"], a["start"] + a["count"])]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["high", "low", "id", "mark", "start"]) if out else None

    known = attach(rows, classes.filter("times > 1").select(*WHOLE).distinct(), WHOLE)
    found = known.select("id", "mark", "start", (F.col("start") + F.col("count") - 1 + size).alias("end"))
    speaking = attach(docs, asked, ["id", "mark"]).select("id", "mark", "asked", "text")
    schema = ", ".join(f"{c} {'binary' if k == pa.binary() else 'bigint'}" for c, k in kinds.items())
    found = found.union(sorted_spans(arrow_pass(speaking, list_members, schema, "text"), size))
    if not contested.filter(F.col("kinds") > crowded).head(1):
        return found
    strings = store(arrow_pass(speaking, list_strings, "high bigint, low bigint, id bigint, mark bigint, start bigint", "text"), "strings")
    twice = strings.groupBy("high", "low").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    single = strings.join(twice, ["high", "low"])
    return found.union(single.select("id", "mark", "start", (F.col("start") + size).alias("end")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans in order of their starts."""
    runs: list[list[int]] = []
    for start, end in spans:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    runs = merged([(s["start"], s["end"]) for s in spans or ()])
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in runs), len(runs)


def with_spans(docs: DataFrame, size: int, crowded: int) -> DataFrame:
    """``docs`` with ``_spans`` (null where nothing repeats); all rows stay."""
    rows = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "_mark": F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))})
    spans = repeated_spans(keyed(docs), size, crowded).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    return rows.join(spans, ["_id", "_mark"], "left").drop("_id", "_mark")


def repeats(docs: DataFrame, size: int = SIZE, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document (doc_id, text).

    Texts are their UTF-8 bytes, null is empty; matches never cross documents, may overlap, and lie in
    the same document or another; equal rows are different places. Other columns are not read.
    """

    def measure(batch: pa.RecordBatch):
        texts = bytes_of(batch.column("text"))
        found = [cut(text, spans) for text, spans in zip(texts, batch.column("_spans").to_pylist())]
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [f[1] for f in found], [f[2] for f in found])), pa.array([hashlib.sha256(f[0]).hexdigest() for f in found])]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), size, crowded)
    return arrow_pass(rows, measure, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", "text")


@keeps_names("_id", "_mark", "_spans")
def without_repeats(docs: DataFrame, size: int = SIZE, crowded: int = CROWDED) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` and, if there, ``n_chars`` set anew.

    All rows stay; a text that repeats as a whole is empty afterwards, a null text stays null. A
    character that a cut splits is dropped whole.
    """

    def shorten(batch: pa.RecordBatch):
        texts, spans = batch.column("text"), batch.column("_spans").to_pylist()
        short = [cut(text, s)[0].decode("utf-8", "ignore") if s else None for text, s in zip(bytes_of(texts), spans)]
        return pc.coalesce(pa.array(short, texts.type), texts)

    rows = with_spans(docs, size, crowded)
    columns = docs.columns

    def run(batch: pa.RecordBatch):
        return pa.record_batch([shorten(batch) if c == "text" else batch.column(c) for c in columns], columns)

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    short = arrow_pass(rows.select(*columns, "_spans"), run, kinds, "text")
    return short.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in columns else short
