"""Maximal periodic runs of words, by tiles scaled to the period.

A run is a stretch with smallest period q and at least max(``SHORTEST``, 2q) words that no neighbouring
word extends. The places i whose word equals the word at i + q form the run's stretch of matches, q
words shorter than the run; so finding runs is finding maximal stretches of matches per period.

Periods are handled by octave, from P to 2P - 1. Every stretch that belongs to a run of the octave holds
a boundary (a place of a grid of about P / 2) whose next words recur after one period. Hashes of word
grams tell where that may be, so only such boundaries go on: their document is exploded into tiles of
about 8P words with 2P to 4P words of its neighbours on either side. Tiles are dealt over the cluster
and solved alone. At a boundary, the Z-function of the words ahead gives for every period how far the
matches reach to the right, and the Z-function of the words behind, read backwards, how far to the left.
A period whose words are a power of shorter ones is dropped there: the whole run has the shorter period.

What reaches a tile's edge is a fragment. Fragments are shuffled by document and period, and touching
ones are joined. No step takes more than a document's own words; long ones are spread over their tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.llm.base import bytes_of, pieces, store
from pulseframe.llm.words import BASE, scramble
from pulseframe.session import settle

SHORTEST = 12
#: Words of a tile without its surroundings, at least and in periods.
TILE = 512
PERIODS = 8
#: Words around a boundary, at least.
AROUND = 16
#: Places compared at a time; bounds the memory of one step.
STEP = 1 << 20
RUN = "array<struct<start:bigint,period:bigint,length:bigint>>"


def octave_grid(low: int, shortest: int = SHORTEST) -> tuple[int, int]:
    """(words of a gram, distance of boundaries): a stretch of matches of any run with a period from ``low`` to
    2 * ``low`` - 1 holds a boundary followed by that many matches."""
    least = min(max(q, shortest - q) for q in range(low, 2 * low)) if low < shortest else low
    gram = 1 << min(least, max(4, least // 2)).bit_length() - 1
    return gram, least - gram + 1


def word_codes(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as numbers, equal where words are; and all in one array, with no number in two texts."""
    found, base = [], 0
    for text in texts:
        known: dict[bytes, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for w in text.split()], np.int32)
        found.append(codes)
    whole = []
    for codes in found:
        whole.append(codes.astype(np.uint64) + np.uint64(base))
        base += int(codes.max()) + 1 if len(codes) else 0
    return found, np.concatenate(whole) if whole else np.zeros(0, np.uint64)


def boundaries(codes: list[np.ndarray], whole: np.ndarray, shortest: int = SHORTEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(least period of the octave, text, place in the text) of the boundaries at which a run may be, octave by octave."""
    sizes = np.array([len(c) for c in codes])
    first = np.concatenate(([0], np.cumsum(sizes)))
    text_of = np.repeat(np.arange(len(codes)), sizes)
    single = scramble(whole)
    grams, span, low = single, 1, 1
    while 2 * low <= sizes.max(initial=0):
        gram, gap = octave_grid(low, shortest)
        if gram < span:
            grams, span = single, 1
        while span < gram:
            grams = scramble(grams[:-span] * BASE + grams[span:])
            span *= 2
        last = len(grams) - low - 1  # the last place with a partner in this octave
        places = np.arange(0, last + 1, gap)
        places = places[sizes[text_of[places]] >= 2 * low]
        if len(places):
            padded = np.concatenate((grams, np.zeros(low, np.uint64)))
            partners = np.lib.stride_tricks.sliding_window_view(padded, low)
            rows = max(1, STEP // low)
            hit = np.concatenate([(partners[p + low] == grams[p][:, None]).any(axis=1) for p in np.array_split(places, -(-len(places) // rows))])
            places = places[hit]
            if len(places):
                yield low, text_of[places], places - first[text_of[places]]
        low *= 2


def tiles(codes: np.ndarray, low: int, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, words with their surroundings, boundaries relative to the first word) of each tile that has boundaries."""
    core, behind, ahead = max(TILE, PERIODS * low), max(AROUND, 2 * low), max(2 * AROUND, 4 * low)
    number = places // core
    for tile in np.unique(number).tolist():
        start, end = max(0, tile * core - behind), min(len(codes), (tile + 1) * core + ahead)
        yield start, codes[start:end], places[number == tile] - start


def z_function(s: list[int], upto: int) -> list[int]:
    """For every place before ``upto``, how many symbols from there on equal the beginning of ``s``."""
    n = len(s)
    z = [0] * upto
    if upto:
        z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            z[i], left, right = k, i, i + k
    return z


def prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def around(words: list[int], at: int, low: int, least: int) -> list[tuple[int, int, int]]:
    """(period, matches behind, matches ahead) at the boundary ``at`` for the primitive periods of the octave that
    match at least ``least`` words ahead."""
    ahead = words[at:]
    z = z_function(ahead, min(2 * low, len(ahead)))
    wanted = [q for q in range(low, len(z)) if z[q] >= least and not any(z[q // p] >= q - q // p for p in prime_factors(q))]
    if not wanted:
        return []
    behind = words[:at][::-1]
    reach = wanted[-1]
    back = behind + [-1] + words[: at + reach][::-1]
    zb = z_function(back, len(behind) + 2 + reach - wanted[0])
    return [(q, min(zb[len(behind) + 1 + reach - q], at), z[q]) for q in wanted]


def solve(words: np.ndarray, marks: np.ndarray, low: int, is_first: bool, is_last: bool, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(period, first match, one past the last) of the stretches of matches in one tile, cut at what a boundary sees.

    Stretches that can't be part of a run are left out; they end inside the words around their boundary.
    """
    behind, ahead = max(AROUND, 2 * low), max(2 * AROUND, 4 * low)
    least = octave_grid(low, shortest)[0]
    seen: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    found: dict[int, list[list[int]]] = {}
    for b in marks.tolist():
        start, end = max(0, b - behind), min(len(words), b + ahead)
        part = words[start:end]
        key = b - start, part.tobytes()  # inside a run of a short period the same words come again and again
        known = seen.get(key)
        if known is None:
            known = seen[key] = around(part.tolist(), b - start, low, least)
        for q, left, right in known:
            whole_left = left < b - start or (start == 0 and is_first)
            whole_right = b + right + q < end or (end == len(words) and is_last)
            if whole_left and whole_right and left + right < max(q, shortest - q):
                continue
            stretches = found.setdefault(q, [])
            if stretches and b - left <= stretches[-1][1]:
                stretches[-1][0] = min(stretches[-1][0], b - left)
                stretches[-1][1] = max(stretches[-1][1], b + right)
            else:
                stretches.append([b - left, b + right])
    return [(q, a, z) for q, stretches in found.items() for a, z in stretches]


def kept_words(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run (start, period, length) contains after its first period, joined by one space."""
    words = text.split()
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    stays = np.cumsum(edges[:-1]) == 0
    return b" ".join([w for w, stay in zip(words, stays.tolist()) if stay])


SCANNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.binary()), ("text", pa.binary()),
    ("low", pa.int64()), ("tile", pa.int64()), ("start", pa.int64()), ("is_last", pa.bool_()), ("words", pa.binary()), ("marks", pa.binary()),
])


def scan(docs: DataFrame, text: str, digest: Callable[[bytes], bytes], shortest: int) -> DataFrame:
    """Stored rows of two kinds: one per document (``n_words`` set), and one per tile that may hold a run (``low`` set).

    A document without such tiles has its result in ``kept``, any other its text.
    """

    def batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = bytes_of(batch.column("text"))
        codes, whole = word_codes(texts)
        rows = batch.column("row").to_pylist()
        asked = np.zeros(len(texts), bool)
        for low, text_of, places in boundaries(codes, whole, shortest):
            listed = []
            for i in np.unique(text_of).tolist():
                asked[i] = True
                core = max(TILE, PERIODS * low)
                for start, words, marks in tiles(codes[i], low, places[text_of == i]):
                    listed.append((rows[i], None, None, None, None, low, int(marks[0] + start) // core, start, start + len(words) == len(codes[i]), words.tobytes(), marks.astype(np.int32).tobytes()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*listed), SCANNED)], schema=SCANNED)
        kept = [None if a else digest(kept_words(t, [])) for t, a in zip(texts, asked.tolist())]
        left = [t if a else None for t, a in zip(texts, asked.tolist())]
        head = [batch.column("row"), batch.column("doc_id"), pa.array([len(c) for c in codes], pa.int64()), pa.array(kept, pa.binary()), pa.array(left, pa.binary())]
        yield pa.record_batch(head + [pa.nulls(batch.num_rows, f.type) for f in list(SCANNED)[len(head) :]], schema=SCANNED)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece in pieces(batch, "text"):
                yield from batches(piece)

    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # Stored, so that the row numbers are given once.
    return store(rows.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in SCANNED)), "scanned")


def stretches(scanned: DataFrame, shortest: int) -> DataFrame:
    """(row, start, period, length) of every run: tiles solved alone, fragments of a document and period joined."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out: list[tuple[int, int, int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("row", "low", "start", "is_last", "words", "marks")]
            for row, low, start, is_last, words, marks in zip(*columns):
                solved = solve(np.frombuffer(words, np.int32), np.frombuffer(marks, np.int32), low, start == 0, is_last, shortest)
                out += [(row, q, start + a, start + z) for q, a, z in solved]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "period", "low", "high"])

    dealt = scanned.filter("low IS NOT NULL").select("row", "low", "tile", "start", "is_last", "words", "marks").repartition("row", "low", "tile")
    fragments = dealt.drop("tile").mapInArrow(run, "row bigint, period bigint, low bigint, high bigint")
    one = Window.partitionBy("row", "period").orderBy("low", "high")
    before = F.max("high").over(one.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.when(F.col("low") <= before, 0).otherwise(1))
    joined = opened.withColumn("part", F.sum("opens").over(one)).groupBy("row", "period", "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    matches = F.col("high") - F.col("start")
    runs = joined.filter(matches >= F.greatest("period", F.lit(shortest) - F.col("period")))
    return runs.select("row", "start", "period", (matches + F.col("period")).alias("length"))


def finished(docs: DataFrame, text: str, shortest: int, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(doc_id, n_words, runs, kept) of every document; ``kept`` is ``digest`` of the words that stay."""
    scanned = scan(docs, text, digest, shortest)
    found = settle(stretches(scanned, shortest).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")))
    whole = scanned.filter("n_words IS NOT NULL").select("row", "doc_id", "n_words", "kept", "text")
    names = ["doc_id", "n_words", "runs", "kept"]

    def collapse(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = batch.column("runs").to_pylist()
        kept = [digest(kept_words(t, [(r["start"], r["period"], r["length"]) for r in found or ()])) for t, found in zip(bytes_of(batch.column("text")), runs)]
        return pa.record_batch([*map(batch.column, names[:3]), pa.array(kept, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(collapse, pieces(batch, "text"))

    asked = whole.filter("kept IS NULL").drop("kept").join(found, "row", "left")
    done = asked.select("doc_id", "n_words", "runs", "text").mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUN}, kept binary")
    plain = whole.filter("kept IS NOT NULL").select("doc_id", "n_words", F.lit(None).cast(RUN).alias("runs"), "kept")
    return done.union(plain).withColumn("runs", F.coalesce("runs", F.array().cast(RUN)))


def sha256(value: bytes) -> bytes:
    return hashlib.sha256(value).hexdigest().encode()


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256) of every document, ``runs`` by start and then period.

    Words are what lies between ASCII white space. Null and empty texts have no words and no runs; rows
    of one id, repeated rows and rows without id are judged one by one. Other columns are not read, so
    their names don't matter. Empty in, empty out.
    """
    return finished(docs, text, shortest, sha256).select("doc_id", "n_words", "runs", F.col("kept").cast("string").alias("collapsed_sha256"))


def collapsed(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, text): every document with only the first period of its runs, words joined by one space."""
    return finished(docs, text, shortest, bytes).select("doc_id", "n_words", "runs", F.col("kept").cast("string").alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null if there is none."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(keyed)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the query's contract: in about one document of ten the words from a place on repeat with a period."""
    draw = F.crc32(doc_id.cast("string"))
    g = F.floor(draw / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        copies = F.ceil((n - a) / p)
        period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(period, copies.cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((draw % 10 == 0) & text.isNotNull(), F.transform(F.array(words), repeated)[0]).otherwise(text)
