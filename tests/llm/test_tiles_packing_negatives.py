"""Periodic runs, packing and hard negatives against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import bond, packing, periodic

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_runs(words, shortest=12):
    """Every period by itself, over the whole text."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(shortest, 2 * q) and not any(
                q % d == 0 and all(words[j] == words[j + d] for j in range(start, start + length - d)) for d in range(1, q)
            ):
                found.append((start, q, length))
    return sorted(found)


def plain_kept(words, runs):
    gone = {i for start, q, length in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(3)
    word = lambda k: f"w{rng.randrange(k)}"
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "é " * 40, "a b " * 6 + "a", "A a " * 9]
    for size in (2, 3, 5, 8, 13, 40, 90, 300, 700):
        period = [word(50) for _ in range(size)]
        for copies in (2, 2.5, 4):
            body = [period[i % size] for i in range(int(size * copies))]
            texts.append(" ".join([word(9) for _ in range(rng.randrange(40))] + body + [word(9) for _ in range(rng.randrange(40))]))
    texts += [" ".join(word(2) for _ in range(400)) for _ in range(6)]
    texts += [" ".join(["x"] * 1500 + ["y"] + ["x"] * 1500 + ["y"] * 30 + ["x"] * 100)]
    inner = ["p", "q", "r"] * 9 + ["s"]
    texts += [" ".join(inner * 6 + ["t"] + inner * 6 + ["t"])]
    fib = ["a", "a b"]
    while len(fib) < 14:
        fib.append(fib[-1] + " " + fib[-2])
    return texts + [fib[-1]]


@pytest.fixture(scope="module")
def texts():
    return periodic_texts()


def clashing(spark, texts, parts=4):
    rows = [(None if k % 11 == 3 else k // 2, t, 1, 2, "x", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row int, low int, _id string, length int").repartition(parts)


def test_runs_are_those_of_a_plain_search(spark, texts):
    found = periodic.periodic_runs(clashing(spark, texts)).collect()
    plain = []
    for k, t in enumerate(texts):
        words = (t or "").split()
        runs = plain_runs(words)
        plain.append((None if k % 11 == 3 else k // 2, len(words), runs, hashlib.sha256(plain_kept(words, runs).encode()).hexdigest()))
    ours = [(r.doc_id, r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed_sha256) for r in found]
    assert sorted(ours, key=str) == sorted(plain, key=str)
    texts_left = periodic.collapsed(clashing(spark, texts)).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in texts_left) == sorted(p[3] for p in plain)


@pytest.mark.parametrize("tile", [16, 512])
def test_fragments_of_small_tiles_are_joined(texts, tile, monkeypatch):
    """The solver alone: tiles of a document cut anywhere give the same runs."""
    monkeypatch.setattr(periodic, "TILE", tile)
    monkeypatch.setattr(periodic, "PERIODS", 1)
    for t in texts:
        (codes,), whole = periodic.word_codes([(t or "").encode()])
        fragments = defaultdict(list)
        for low, _, places in periodic.boundaries([codes], whole):
            for start, words, marks in periodic.tiles(codes, low, places):
                for q, a, z in periodic.solve(words, marks, low, start == 0, start + len(words) == len(codes)):
                    fragments[q].append((start + a, start + z))
        runs = []
        for q, parts in fragments.items():
            joined = []
            for a, z in sorted(parts):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], z)
                else:
                    joined.append([a, z])
            runs += [(a, q, z - a + q) for a, z in joined if z - a >= max(q, 12 - q)]
        assert sorted(runs) == plain_runs((t or "").split())


def test_a_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "a " * 120_000), (2, "b c " * 3)], "doc_id bigint, text string")
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}
    assert found == {1: [(0, 1, 120_000)], 2: []}
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 1, 2, 3, 7, 40, 300] * 20)] + [(None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.text): r.new for r in docs.withColumn("new", periodic.planted(F.col("doc_id"), F.col("text"))).collect()}
    changed = 0
    for i, t in rows:
        if i is None or t is None:
            assert found[i, t] == t
            continue
        h, words = zlib.crc32(str(i).encode()), t.split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
            changed += 1
        assert found[i, t].split() == words
    assert changed


def whole_ids(text):
    t = tokenizers.Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [
    None, "", " ", "Hello  WORLD\n don't we'll 'tis", "<|endoftext|> x<|startoftext|>y <|endoftext|>", "a\x1cb\x85c\xa0d e　f", "é ́x Å ΑΣ ΟΔΟΣ.",
    "﻿zero​width \U0001f600\U0001f601", "x" * 9000, "word " * 2047, "word " * 2048, "word " * 5000, "1234567890 3.14 #!?", "İstanbul ﬁ ǅ ß",
    "Letters!!! and-marks x... don't. we'll, a<|endoftext|> <|endoftext|>. A.b c_d `q` [z] {~} K\\ ok'", "z" * 70 + "!",
    " ".join(f"x{chr(c)}Y {chr(c)}{chr(c)}, E{chr(c)}\u0301" for c in range(0xA1, 0x180)),
]


def test_ids_between_white_space_are_those_of_the_whole_text():
    encoder = packing.Encoder(PATH)
    for texts in (TEXTS, TEXTS[:4], [TEXTS[3]] * 2 + TEXTS[::-1]):
        found = list(encoder.ids([(t or "").encode() for t in texts]))
        assert [np.frombuffer(ids + packing.END.to_bytes(4, "little"), "<u4").tolist() for ids in found] == list(map(whole_ids, texts))


def check_packing(rows, wanted, capacity):
    """Every piece of every document once; sequences gapless from 0 and within the capacity."""
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(wanted)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_every_piece_lies_in_one_sequence(spark):
    rows = [(None if k % 5 == 1 else k % 9, t, 1, 2, 3) for k, t in enumerate(TEXTS * 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, task int, number int, first int").repartition(5)
    wanted = []
    for i, t, *_ in rows:
        ids = whole_ids(t)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            wanted.append((i, piece, at, len(own), zlib.crc32(own.tobytes())))
    used = check_packing(packing.packed(docs, PATH).collect(), wanted, 2048)
    assert used <= -(-sum(w[3] for w in wanted) // 2048) + 6
    assert packing.packed(docs.filter("false"), PATH).count() == 0


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= s]
        if fitting:
            gaps[gaps.index(min(fitting))] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_number_once_and_needs_few_sequences(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 300])
    sizes = [rng.randint(1, rng.choice([capacity, capacity // 2, 4])) for _ in range(rng.choice([1, 30, 400]))]
    plan = packing.pack(Counter(sizes), capacity)
    bins, numbers = defaultdict(list), defaultdict(list)
    for size, low, high, base, offset, per in plan.rows:
        for number in range(low, high):
            numbers[size].append(number)
            bins[base + (number - low) // per].append((offset + (number - low) % per * size, size))
    assert {s: sorted(n) for s, n in numbers.items()} == {s: list(range(c)) for s, c in Counter(sizes).items()}
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * size > capacity for _, size in parts) <= 2
    assert len(bins) == plan.sequences <= best_fit(sizes, capacity) + 1


def plain_negatives(vectors):
    rows = [(k, i, y, [int(np.floor(256.0 * x)) for x in v]) for k, (i, v, y) in enumerate(vectors) if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, i, y, v in rows:
        if i % 100:
            continue
        scored = sorted(((-dot(v, w), j, m, z) for m, j, z, w in rows if m != k))
        for s, j, m, _ in [x for x in scored if x[3] == y][:5]:
            p = -s
            near = [x for x in scored if x[3] != y and 80 * p <= 100 * -x[0] <= 100 * p][:5]
            out += [(i, j, r + 1, x[1], p, -x[0]) for r, x in enumerate(near)]
    return out


@pytest.mark.parametrize("sizes", [(65_536, 1_024, 4_096), (40, 8, 7)])
def test_negatives_are_those_of_every_product(spark, sizes, monkeypatch):
    for name, value in zip(("SHARD_ROWS", "LEAST_ROWS", "BLOCK"), sizes):
        monkeypatch.setattr(bond, name, value)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(4, 20))
    vectors = []
    for i in range(420):
        v = (centers[i % 4] * (0.5 if i % 3 else 0.1) + rng.normal(size=20) * 0.3).astype("float32").tolist()
        vectors.append((i * 4, v[: 18 if i % 50 == 7 else 20], i % 5 % 3))
    vectors += [(i, vectors[8][1], i % 3) for i in range(1, 60, 2)]  # ties
    vectors += [(100, vectors[3][1], 1), (100, vectors[25][1], 1), (100, vectors[25][1], 1)]  # ids that are not unique
    vectors += [(None, vectors[0][1], 1), (2, None, 1), (6, vectors[0][1], None), (10, [None] * 20, 1), (14, [float("nan")] * 20, 1), (18, [float("inf")] * 20, 1), (200, [0.0] * 20, 0), (300, [], 1)]
    rows = [(i, v, y, 7, 8) for i, v, y in vectors]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, row int, shard int").repartition(6)
    found = bond.hard_negatives(bond.quantized(df)).collect()
    assert sorted(map(tuple, found)) == sorted(plain_negatives(vectors))
    assert bond.hard_negatives(bond.quantized(df.filter("false"))).count() == 0


def test_bitmaps_drop_most_candidates():
    """The bounds are worth their name: few candidates of a clustered block are read to the last dimension."""
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(4000, 64)) * 20).astype(np.int64)
    vectors[:40] += 60
    block = bond.Block(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), vectors)
    windows = np.array([[bond.NONE + 1, -(bond.NONE + 1)]])
    alive, scores = bond.scan_block(block, vectors[0], np.ones(4000, bool), windows, np.array([bond.NONE]), 5)
    exact = vectors @ vectors[0]
    assert set(np.argsort(-exact)[:5]) <= set(alive.tolist()) and len(alive) < 400
    assert (exact[alive] == scores).all()
