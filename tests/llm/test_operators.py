"""The text operators against plain versions, on rows with nulls, repeats, ties, clashing names and nothing at all."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pulseframe.llm import archive, decontaminate, mincut, mixture, paragraph_sketch, quality_fm, simhash, suffix_dedup, toxicity, url_cascade
from pulseframe.llm.base import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, copy int, path string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potent magic soup for hungry giants near old mills"


def line(seed: int, count: int) -> str:
    words = WORDS.split()
    return " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] + str((seed * 31 + i * 17) % 97) for i in range(count))


SHARED = line(5, 120)
ROWS = [
    (1, line(1, 200)), (2, line(1, 200)), (2, line(1, 200)), (3, None), (4, ""), (5, "é ß\n" + line(2, 90) + SHARED + line(3, 60)), (6, SHARED + "\n" + line(4, 50)),
    (None, line(6, 30)), (8, "x"), (9, line(7, 40) + " " + line(7, 40)), (10, "ab" * 700), (11, line(8, 3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), 0.5, 1, "p") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def plain_repeats(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone.update(range(i, i + size))
        kept = bytes(b for i, b in enumerate(t) if i not in gone)
        out.append((len(t), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [1, 2, 1000])
def test_repeats_are_those_of_a_plain_search(docs, crowded):
    found = sorted(map(tuple, suffix_dedup.repeats(docs, crowded=crowded).collect()), key=str)
    plain = plain_repeats([(t or "").encode() for _, t in ROWS], 400)
    assert found == sorted(((i, *p) for (i, _), p in zip(ROWS, plain)), key=str)


def test_suffix_order():
    strings = [s.encode() for s in (SHARED, SHARED[:90], SHARED[:90] + "zz", "b", "", SHARED, "b\0", line(9, 30))]
    order, shared = suffix_dedup.ordered(strings, 1200)
    assert [strings[i] for i in order] == sorted(strings)
    for at in range(1, len(order)):
        assert shared[at] == suffix_dedup.common(strings[order[at - 1]], strings[order[at]])


def test_texts_without_repeats_keep_their_columns(docs, empty):
    short = suffix_dedup.without_repeats(docs)
    assert short.columns == docs.columns and short.count() == len(ROWS)
    assert short.filter("doc_id = 3 AND text IS NULL").count() == 1
    assert short.filter("n_chars <> char_length(text)").count() == 0
    assert suffix_dedup.repeats(empty).count() == 0


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash_of_whole_texts(docs, empty):
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id").collect()
    assert sorted((str(i), f) for i, f, _ in found) == sorted((str(i), f"{plain_simhash(t):016x}") for i, t in ROWS)
    assert {i: c for i, _, c in found if i in (1, 2, 3, 4, None)} == {1: 1, 2: 1, 3: 3, 4: 3, None: None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    assert kept == sorted(map(str, [1, 3, 5, 6, None, 8, 9, 10, 11]))


@pytest.mark.parametrize("crowded", [1, 256])
def test_links_find_every_pair_within_two_bits(spark, crowded):
    base = [0, -1, 0x0123456789ABCDEF, 0x7FFFFFFFFFFFFFFF]
    values = sorted({v ^ sum(1 << b for b in bits) if v >= 0 else v for v in base for bits in [(), (0,), (0, 1), (5, 40), (5, 40, 41), (62, 3), (7,), (7, 8, 9, 10)]})
    classes = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "fp bigint, node bigint")
    near = [(a, b) for a in range(len(values)) for b in range(a) if ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= 2]
    plain = {n: n for n in range(len(values))}
    for _ in values:
        for a, b in near:
            plain[a] = plain[b] = min(plain[a], plain[b])
    found = {r.node: r.label for r in components(simhash.links(classes, crowded)).collect()}
    assert {n: found.get(n, n) for n in plain} == plain


def test_contaminated_words(spark, docs, empty):
    inside = line(1, 200).replace(" ", " - ")
    items = [(1, " ".join(line(1, 200).split()[20:50]).upper()), (2, "X"), (3, None), (4, "..."), (5, line(1, 200)[:400]), (10, inside)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {(i, tuple(w[s : s + 13])) for i, t in items if (w := cut(t)) for s in range(max(1, len(w) - 12))}
    plain = []
    for i, t in ROWS:
        w, hit, named = cut(t), set(), set()
        for s in range(len(w)):
            for n, said in windows:
                if tuple(w[s : s + len(said)]) == said:
                    hit.update(range(s, s + len(said)))
                    named.add(str(n))
        plain.append((str(i), len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    found = decontaminate.judged(decontaminate.overlap(docs, bench)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in found) == sorted(plain)
    assert decontaminate.judged(decontaminate.overlap(docs, bench.filter("false"))).filter("n_hit > 0").count() == 0
    assert decontaminate.overlap(empty, bench).count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {str(r.doc_id) for r in kept.collect()} == {p[0] for p in plain if not p[4]}


def test_archive_round_trip(spark):
    rows = [(1, "http://a/\r\nX: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "v", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    written = archive.write_archive(pages)
    records = archive.read_records(spark, written)
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in archive.parse_records(records).collect()}
    assert {f[:4] for f in found} == {(1, "revisit", 2, 9), (2, "response", None, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 6)}
    import base64

    assert {f[4] for f in found if f[0] == 5} == {base64.b32encode(hashlib.sha1(b"a\r\n\r\nb").digest()).decode()}
    assert spark.read.parquet(written.payloads).count() == 3 and records.count() == 6
    assert archive.read_records(spark, archive.write_archive(pages.filter("false"))).count() == 0


def test_url_rules(spark):
    urls = [None, "x", "http://EXAMPLE.org", "http://example.org/es/1", "ftp://a.example.org/en/12?x", "http://badexample.org/es/", "http://a.com/de/?q", "http://a.com#/de/", "http://a.net/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("old"))
    rules = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, None, "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages, table).collect()}
    assert found[0] == found[1] == ("", "", "", "allow") and found[2] == ("example.org", "", None, "allow")
    assert found[3] == ("example.org", "/es/1", "example.org/es/", "block") and found[4][2:] == ("example.org/en/1", "block")
    assert found[5][2:] == ("org/", "allow") and found[6][2:] == ("com/de/", "block") and found[7] == ("a.com", "", None, "allow") and found[8][2:] == (None, "allow")
    assert url_cascade.judge_urls(pages, table.filter("false")).filter("verdict = 'block'").count() == 0
    assert url_cascade.judge_urls(pages.filter("false"), table).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("cast(key as bigint) % 17 = 0")
    filters = url_cascade.cascade(listed, universe)
    wrong = universe.filter(url_cascade.listed(filters, F.col("key")) != (F.col("key").cast("bigint") % 17 == 0))
    assert len(filters) > 1 and wrong.count() == 0


def test_mixture(docs, empty):
    rates = mixture.repetition(docs).collect()
    assert {r.doc_id: r.size for r in rates}[3] == 0 and len(rates) == len(ROWS)
    assert all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size for r in rates)
    targets = {(r.source_size, r.target) for r in rates}
    assert abs(sum(t for _, t in targets) - sum(s for s, _ in targets)) < 1e-6 or any(t == 3 * s for s, t in targets)
    mixed = mixture.mix(docs)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in Counter(x for r in rates for x in [r.doc_id] * r.copies).items()})
    assert mixture.repetition(empty).count() == 0 and mixture.mix(empty).count() == 0


def paragraphs(text):
    found = set()
    for one in re.split(r"[\n\r]+", text):
        while one:
            end = next((m.end() for m in re.finditer(r"[.!?](?=[ \t])", one) if m.start() >= paragraph_sketch.LEAST), len(one))
            found.add(one[:end].strip(" "))
            one = one[end:]
    return found - {""}


def digest(paragraph):
    found = xxhash.xxh64_intdigest(paragraph.encode(), 42)
    return found - (found >> 63 << 64)


def plain_peel(one, two):
    """The digests by which two written fingerprints of one shape differ, as far as peeling gets, and whether that is all."""
    read = lambda c: (int(c.split(":")[0]), *(int(x, 16) for x in c.split(":")[1:])) if c else (0, 0, 0)
    a, b = ([read(c) for c in text.split("/")[2].split(",")] for text in (one, two))
    cells = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(a, b, strict=True)]
    check = lambda d: xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)) & 0xFFFFFFFF
    bits, width, found = int(one.split("/")[1]), paragraph_sketch.WIDTH, {}
    while lone := next((c for c in cells if abs(c[0]) == 1 and c[2] == check(c[1])), None):
        count, key, sign = lone
        found[key - (key >> 63 << 64)] = count
        for table in range(3):
            c = cells[(key >> 64 - bits if bits else 0) * 3 * width + table * width + (key >> table * (width.bit_length() - 1)) % width]
            c[0], c[1], c[2] = c[0] - count, c[1] ^ key, c[2] ^ sign
    return found, all(c == [0, 0, 0] for c in cells)


@pytest.mark.parametrize("range_chars", [1, 3000, paragraph_sketch.RANGE_CHARS])
def test_paragraph_sketches(docs, range_chars):
    one = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = sorted(((i, t or "") for i, t in dict(ROWS).items() if i is not None), reverse=True)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    found = {r.doc_id: r for r in paragraph_sketch.fingerprint_versions(one, range_chars).collect()}
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert found[i].near_edited == pytest.approx(alike(paragraphs(t), paragraphs(edited)))
        assert found[i].near_next == pytest.approx(alike(paragraphs(t), paragraphs(after)))
    assert found[1].fingerprint == found[2].fingerprint != found[5].fingerprint
    assert paragraph_sketch.fingerprint_versions(docs, range_chars).count() == len(ROWS)
    assert paragraph_sketch.fingerprint_versions(docs.filter("false")).count() == 0


def test_paragraph_sketches_give_back_what_differs(spark):
    """Long and short texts, also without id or of one id: every recovered digest is right, and written fingerprints subtract and peel."""
    texts = ["".join(f"{line(seed + k, 3)}{'. ' if k % 3 else chr(10)}" for k in range(seed * seed % 700)) for seed in range(40)]
    shared = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    place = lambda r: (r[0] is not None, r[0] or 0, ~digest(r[1]))
    rows = sorted(shared, key=place, reverse=True)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {(r.doc_id, r.edited_sha256): r for r in paragraph_sketch.fingerprint_versions(docs, 20_000).collect()}
    peeled = due = 0
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        row = found[i, hashlib.sha256(edited.encode()).hexdigest()]
        own, other = paragraphs(t), paragraphs(edited)
        gone, new = ({digest(p) for p in x} for x in (own - other, other - own))
        assert (set(row.gone), set(row.new)) == (gone, new) and len(row.gone) + len(row.new) == len(gone) + len(new)
        if row.fingerprint.split("/")[1] == row.edited_fingerprint.split("/")[1]:
            want = {**dict.fromkeys(gone, 1), **dict.fromkeys(new, -1)}
            got, whole = plain_peel(row.fingerprint, row.edited_fingerprint)
            assert got.items() <= want.items() and whole == (got == want)
            peeled, due = peeled + len(got), due + len(want)
    assert due > 100 and peeled > 0.8 * due  # the rest takes the larger tries


def test_a_word_put_in_changes_few_paragraphs(spark):
    sentences = [line(k, 8) + "." for k in range(300)]
    one, two = " ".join(sentences), " ".join(["word " + sentences[0], *sentences[1:]])
    sets = spark.createDataFrame([(one, two)], "one string, two string").select(*(paragraph_sketch.fingerprint(paragraph_sketch.digests(F.col(c))).alias(c) for c in ("one", "two")))
    keys = sets.select(paragraph_sketch.difference(F.col("one"), F.col("two")).alias("d"), *(paragraph_sketch.written(F.col(c)).alias(f"w_{c}") for c in ("one", "two"))).first()
    gone, new = ({digest(p) for p in x} for x in (paragraphs(one) - paragraphs(two), paragraphs(two) - paragraphs(one)))
    want = {**dict.fromkeys(gone, 1), **dict.fromkeys(new, -1)}
    assert {k.key: k["count"] for k in keys.d} == want and (want, True) == plain_peel(keys.w_one, keys.w_two)
    assert 1 <= len(gone) <= 10 < len(paragraphs(one)) / 4


def test_main_text(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script><body><nav><a href=x>Home</a></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1>
    <p><b>First   one, with words.<br>More<p>Second one.</p><div class="comments"><p>I agree with all of this, said a reader.</p></div></article><footer>&copy; us</footer>"""
    rows = [(1, page), (2, None), (3, ""), (4, "a < b <x"), (1, page)]
    found = mincut.extract(spark.createDataFrame(rows, "page_id int, html string").withColumn("text", F.lit("old")))
    assert sorted((r.page_id, r.text) for r in found.collect()) == [(1, "A & B\nFirst one, with words. More\nSecond one.")] * 2 + [(2, ""), (3, ""), (4, "")]
    assert mincut.extract(found.filter("false")).count() == 0


def test_minimum_cut_costs_least():
    import itertools
    import random

    random.seed(4)
    for _ in range(40):
        n = random.randint(1, 7)
        odds = [random.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, random.uniform(0, 2)) for a in range(n) for b in range(a) if random.random() < 0.5]
        cost = lambda x: sum(max(0, -o) if s else max(0, o) for o, s in zip(odds, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        assert cost(mincut.minimum_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product((True, False), repeat=n))))


def test_pairwise_identity():
    import numpy as np

    random = np.random.default_rng(1)
    x, w, v = random.normal(size=(3, 9)), random.normal(size=9), random.normal(size=(9, 4))
    plain = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert np.allclose(quality_fm.Machine(0.3, w, v).raw(x[:, :5], x[:, 5:]), plain, atol=1e-4)


@pytest.mark.parametrize("operator", [quality_fm, toxicity])
def test_scores_without_labels_and_of_odd_rows(spark, docs, empty, operator):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = operator.fit(docs, none)
    scored = operator.score(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and {r.score for r in scored.collect()} == {0.5}
    assert operator.score(empty, model).count() == 0


@pytest.mark.parametrize("operator, label, at, least", [(quality_fm, "quality", 0.3, 0.97), (toxicity, "toxic", 0.5, 0.9)])
def test_held_out_accuracy(spark, operator, label, at, least):
    from pulseframe.llm.base import fold, table

    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scored = operator.score(docs, operator.fit(docs, labels)).join(labels, "doc_id").filter(fold() == 0)
    right, count = scored.agg(F.avg(((F.col("score") >= at).cast("int") == F.col(label)).cast("int")), F.count(F.lit(1))).first()
    assert count > 500 and right >= least


@pytest.mark.parametrize("crowded", [3, 1000])
@pytest.mark.parametrize("size", [200, 400])
def test_a_hot_passage_in_many_texts(spark, crowded, size):
    """One passage in most texts, whole or with a word changed, at other places and beside other words."""
    passage = line(5, 90)
    texts = []
    for k in range(60):
        words = passage.split()
        if k % 3 == 0:
            words[(k * 7) % 90] = f"other{k}"
        if k % 10 != 9:
            texts.append(line(40 + k % 50, 20) + " " * (k % 4) + " ".join(words[k % 5 :]) + line(200 + k, 30))
        else:
            texts.append(line(300 + k, 60))
    texts += [texts[0], texts[1], passage, passage]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = sorted(map(tuple, suffix_dedup.repeats(rows, size, crowded).collect()))
    assert found == [(i, *p) for i, p in enumerate(plain_repeats([t.encode() for t in texts], size))]
