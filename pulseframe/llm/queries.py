"""The checked queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm import archive, bond, decontaminate, mincut, mixture, packing, paragraph_sketch, periodic, quality_fm, simhash, suffix_dedup, toxicity, url_cascade
from pulseframe.llm.base import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: Host, path and verdict of the rules that the url query applies (fixed values).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = url_cascade.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_AFTER = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
SQL["op6_url_filter"] = f"""
WITH rules(rhost, rpath, kind) AS (VALUES {", ".join(map(str, RULES))}),
parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce({_AFTER}, ''), '^([^/?#]*)', 1), '{url_cascade.UPPER}', '{url_cascade.LOWER}') AS host,
           regexp_extract(coalesce({_AFTER}, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
fits AS (
    SELECT page_id, max_by(struct_pack(rule := rhost || rpath, kind := kind), length(rhost || rpath) * 100000 + length(rhost)) AS best
    FROM parts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)
    GROUP BY page_id
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.kind, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""


@query
def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixture.repetition(table(spark, sf_dir, "documents"))
    return rates.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL["op9_mixture"] = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, text ORDER BY source) AS number
    FROM documents
),
totals AS (
    SELECT source, sum(size)::HUGEINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight
    FROM sized GROUP BY source
),
summed AS (
    SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS whole,
           coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(weight) OVER before, 0) AS weight_before
    FROM totals
    WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
capped AS (
    SELECT *, bool_and((total - 3 * size_before) * weight > 3 * source_size * (whole - weight_before))
              OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS is_full
    FROM summed
),
targets AS (
    SELECT source, source_size::BIGINT AS source_size,
           CASE WHEN is_full THEN (3 * source_size)::DOUBLE
                ELSE ((total - 3 * coalesce(sum(source_size) FILTER (is_full) OVER (), 0)) * weight)::DOUBLE
                     / (whole - coalesce(sum(weight) FILTER (is_full) OVER (), 0))::DOUBLE END AS target
    FROM capped
),
rates AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, digest, number::VARCHAR, '17', 'mix')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates
"""


@query
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = archive.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    read = archive.parse_records(archive.read_records(spark, written))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc_archive"] = f"""
WITH bodies AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
),
named AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY sha256(payload)) AS response_id
    FROM bodies
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{archive.BASE32}',
           (((('0x' || substr(hex, 5 * (i // 4)::BIGINT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM named
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{url_cascade.UPPER}', '{url_cascade.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op7_decontaminate"] = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[s:s + least(13, len(words)) - 1], ' ') AS said
    FROM (SELECT *, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS s FROM item WHERE len(words) > 0)
),
runs AS (
    SELECT doc_id, s, size, array_to_string(words[s:s + size - 1], ' ') AS said
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM doc, (SELECT DISTINCT size FROM windows))
),
hits AS (SELECT doc_id, s, runs.size, item_id FROM runs JOIN windows USING (size, said)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS w FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    found = quality_fm.score(docs, machine)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mincut.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op10_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_sketch.fingerprint_versions(table(spark, sf_dir, "documents"))
    return found.withColumns({"gone": F.size("gone"), "new": F.size("new")}).withColumnsRenamed({"gone": "n_gone", "new": "n_new"})


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = periodic.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return bond.hard_negatives(bond.quantized(vectors))


SQL["op13_hard_negatives"] = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
