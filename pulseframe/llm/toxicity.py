"""Toxicity by compression distance with two trained zstandard dictionaries.

One dictionary is trained on ordinary text, one on what toxic documents say and ordinary ones do not:
their words that no ordinary document of the sample has and that recur in several different contexts
(copies share their contexts, so copied words do not count as recurring). Each window of words is
compressed twice, knowing ordinary text only and knowing toxic text too; the bytes saved are what the
toxic text explains. Counts and shares of windows that save at least 1, 2, ... bytes are calibrated to
a probability by a logistic fit, whose half is the threshold.

Dictionaries and calibration come from a bounded sample of the labelled rows; scoring is one pass over
all whole texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.llm.base import arrow_pass, bytes_of
from pulseframe.llm.quality_fm import sample
from pulseframe.llm.words import ALNUM
from pulseframe.session import settle

#: Words of a window.
WINDOW = 12
#: Labelled rows of the sample, and bytes of their distinct words, that dictionaries are trained on.
FIT_ROWS = 16000
FIT_BYTES = 32 << 20
#: Different contexts in which a word of toxic documents recurs, at least and as a share of the toxic
#: documents of the sample, and how many such words are kept at most.
CONTEXTS, CONTEXT_SHARE = 4, 0.01
TOXIC_WORDS = 4096
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
STEPS = 8


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the weights of the calibration (the last is the constant)."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


@lru_cache(maxsize=8)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    settings = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=15, search_log=4, target_length=32, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings) if known else zstandard.ZstdCompressor(compression_params=settings)


def windows(text: bytes) -> list[bytes]:
    words = text.translate(ALNUM).split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b""]


def saved(text: bytes, model: Model) -> np.ndarray:
    """Bytes that knowing toxic text saves, for every window."""
    plain, knowing = compressor(model.ordinary).compress, compressor(model.toxic + model.ordinary).compress
    return np.array([len(plain(w)) - len(knowing(w)) for w in windows(text)])


def features(gains: np.ndarray) -> list[float]:
    top = np.sort(gains)[::-1]
    steps = [f for q in range(1, STEPS + 1) for f in (float(np.sqrt((gains >= q).mean())), float(np.log1p((gains >= q).sum())))]
    return [*steps, float(np.log(len(gains))), *(float(max(0, top[:n].mean())) for n in (1, 2, 4)), float(gains.mean())]


def word_sets(sampled: DataFrame) -> DataFrame:
    """(label, word, context) of every word of the sampled texts, without repeats within a text."""

    def listed(batch: pa.RecordBatch):
        rows = set()
        for text, label in zip(bytes_of(batch.column("text")), batch.column("_label").to_pylist()):
            words = text.translate(ALNUM).split()
            rows.update((label, w, hash_pair(a, b) if label else 0) for a, w, b in zip([b""] + words, words, words[1:] + [b""]))
        labels, words, contexts = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(labels, pa.int32()), pa.array(words, pa.binary()), pa.array(contexts, pa.int64())], ["label", "word", "context"])

    return arrow_pass(sampled.select("_label", "text"), listed, "label int, word binary, context bigint", "text")


def hash_pair(a: bytes, b: bytes) -> int:
    """The same in every process, which ``hash`` is not."""
    import xxhash

    return xxhash.xxh64_intdigest(a + b" " + b) >> 1


def train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=48 if size < ORDINARY_BYTES else 32, d=6 if size < ORDINARY_BYTES else 8, level=4).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Train and calibrate on the bounded sample. Without labels of both kinds all documents score alike."""
    sampled = settle(sample(docs.select("doc_id", "text"), labels, label, rows).select("doc_id", "_label", "text"))
    said = word_sets(sampled).groupBy("word").agg(F.count_if(F.col("label") == 0).alias("ordinary"), F.countDistinct(F.when(F.col("label") == 1, F.col("context"))).alias("contexts"))
    least = max(CONTEXTS, int(CONTEXT_SHARE * sampled.filter("_label = 1").count()))
    recurring = said.filter((F.col("ordinary") == 0) & (F.col("contexts") >= least)).orderBy(F.desc("contexts"), "word").limit(TOXIC_WORDS)
    toxic_words = {bytes(r[0]) for r in recurring.select("word").collect()}

    def sets(batch: pa.RecordBatch):
        lists = []
        for text, mark in zip(bytes_of(batch.column("text")), batch.column("_label").to_pylist()):
            words = set(text.translate(ALNUM).split())
            lists.append(b" " + b" ".join(sorted(words & toxic_words if mark else words)) + b" ")
        return pa.record_batch([batch.column("doc_id"), batch.column("_label"), pa.array(lists, pa.binary())], ["doc_id", "label", "words"])

    listed = arrow_pass(sampled, sets, "doc_id bigint, label int, words binary", "text")
    # At most ``rows`` rows are summed up here, so that what comes to the driver has a bound in bytes too.
    upto = F.sum(F.octet_length("words")).over(Window.orderBy(F.xxhash64("doc_id"), "words").rowsBetween(Window.unboundedPreceding, 0))
    held = [(r[0], bytes(r[1])) for r in listed.withColumn("upto", upto).filter(F.col("upto") <= FIT_BYTES).orderBy(F.xxhash64("doc_id"), "words").select("label", "words").collect()]
    ordinary, toxic = [w for mark, w in held if not mark and len(w) > 2], [w for mark, w in held if mark and len(w) > 2]
    model = Model(train(ordinary, ORDINARY_BYTES), train(toxic, TOXIC_BYTES))

    def measure(batch: pa.RecordBatch):
        found = [features(saved(text, model)) for text in bytes_of(batch.column("text"))]
        return pa.record_batch([batch.column("doc_id"), batch.column("_label"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "found"])

    measured = sorted((r.doc_id, r.label, r.found) for r in arrow_pass(sampled, measure, "doc_id bigint, label int, found array<double>", "text").collect())
    return calibrate(model, np.array([r[2] for r in measured]), np.array([r[1] for r in measured], float))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> Model:
    """Logistic regression by Newton steps."""
    if not len(y):
        return model
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.column_stack([(x - centre) / spread, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), slope)
    return Model(model.ordinary, model.toxic, tuple(centre), tuple(spread), tuple(w))


def probability(text: bytes, model: Model) -> float:
    if not model.weights:
        return 0.5
    x = (np.array(features(saved(text, model))) - model.centre) / model.spread
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30))))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every whole text (null as empty) in column ``name``, replacing one of that name.

    Only the text enters. Repeated rows get equal scores, texts without words that of an empty window,
    an empty table stays empty; without any labels every score is a half.
    """
    plain = docs.drop(name)

    def run(batch: pa.RecordBatch):
        found = [probability(text, model) for text in bytes_of(batch.column("text"))]
        return pa.record_batch([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in plain.dtypes)
    return arrow_pass(plain, run, f"{kinds}, `{name}` double", "text")
