"""Quality scores by a factorisation machine.

A document is a sparse vector: hashed words, statistics of its structure, and metadata (its stated
length). The score is a logistic function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where the pairwise part costs linear time, as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 per factor.
The machine is fitted on the driver on a bounded sample of the labelled rows, whose features come from
the executors; scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.base import arrow_pass, bytes_of, fold, keeps_names
from pulseframe.llm.words import SPACE, Words
from pulseframe.operators.joins import attach

BUCKETS = 2048
FACTORS = 8
#: Labelled rows that the machine is fitted on, those whose ids hash lowest.
FIT_ROWS = 8000
#: Words as they are, case included.
AS_IS = bytes(SPACE if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Classes of bytes whose shares are statistics.
CLASSES = (
    lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b >= 128, lambda b: b in b"\r\n", lambda b: b in b" \t",
    lambda b: b in b".,;:", lambda b: b in b"!?", lambda b: b in b"|", lambda b: b in b"#$%&*@^~+=_", lambda b: b in b"<>{}[]()/\\", lambda b: b in b"'\"`-",
)
CLASS_OF = np.array([[test(b) for b in range(256)] for test in CLASSES])
STATS = 2 * len(CLASSES) + 9


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, words: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Values of the machine for word features and the other features, each a matrix with a row per text."""
        x = np.hstack([words, rest]).astype(np.float32)
        inner = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * (inner**2 - (x**2) @ (self.factors**2)).sum(axis=1)

    def score(self, words: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(words, rest).astype(np.float64), -30, 30)))


def describe(texts: list[bytes], stated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word features (bucket counts of length one) and the statistics of several texts."""
    found = Words(texts, AS_IS)
    hashes = found.hashes()
    n = len(texts)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(found.text * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    total = np.maximum(found.counts, 1)
    norm = np.maximum(np.sqrt((counts**2).sum(axis=1)), 1e-6)
    array = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    ends = np.concatenate(([0], np.cumsum(lengths)))
    shares = []
    for inside in CLASS_OF:
        run = np.concatenate(([0], np.cumsum(inside[array], dtype=np.int64)))
        shares.append((run[ends[1:]] - run[ends[:-1]]) / np.maximum(lengths, 1))
    shares = np.array(shares).T
    sizes = found.ends - found.starts
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (found.text[1:] == found.text[:-1])
    per_text = lambda values: np.bincount(found.text, weights=values, minlength=n) / total
    known = np.isfinite(stated)
    stats = np.column_stack([
        shares, np.sqrt(shares), per_text(sizes) / 10, per_text(sizes > 12), per_text(sizes <= 2), per_text(again), np.sqrt(per_text(again)),
        (counts > 0).sum(axis=1) / np.minimum(total, BUCKETS), counts.max(axis=1, initial=0) / total, np.log1p(found.counts) / 10,
        np.where(known, np.log1p(np.maximum(np.where(known, stated, 0), 0)) / 10, 0),
    ])
    return counts / norm[:, None], stats.astype(np.float32)


def stated_length(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_stated").to_numpy(zero_copy_only=False).astype(np.float64)


def with_length(docs: DataFrame) -> DataFrame:
    known = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.withColumn("_stated", known.cast("double"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled documents outside the held-out fold: those whose ids hash lowest.

    A document with several labels counts by their mean.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return attach(docs, chosen, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, seed: int = 7) -> Machine:
    """Fit on the bounded sample; without labels of both kinds every score is a half or their only kind's."""

    def describe_batch(batch: pa.RecordBatch):
        words, stats = describe(bytes_of(batch.column("text")), stated_length(batch))
        spots = [np.flatnonzero(row) for row in words]
        columns = [batch.column("doc_id"), batch.column("_label"), pa.array(spots, pa.list_(pa.int32())), pa.array([row[at] for row, at in zip(words, spots)], pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float32()))]
        return pa.record_batch(columns, ["doc_id", "_label", "spots", "values", "stats"])

    texts = with_length(sample(docs.select([c for c in ("doc_id", "text", "n_chars") if c in docs.columns]), labels, label, rows)).select("doc_id", "_label", "text", "_stated")
    found = arrow_pass(texts, describe_batch, "doc_id bigint, _label int, spots array<int>, values array<float>, stats array<float>", "text")
    once = found.groupBy("doc_id").agg(F.min(F.struct("_label", "spots", "values", "stats")).alias("row")).select("doc_id", "row.*")
    held = sorted(once.collect())  # at most ``rows`` rows of at most BUCKETS + STATS numbers
    x = np.zeros((len(held), BUCKETS + STATS), np.float32)
    y = np.zeros(len(held), np.float32)
    for i, (_, mark, spots, values, stats) in enumerate(held):
        x[i, spots] = values
        x[i, BUCKETS:] = stats
        y[i] = mark
    return learn(x, y, seed)


def learn(x: np.ndarray, y: np.ndarray, seed: int, rounds: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """Logistic loss by Adam over shuffled batches."""
    random = np.random.default_rng(seed)
    width = x.shape[1]
    if not len(y):
        return Machine(0.0, np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32))
    part = {"linear": np.zeros(width, np.float32), "factors": random.normal(0, 0.02, (width, FACTORS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in part.items()}, {k: np.zeros_like(v) for k, v in part.items()}, 0
    for turn in range(rounds):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            rows, truth = x[order[at : at + batch]], y[order[at : at + batch]]
            machine = Machine(float(part["bias"][0]), part["linear"], part["factors"])
            error = (1 / (1 + np.exp(-np.clip(machine.raw(rows[:, :0], rows), -30, 30))) - truth) / len(rows)
            inner = rows @ part["factors"]
            slope = {
                "bias": np.array([error.sum()], np.float32), "linear": rows.T @ error + decay * part["linear"],
                "factors": rows.T @ (error[:, None] * inner) - part["factors"] * ((rows**2).T @ error)[:, None] + decay * part["factors"],
            }
            step += 1
            pace = rate * (1 - turn / rounds)
            for k, g in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                part[k] = (part[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Machine(float(part["bias"][0]), part["linear"], part["factors"])


@keeps_names("_stated")
def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (null as empty) in column ``name``, replacing one of that name.

    Only text and n_chars enter (a missing or null n_chars is left out of the sum); repeated rows get
    equal scores; an empty table stays empty.
    """
    plain = with_length(docs.drop(name))
    columns = [c for c in plain.columns if c != "_stated"]

    def run(batch: pa.RecordBatch):
        words, stats = describe(bytes_of(batch.column("text")), stated_length(batch))
        return pa.record_batch([batch.column(c) for c in columns] + [pa.array(machine.score(words, stats), pa.float64())], [*columns, name])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in plain.dtypes if c != "_stated")
    return arrow_pass(plain, run, f"{kinds}, `{name}` double", "text")
