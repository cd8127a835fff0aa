"""Hard negatives by a vertical scan of vectors, dimension by dimension, with shrinking candidate bitmaps.

Rows are dealt into shards of bounded size, held dimension by dimension in blocks. For an anchor the
dimensions are read in descending order of the anchor's own components. After a few of them every
candidate has a partial product, and the rest can add no less and no more than the anchor's remaining
components times the block's least or greatest values there. Candidates that can no longer be among
the wanted ones leave the bitmap; those that stay to the end have their exact product.

Two scans are made. The first finds each anchor's positives, the best rows of its label. The second
finds, for every positive, the best rows of other labels within a window of scores below it; a bitmap is
kept for each window. Anchors are a stated query set: every shard meets all of them, in batches, and
gives its best rows only, at most ``best`` for an anchor or window, which are then ranked over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.llm.base import store
from pulseframe.session import settle

#: Rows of a shard, about, and of the blocks that bounds are taken over.
SHARD_ROWS, LEAST_ROWS, BLOCK = 65_536, 1_024, 4_096
#: Dimensions read between two cuts of the bitmap.
DIMENSIONS = 8
NONE = np.iinfo(np.int64).min


class Block:
    """Some rows of a shard: their ids, labels and, dimension by dimension, their components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels = rows, ids, labels
        self.columns = np.ascontiguousarray(vectors.T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the dimensions, least and most that those from each place of the order on can add)."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack((anchor * self.least, anchor * self.most))[:, order]
        low, high = np.zeros((2, len(order) + 1), np.int64)
        low[:-1], high[:-1] = (np.cumsum(e[::-1])[::-1] for e in (ends.min(axis=0), ends.max(axis=0)))
        return order, low, high


def kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest, or the least number if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else NONE


def scan_block(block: Block, anchor: np.ndarray, candidates: np.ndarray, windows: np.ndarray, floors: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate rows that stay, their exact products).

    ``windows`` has the least and the greatest score of each window, ``floors`` the score of the ``best``-th
    row already known in it. A candidate goes when no window can have it among its best.
    """
    order, low, high = block.bounds(anchor)
    alive, partial = np.flatnonzero(candidates), np.zeros(int(candidates.sum()), np.int64)
    floors = floors.copy()
    for at in range(0, len(order), DIMENSIONS):
        if not len(alive):
            break
        dims = order[at : at + DIMENSIONS]
        whole = len(alive) == len(block.ids)
        partial = partial + anchor[dims] @ (block.columns[dims] if whole else block.columns[dims[:, None], alive])
        upto = min(at + DIMENSIONS, len(order))
        least, most = partial + low[upto], partial + high[upto]
        bitmap = np.zeros(len(alive), bool)
        for w, (bottom, top) in enumerate(windows.tolist()):
            sure = least[(least >= bottom) & (most <= top)]
            floors[w] = max(floors[w], kth(sure, best))
            bitmap |= (most >= max(bottom, int(floors[w]))) & (least <= top)
        if not bitmap.all():
            alive, partial = alive[bitmap], partial[bitmap]
    return alive, partial


def ranked(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: int) -> np.ndarray:
    """Places of the best: higher scores first, then smaller ids, then smaller row numbers."""
    if len(scores) > 4 * best:
        near = np.flatnonzero(scores >= kth(scores, best))
        return near[np.lexsort((rows[near], ids[near], -scores[near]))[:best]]
    return np.lexsort((rows, ids, -scores))[:best]


def scan_shard(blocks: list[Block], row: int, label: int, anchor: np.ndarray, windows: np.ndarray, same: bool, best: int) -> list[tuple[int, int, int, int]]:
    """(window, row, id, score) of the best rows of each window, among those of the anchor's label or of the others."""
    held = [(np.zeros(0, np.int64),) * 3 for _ in windows]
    floors = np.full(len(windows), NONE, np.int64)
    for block in blocks:
        candidates = (block.labels == label) == same
        candidates &= block.rows != row
        alive, scores = scan_block(block, anchor, candidates, windows, floors, best)
        for w, (bottom, top) in enumerate(windows.tolist()):
            inside = np.flatnonzero((scores >= bottom) & (scores <= top))
            if len(inside):
                more = scores[inside], block.ids[alive[inside]], block.rows[alive[inside]]
                joined = tuple(np.concatenate(x) for x in zip(held[w], more))
                keep = ranked(*joined, best)
                held[w] = tuple(x[keep] for x in joined)
                floors[w] = max(floors[w], kth(held[w][0], best))
    return [(w, int(r), int(i), int(s)) for w, (scores, ids, rows) in enumerate(held) for s, i, r in zip(scores, ids, rows)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of ``width`` numbers, shorter ones filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    lengths = np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def scan_shards(rows: DataFrame, anchors: DataFrame, shards: int, width: int, same: bool, best: int) -> DataFrame:
    """(anchor, window, row, id, score): the best of every shard for every anchor (row, vec_id, label, vector, lows, highs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, blocks = None, [], []
        for batch in batches:  # sorted by shard, the rows of a shard before the anchors
            table = pa.Table.from_batches([batch])
            numbers, kinds = table.column("shard").to_numpy(), table.column("is_anchor").to_numpy().astype(bool)
            for number in np.unique(numbers).tolist():
                if number != shard:
                    shard, parts, blocks = number, [], []
                own = numbers == number
                plain = table.filter(pa.array(own & ~kinds))
                if plain.num_rows:
                    parts.append((*(plain.column(c).to_numpy() for c in ("row", "vec_id", "label")), matrix(plain.column("vector").combine_chunks(), width)))
                asked = table.filter(pa.array(own & kinds))
                if not asked.num_rows:
                    continue
                if parts:
                    whole = [np.concatenate(x) for x in zip(*parts)]
                    order = np.argsort(whole[2], kind="stable")  # rows of one label lie together
                    blocks = [Block(*(x[order[at : at + BLOCK]] for x in whole)) for at in range(0, len(order), BLOCK)]
                    parts = []
                found = []
                vectors = matrix(asked.column("vector").combine_chunks(), width)
                for i, (row, label, lows, highs) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("row", "label", "lows", "highs")))):
                    windows = np.array([lows, highs], np.int64).T
                    found += [(row, *f) for f in scan_shard(blocks, row, label, vectors[i], windows, same, best)]
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["anchor", "window", "row", "id", "score"])

    none = F.lit(None).cast("array<bigint>")
    columns = ["row", "vec_id", "label", "vector"]
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(False).alias("is_anchor"), *columns, none.alias("lows"), none.alias("highs"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.lit(True).alias("is_anchor"), *columns, "lows", "highs")
    dealt = held.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "is_anchor")
    return dealt.mapInArrow(run, "anchor bigint, window bigint, row bigint, id bigint, score bigint")


def top(found: DataFrame, keys: list[str], best: int) -> DataFrame:
    """The best rows of each key over all shards, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def quantized(vectors: DataFrame, label: str = "label", scale: int = 256) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part: components become floor(scale * x).

    Rows without an id, a label or a vector, and rows with a null or non-finite component take no part.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & F.col("embedding").isNotNull() & finite)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), vector.alias("vector"))


def hard_negatives(rows: DataFrame, every: int = 100, best: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``quantized`` rows.

    Anchors are the rows whose id ``every`` divides. Their positives are the ``best`` other rows of their
    label, and every positive has up to ``best`` negatives, rows of other labels with a score between
    ``share`` of the positive's and the positive's. Higher scores come first, then smaller ids. Rows of
    one id are rows of their own; a shorter vector counts as filled with zeros. A positive with a negative
    score has no window. Scores must fit a long. Other columns are not read. Empty in, empty out.
    """
    rows = store(rows, "vectors")
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-count // SHARD_ROWS), min(spread, -(-count // LEAST_ROWS)))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    longs = lambda value: F.array(F.lit(value).cast("bigint"))
    asked = anchors.withColumns({"lows": longs(NONE + 1), "highs": longs(-(NONE + 1))})
    positives = top(scan_shards(rows, asked, shards, width, True, best), ["anchor"], best)
    positives = settle(positives.select("anchor", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    part, whole = share
    score = F.col("positive_score")
    least = F.expr(f"(positive_score * {part} - pmod(positive_score * {part}, {whole})) DIV {whole} + least(pmod(positive_score * {part}, {whole}), 1)")
    bounds = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", least.alias("low"), score.alias("high")))).alias("bounds"))
    sought = anchors.join(bounds, anchors["row"] == bounds["anchor"]).select(*anchors.columns, F.col("bounds.low").alias("lows"), F.col("bounds.high").alias("highs"))
    found = top(scan_shards(rows, settle(sought), shards, width, False, best), ["anchor", "window"], best)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = found.join(positives, ["anchor", "window"]).join(named, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
