"""Mixing sources to target weights by repetition rates.

Tokens are summed per source; a source's rate is its target over its size, and every document is
emitted floor(rate) times plus one copy more with the probability of the remaining fraction. The draw
is a hash of the document's id and text, the number of its repeat and the seed, so reruns and retried
tasks emit the same copies, and documents without an id or of one id have draws of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.keyed import uniform
from pulseframe.llm.base import keeps_names, store
from pulseframe.operators.joins import attach
from pulseframe.operators.ordered import numbered
from pulseframe.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def exact(value: Column) -> Column:
    return value.cast("decimal(20,0)").cast("decimal(38,0)")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(key, source_size, target) of every source of ``sizes`` (key, source, size).

    Sources by code point, null last, weigh as ``cycle`` repeats. Together they share all tokens; a
    target stops at ``most`` times its source's size and the excess is shared anew by weight among
    the others until none is above. Only sums travel to the driver, one row a round.
    """
    totals = settle(sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    ranked = numbered(totals.withColumn("last", F.col("source").isNull()), ["last", "source"], name="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
    ranked = settle(ranked.withColumn("weight", weight.cast("bigint")))
    sums = [F.coalesce(F.sum(F.when(~F.col("full"), F.col(c))), F.lit(0)) for c in ("source_size", "weight")]
    total, heavy = ranked.withColumn("full", F.lit(False)).agg(*sums).first()
    share, full, known = total, F.lit(False), 0
    while heavy:
        above = exact(F.lit(share)) * F.col("weight") > exact(F.col("source_size")) * F.lit(most) * exact(F.lit(heavy))
        reached = full | above
        held, count, left = ranked.withColumn("full", reached).agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))), F.lit(0)), F.count_if("full"), sums[1]
        ).first()
        if count == known:
            break
        full, known, share, heavy = reached, count, total - most * held, left
    even = (F.lit(share) * F.col("weight")).cast("double") / F.lit(float(heavy or 1))
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(even)
    return ranked.select("key", "source_size", target.alias("target"))


def drawn(docs: DataFrame, seed: int, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``_draw`` between 0 and 1, of each row's own.

    Rows of one id and text are numbered, in the order of their other columns; those that are equal in all
    columns in any order. There may be many of them, so they are numbered over sorted ranges; rows that
    have no equal are not moved.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    marked = docs.withColumns({"_same": F.xxhash64(F.col(doc_id).cast("string"), F.col(doc_id).isNull(), digest), "_digest": digest})
    draw = lambda number: uniform([F.col(doc_id), F.col("_digest"), number], seed, "mix")
    repeated = settle(marked.groupBy("_same").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("_same"))
    if not repeated.head(1):
        return marked.withColumn("_draw", draw(F.lit(1))).drop("_same", "_digest")
    single = attach(marked, repeated, "_same", how="left_anti").withColumn("_draw", draw(F.lit(1)))
    several = attach(marked, repeated, "_same", how="left_semi")
    several = several.withColumns({"_order": F.xxhash64(*docs.columns), "_row": F.monotonically_increasing_id()})
    several = numbered(several, ["_order", "_row"], name="_number", keys=["_same"]).withColumn("_draw", draw(F.col("_number")))
    return single.union(several.select(*single.columns)).drop("_same", "_digest")


def repetition(docs: DataFrame, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id", **shares) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every document; copies is at most the cap of the targets.

    A null or empty text has size 0; a source without words has target 0 and its documents no copies.
    Documents of one id, repeated ones too, and documents without an id have draws of their own, so their
    source comes near its target as any other. Other columns are not read.
    """
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key"), F.col(source).alias("source"))
    sized = store(drawn(own, seed, "doc_id", "text").select("doc_id", "key", "source", words(F.col("text")).alias("size"), "_draw"), "sizes")
    joined = attach(sized, source_targets(sized, **shares), "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = F.col("_draw") < rate - F.floor(rate)
    return joined.select("doc_id", "size", "source_size", "target", (F.floor(rate) + more.cast("int")).cast("int").alias("copies"))


@keeps_names("_key", "_rate", "_draw", "_same", "_digest", "_order", "_row", "_number", "_range", "__number")
def mix(docs: DataFrame, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` and ``copy`` (1, 2, ...), a row for every copy of a document.

    Rates come from ``source_targets`` and are joined on the source; every document is repeated where it lies.
    """
    docs = docs.drop("copy")
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    sizes = docs.select(key.alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    rates = source_targets(sizes, **shares).select(F.col("key").alias("_key"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"))
    joined = attach(drawn(docs, seed, doc_id, text).withColumn("_key", key), rates, "_key")
    more = F.col("_draw") < F.col("_rate") - F.floor("_rate")
    copies = (F.floor("_rate") + more.cast("int")).cast("int")
    return joined.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).drop("_key", "_rate", "_draw")
