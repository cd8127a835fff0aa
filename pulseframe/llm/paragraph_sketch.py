"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is the set of the digests of its paragraphs: lines, cut where the first sentence ends after ``LEAST``
characters. Paragraphs end at line and sentence ends only, so a word put in changes the paragraph it is in and
some after it at most, until both versions end one at the same sentence. The digests are dealt by their first
bits into parts of ``PART`` digests at most on average, and each part is a sketch: three tables of cells; a
digest goes to one cell of each, where a count, the digests' exclusive or and that of their checks are kept.
All cells of all parts are the fingerprint. Two fingerprints of one shape subtract cell by cell, what both
texts have vanishes, and peeling recovers the rest: a cell that holds one digest gives it away, it is taken
out of its other cells, and so on. If cells remain, the sketch of that part was too small for the difference
and a larger one of it is tried, with other bits choosing the cells. Of two texts of different shapes the
smaller one is sketched anew in the larger shape.

Everything is column expressions over the row of a document and the one after it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.operators.joins import attach
from pulseframe.operators.ordered import numbered, running
from pulseframe.session import settle

#: Characters of a paragraph that ends before its line does, at least.
LEAST = 160
PARAGRAPH = rf"[^\n\r]{{{LEAST},}}?[.!?](?=[ \t])|[^\n\r]+"
#: Cells of one table of a part, and in the larger tries; the first bit that chooses a cell.
WIDTH = 4
SIZES = ((WIDTH, 0), (8, 6), (16, 15), (64, 27))
#: Digests of a text that a part has on average at most.
PART = 3
ROUNDS = 8
#: Code points that a range of ids holds, about.
RANGE_CHARS = 4 << 20
#: Ranges found by constants; each of them stands for a list of ranges in a small table.
FENCES = 256


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs, blanks at their ends aside."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), 0), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(found, lambda p: p != ""), lambda p: F.xxhash64(p)))


def unsigned_shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def cell_places(width: int, first: int) -> Column:
    """Where the cells of three tables are: how far a digest is shifted, and the slot it must then show."""
    bits = int(math.log2(width))
    places = (f"named_struct('shift', {first + table * bits}, 'slot', {slot}L)" for table in range(3) for slot in range(width))
    return F.expr(f"array({', '.join(places)})")  # one constant; built column by column it takes seconds of the driver


def held(digest: Column, place: Column, width: int) -> Column:
    return unsigned_shift(digest, place["shift"]).bitwiseAND(F.lit(width - 1).cast("bigint")) == place["slot"]


def cell(count: Column, key: Column, sign: Column) -> Column:
    return F.struct(count.cast("int").alias("count"), key.alias("key"), sign.alias("sign"))


def sketch(found: Column, width: int = WIDTH, first: int = 0) -> Column:
    """The cells of a set of digests."""
    empty = cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))

    def fill(place: Column) -> Column:
        add = lambda c, d: cell(c["count"] + 1, c["key"].bitwiseXOR(d), c["sign"].bitwiseXOR(check(d)))
        return F.aggregate(found, empty, lambda c, d: F.when(held(d, place, width), add(c, d)).otherwise(c))

    return F.transform(cell_places(width, first), fill)


def subtract(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda x, y: cell(x["count"] - y["count"], x["key"].bitwiseXOR(y["key"]), x["sign"].bitwiseXOR(y["sign"])))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def peel(cells: Column, width: int = WIDTH, first: int = 0) -> Column:
    """The digests (key, count) that a subtracted sketch holds, or null where peeling gets stuck.

    The count is 1 for a digest of the first set only, -1 for one of the second only.
    """

    def step(state: Column, _: Column) -> Column:
        lone = F.filter(state["cells"], lambda c: (F.abs(c["count"]) == 1) & (c["sign"] == check(c["key"])))
        lone = F.array_distinct(F.transform(lone, lambda c: F.struct(c["key"].alias("key"), c["count"].alias("count"))))

        def remove(keys: Column) -> Column:
            def take(c: Column, place: Column) -> Column:
                out = lambda c, k: cell(c["count"] - k["count"], c["key"].bitwiseXOR(k["key"]), c["sign"].bitwiseXOR(check(k["key"])))
                return F.aggregate(keys, c, lambda c, k: F.when(held(k["key"], place, width), out(c, k)).otherwise(c))

            left = F.when(F.size(keys) == 0, state["cells"]).otherwise(F.zip_with(state["cells"], cell_places(width, first), take))
            return F.struct(left.alias("cells"), F.concat(state["found"], keys).alias("found"), (F.size(keys) == 0).alias("still"))

        return F.when(state["still"], state).otherwise(let(lone, remove))

    begin = F.struct(cells.alias("cells"), F.expr("cast(array() as array<struct<key: bigint, count: int>>)").alias("found"), F.lit(False).alias("still"))
    done = lambda s: F.forall(s["cells"], lambda c: (c["count"] == 0) & (c["key"] == 0) & (c["sign"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.when(done(s), s["found"]))


def part_difference(one: Column, two: Column) -> Column:
    """The digests in which two parts (found, cells) differ, by the smallest sketch that peels.

    Two digests share all cells of all four sizes with probability 2 ** -45; only then are the sets compared.
    """
    first, *larger = SIZES
    tries = [peel(subtract(sketch(one["found"], *size), sketch(two["found"], *size)), *size) for size in larger]
    signed = lambda keys, sign: F.transform(keys, lambda d: F.struct(d.alias("key"), F.lit(sign).alias("count")))
    last = F.concat(signed(F.array_except(one["found"], two["found"]), 1), signed(F.array_except(two["found"], one["found"]), -1))
    return F.coalesce(peel(subtract(one["cells"], two["cells"]), *first), *tries, last)


def split(found: Column, drop: Column, bits: Column) -> Column:
    """Parts of a set by ``bits`` bits of its digests, after the first ``drop``."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    placed = F.transform(found, lambda d: F.struct(unsigned_shift(F.call_function("shiftleft", d, drop), 64 - bits).alias("part"), d.alias("digest")))
    sought = lambda rows: F.transform(numbers, lambda n: F.transform(F.filter(rows, lambda r: r["part"] == n), lambda r: r["digest"]))
    return F.when(bits == 0, F.array(found)).otherwise(let(placed, sought))


def sketches(found: Column, bits: Column) -> Column:
    """The set in 2 ** ``bits`` parts (found, cells). Split in two steps, so that the work stays near linear."""

    def steps(first: Column, rest: Column) -> Column:
        return F.flatten(F.transform(split(found, F.lit(0), first), lambda part: split(part, first, rest)))

    parts = let(F.floor(bits / 2).cast("int"), lambda first: let(bits - first, lambda rest: steps(first, rest)))
    return F.transform(parts, lambda part: F.struct(part.alias("found"), sketch(part).alias("cells")))


def fingerprint(found: Column) -> Column:
    """(n, bits, parts) of a set of digests; the shape follows from its size alone."""
    bits = F.when(F.size(found) <= PART, 0).otherwise(F.ceil(F.log2(F.size(found) / F.lit(PART)))).cast("int")
    return let(bits, lambda b: F.struct(F.size(found).alias("n"), b.alias("bits"), sketches(found, b).alias("parts")))


def difference(one: Column, two: Column) -> Column:
    """The digests (key, count) in which two fingerprints differ."""

    def shaped(mark: Column, bits: Column) -> Column:
        anew = lambda: let(F.flatten(mark["parts"]["found"]), lambda found: sketches(found, bits))
        return F.when(mark["bits"] == bits, mark["parts"]).otherwise(anew())

    by_part = lambda bits: F.zip_with(shaped(one, bits), shaped(two, bits), part_difference)
    return F.flatten(let(F.greatest(one["bits"], two["bits"]), by_part))


def likeness(one: Column, two: Column, apart: Column) -> Column:
    """Shared digests over all digests of both sets; 1 for two empty sets."""
    total = one["n"] + two["n"]
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.size(apart)) / (total + F.size(apart)))


def written(mark: Column) -> Column:
    """The fingerprint as text: n, bits, and the cells part by part (count:key:check in hex, nothing for an empty cell)."""
    shown = lambda c: F.concat_ws(":", c["count"].cast("string"), F.hex(c["key"]), F.hex(c["sign"]))
    cells = F.transform(F.flatten(mark["parts"]["cells"]), lambda c: F.when(c["count"] == 0, "").otherwise(shown(c)))
    return F.concat_ws("/", mark["n"].cast("string"), mark["bits"].cast("string"), F.array_join(cells, ","))


#: The order of documents, greatest first: ids descending, rows without id last, rows of one id by the hash of their texts.
PLACE = ("known", "id", "mark")


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): null texts are empty; place is greater for documents that come earlier."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("bigint")), F.bitwise_not(F.xxhash64("text"))
    return docs.withColumn("place", F.struct(*(c.alias(name) for c, name in zip(own, PLACE))))


def count_below(bounds: Column, place: Column, most: int) -> Column:
    """How many of the sorted bounds are less than the place, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))))

    def halve(found: Column, step: Column) -> Column:
        return F.when((found + step <= F.size(bounds)) & (F.try_element_at(bounds, found + step) < place), found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve)


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, after): the text of the next document by descending doc_id; after the last comes the first.

    ``more`` columns are worked out from each text once, where the ranges are, and follow as ``after_<name>`` too.

    Places are cut into ranges of about ``range_chars`` at places that exist, so each range's last is known;
    it is also sent to the range above, where it follows the smallest, and the last of all to the lowest
    range. One shuffle of the texts; ranges and their numbers come from the places alone. A row finds its range
    by ``FENCES`` constants at most and the list of ranges behind one of them. Rows of one id, or without
    id, are spread over ranges like others; only rows equal in id and text lie in one.
    """
    rows = placed(docs)
    sizes = rows.groupBy("place").agg(F.sum(F.char_length("text") + 64).alias("chars")).select("place.*", "chars")
    upto = running(sizes, [], list(PLACE), {"upto": ("sum", F.col("chars"))})
    lasts = upto.groupBy(F.floor((F.col("upto") - F.col("chars")) / range_chars).alias("slab")).agg(F.max(F.struct(*PLACE)).alias("last"))
    bounds = settle(numbered(lasts.select("last.*"), list(PLACE)).select(F.struct(*PLACE).alias("last"), (F.col("row") - 1).alias("part")))
    count = bounds.count()
    names = ["text", *(more or {})]
    if not count:
        for name, value in (more or {}).items():
            rows = rows.withColumn(name, value)
        return rows.select("doc_id", *names, F.col("text").alias("after"), *(F.col(c).alias(f"after_{c}") for c in names[1:]))
    step = -(-count // FENCES)
    lists = bounds.groupBy(F.floor(F.col("part") / step).cast("int").alias("node")).agg(F.array_sort(F.collect_list("last")).alias("lasts"))
    fences = sorted(tuple(r["last"]) for r in bounds.filter((F.col("part") + 1) % step == 0).select("last").collect())
    known = ", ".join(f"named_struct('known', {str(k).lower()}, 'id', cast('{i}' as bigint), 'mark', cast('{m}' as bigint))" for k, i, m in fences)
    known = F.expr(f"array({known})")
    node = F.explode(F.array(count_below(known, F.col("place"), len(fences))))  # as a plain alias, the join infers a filter that names place for lists too
    found = attach(rows.select("*", node.alias("node")), lists, "node")
    part = (F.col("node") * step + count_below(F.col("lasts"), F.col("place"), step)).cast("bigint")
    is_last = F.array_contains("lasts", F.col("place"))
    found = found.withColumns({"part": part, "is_last": is_last}).select("doc_id", "text", "place", "part", "is_last")
    at = F.struct("part", F.lit(0).alias("guest"))
    above = F.struct(((F.col("part") + 1) % count).cast("bigint").alias("part"), F.lit(1).alias("guest"))
    visits = F.when(F.col("is_last"), F.array(at, above)).otherwise(F.array(at))
    visiting = found.select("doc_id", "text", "place", F.inline(visits)).repartition("part")
    for name, value in (more or {}).items():
        visiting = visiting.withColumn(name, value)
    after = F.lead(F.struct(*names)).over(Window.partitionBy("part").orderBy("guest", F.desc("place")))
    followed = visiting.withColumn("_after", after).filter("guest = 0")
    return followed.select("doc_id", *names, F.col("_after.text").alias("after"), *(F.col(f"_after.{c}").alias(f"after_{c}") for c in names[1:]))


def fingerprint_versions(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, gone, new) of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document. ``gone`` and ``new`` are the digests of the paragraphs that the edit took and brought,
    recovered from the two fingerprints. Null texts are empty; empty texts have an empty sketch and are
    alike; equal texts have equal fingerprints; a single document is followed by itself. Columns beyond
    doc_id and text are not read.
    """
    pairs = with_next(docs, range_chars, {"found": digests(F.col("text")), "mark": fingerprint(F.col("found"))})
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.substr("after", F.lit(1), half))
    texts = pairs.select("doc_id", size.cast("bigint").alias("n_chars"), edited.alias("edited"), F.col("mark").alias("text"), F.col("after_mark").alias("after"))
    sets = texts.withColumns({"edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256), "edited": digests(F.col("edited"))})
    marks = sets.withColumn("edited", fingerprint(F.col("edited")))
    one, two = F.col("text"), F.col("edited")
    others = F.transform(F.array("edited", "after"), lambda other: difference(one, other))
    apart = marks.select("doc_id", "n_chars", "edited_sha256", written(one).alias("fingerprint"), written(two).alias("edited_fingerprint"), others.alias("apart"), "text", "edited", "after")
    change = F.col("apart")[0]
    of = lambda sign: F.transform(F.filter(change, lambda d: d["count"] == sign), lambda d: d["key"])
    return apart.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(one, two, change).alias("near_edited"), likeness(one, F.col("after"), F.col("apart")[1]).alias("near_next"),
        of(1).alias("gone"), of(-1).alias("new"),
    )
