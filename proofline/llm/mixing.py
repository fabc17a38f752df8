"""Mix sources to target weights by hash-random keys, prefix sums and a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the random key that name a range of it; each source's rows fall evenly into 16 ** RANGE_DIGITS ranges.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``position`` from 0 in the given order, over any number of tasks."""
    fixed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the id is the task's number and, in its low 33 bits, the row's
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    bases = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.withColumn("_part", part).join(bases, "_part").withColumn("position", F.col("_base") + within).drop("_at", "_part", "_base")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table of (source, source_size).

    Sources in code point order (null last) get the weights in turn; they share ``share`` of all sizes by weight, a target stops
    at ``epochs`` times its source's size, and the excess is shared again by weight until none is above.
    """
    rank = F.col("position") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long")
    fixed = cut(numbered(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weight).drop("position"))
    most = F.col("source_size") * epochs
    total = fixed.agg(F.sum("source_size").alias("n")).collect()[0]["n"] or 0
    rate = 0.0
    while True:  # each round saturates at least one more source
        full = most < F.lit(rate) * F.col("weight")
        told = fixed.agg(F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).collect()[0]
        following = (share * total - (told["full"] or 0)) / told["open"] if told["open"] else rate
        if following <= rate:
            break
        rate = following
    return fixed.withColumn("target", F.least(most.cast("double"), F.lit(rate) * F.col("weight")))


def mix(
    docs: DataFrame, size: Column, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix",
    key: str = "doc_id", source: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """How much of each document the mix takes: key, size, source, source_size, target, taken and the ``carry`` columns.

    Each source takes whole epochs while they fit its target; the rest goes through its documents in the order of a random key (a
    hash of seed and document key) and ends inside the document at which the rounded target is reached.  The same seed
    gives the same mix.  Rows of a source are dealt into ranges of the random key, so a source with a third of all rows
    is spread; prefix sums run within ranges, and over one row per range.

    A null size counts 0; a null source is a source; rows with a null or repeated key are kept, and equal rows are
    interchangeable.  Sources without any size take nothing.  An empty table gives no rows.
    """
    spot = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        spot.alias("spot"), *carry,
    )
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = cut(rows.withColumn("name", name).withColumn("range", F.substring("spot", 1, RANGE_DIGITS)))  # texts are read once
    ranges = rows.groupBy("name", "source", "range").agg(F.sum("size").alias("size"))
    plan = targets(ranges.groupBy("name", "source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("name", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    bases = bases.join(plan.select("name", "source_size", "target"), "name")
    inside = Window.partitionBy("name", "range").orderBy("spot", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["name", "range"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - full * F.col("source_size") + 0.5).cast("long")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("base") - F.col("before")))
    return placed.select(
        F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target",
        (full * F.col("size") + more).cast("long").alias("taken"), *carry,
    )
