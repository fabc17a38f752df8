"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  Where the
planner's size estimate of the rows is small, that is fine as it is.  Otherwise
``ordered`` first counts the rows of the largest key, an aggregate over the key
columns; while that stays below a limit, scans are plain windows as well.

Beyond the limit rows are range-partitioned on (keys, order), so a hot key is
spread over many chunks of similar size, and each scan works in two levels:

1. a window inside every (key, chunk), which is bounded by the chunk size;
2. a window over one summary row per (key, chunk), at most ``parts`` rows for a
   single hot key, that yields what each chunk inherits from its neighbours.

The inherited values are joined back on (keys, chunk).  The chunked rows are
written once to the shared folder, so both levels always see the same chunks.
Null keys are a key of their own; (keys, order) must be unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence as Seq
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut

CHUNK = "_chunk"
# Rows of one key that a single task may sort; ``spark.proofline.maxRowsPerKey`` overrides it.
MAX_ROWS_PER_KEY = 2_000_000
# Rows are taken to need at least so many bytes when the planner's estimate stands for a count.
ROW_BYTES = 32
# Quantiles: bits told apart by one histogram, and distinct values that one group may hold in the end.
DIGIT_BITS, LEAST_BUCKET = 11, 4096


@dataclass(frozen=True)
class Ordered:
    """Rows arranged by (keys, order), either in chunks or with every key known to be small."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool = True

    def derive(self, df: DataFrame) -> Ordered:
        """Same arrangement over a frame derived row by row from this one."""
        return replace(self, df=df)

    def plain(self) -> DataFrame:
        return self.df.drop(CHUNK)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of a frame's rows; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.proofline.maxRowsPerKey", str(MAX_ROWS_PER_KEY)))


def ordered(df: DataFrame, keys: Seq[str], order: Seq[str], parts: int | None = None) -> Ordered:
    """Arrange rows for scans; ``parts`` or ``spark.proofline.scanPartitions`` sets the number of chunks.

    Giving ``parts`` skips the size check and always makes chunks.
    """
    conf = df.sparkSession.conf
    if parts is None:
        limit, plain = row_limit(df), Ordered(df.withColumn(CHUNK, F.lit(0)), tuple(keys), tuple(order), chunked=False)
        if estimated_bytes(df) <= limit * ROW_BYTES:
            return plain
        largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= limit:
            return plain
    n = parts or int(conf.get("spark.proofline.scanPartitions", None) or conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return Ordered(cut(ranged.withColumn(CHUNK, F.spark_partition_id())), tuple(keys), tuple(order))


def scan(
    seq: Ordered,
    *,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    before_sum: Mapping[str, str] | None = None,
    before_max: Mapping[str, str] | None = None,
    before_valid: Mapping[str, str] | None = None,
    after_valid: Mapping[str, str] | None = None,
    total: Mapping[str, str] | None = None,
    first: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
) -> Ordered:
    """Add columns computed over the whole ordered key; each maps output to input.

    ``prev``/``next``: neighbouring row.  ``before_*``: strictly earlier rows
    (sum is 0 and max is null at the start).  ``before_valid``/``after_valid``:
    nearest non-null on either side.  ``total``/``first``/``last``: whole key.
    """
    prev, next, total = dict(prev or {}), dict(next or {}), dict(total or {})
    before_sum, before_max = dict(before_sum or {}), dict(before_max or {})
    before_valid, after_valid = dict(before_valid or {}), dict(after_valid or {})
    first, last = dict(first or {}), dict(last or {})

    if not seq.chunked:
        return _plain_scan(seq, prev, next, before_sum, before_max, before_valid, after_valid, total, first, last)
    by = [*seq.keys, CHUNK]
    position = F.struct(*seq.order)
    asc = Window.partitionBy(*by).orderBy(*seq.order)
    earlier = asc.rowsBetween(Window.unboundedPreceding, -1)
    # a frame that ends at unbounded following is rescanned per row; the mirrored order is linear
    later = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in seq.order]).rowsBetween(Window.unboundedPreceding, -1)
    s_all = Window.partitionBy(*seq.keys)
    s_asc = s_all.orderBy(CHUNK)
    s_earlier = s_asc.rowsBetween(Window.unboundedPreceding, -1)
    s_later = s_all.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    s_whole = s_asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def boxed(col: str) -> Column:
        return F.struct(F.col(col).alias("v"))

    def when_valid(col: str) -> Column:
        return F.when(F.col(col).isNotNull(), position)

    local: dict[str, Column] = {}
    chunk: dict[str, Column] = {}
    carry: dict[str, Column] = {}
    final: dict[str, Column] = {}

    def add(out: str, here: Column | None, per_chunk: Column, inherited: Column, merge) -> None:
        if here is not None:
            local[f"_l_{out}"] = here
        chunk[f"_s_{out}"] = per_chunk
        carry[f"_c_{out}"] = inherited
        final[out] = merge(F.col(f"_l_{out}"), F.col(f"_c_{out}"))

    for out, col in prev.items():
        add(out, F.lag(boxed(col)).over(asc), F.max_by(boxed(col), position),
            F.lag(f"_s_{out}").over(s_asc), lambda l, c: F.coalesce(l, c)["v"])
    for out, col in next.items():
        add(out, F.lead(boxed(col)).over(asc), F.min_by(boxed(col), position),
            F.lead(f"_s_{out}").over(s_asc), lambda l, c: F.coalesce(l, c)["v"])
    for out, col in before_sum.items():
        zero = F.lit(0)
        add(out, F.sum(col).over(earlier), F.sum(col), F.sum(f"_s_{out}").over(s_earlier),
            lambda l, c: F.coalesce(l, zero) + F.coalesce(c, zero))
    for out, col in before_max.items():
        add(out, F.max(col).over(earlier), F.max(col), F.max(f"_s_{out}").over(s_earlier),
            lambda l, c: F.greatest(l, c))
    for out, col in before_valid.items():
        add(out, F.last(col, ignorenulls=True).over(earlier), F.max_by(F.col(col), when_valid(col)),
            F.last(f"_s_{out}", ignorenulls=True).over(s_earlier), lambda l, c: F.coalesce(l, c))
    for out, col in after_valid.items():
        add(out, F.last(col, ignorenulls=True).over(later), F.min_by(F.col(col), when_valid(col)),
            F.last(f"_s_{out}", ignorenulls=True).over(s_later), lambda l, c: F.coalesce(l, c))
    for out, col in total.items():
        add(out, None, F.sum(col), F.sum(f"_s_{out}").over(s_all), lambda l, c: c)
    for out, col in first.items():
        add(out, None, F.min_by(boxed(col), position),
            F.first(f"_s_{out}").over(s_whole), lambda l, c: c["v"])
    for out, col in last.items():
        add(out, None, F.max_by(boxed(col), position),
            F.last(f"_s_{out}").over(s_whole), lambda l, c: c["v"])

    summary = (
        seq.df.groupBy(*by)
        .agg(*[expr.alias(name) for name, expr in chunk.items()])
        .select(*by, *[expr.alias(name) for name, expr in carry.items()])
    )
    kept = [c for c in seq.df.columns if c not in final]
    here = seq.df.select("*", *[expr.alias(name) for name, expr in local.items()])
    # null keys are a group of their own, here as in a plain window
    marks = {c: f"_of_{c}" for c in by}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(m)) for c, m in marks.items()])
    joined = here.join(summary.withColumnsRenamed(marks), on=same, how="left")
    return seq.derive(joined.select(*kept, *[expr.alias(name) for name, expr in final.items()]))


def _plain_scan(seq, prev, next, before_sum, before_max, before_valid, after_valid, total, first, last) -> Ordered:
    """The same columns as plain windows, for keys that one task can hold."""
    group = Window.partitionBy(*seq.keys)
    asc = group.orderBy(*seq.order)
    earlier = asc.rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(*[F.desc(c) for c in seq.order]).rowsBetween(Window.unboundedPreceding, -1)
    whole = asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {
        **{o: F.lag(c).over(asc) for o, c in prev.items()},
        **{o: F.lead(c).over(asc) for o, c in next.items()},
        **{o: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for o, c in before_sum.items()},
        **{o: F.max(c).over(earlier) for o, c in before_max.items()},
        **{o: F.last(c, ignorenulls=True).over(earlier) for o, c in before_valid.items()},
        **{o: F.last(c, ignorenulls=True).over(later) for o, c in after_valid.items()},
        **{o: F.sum(c).over(group) for o, c in total.items()},
        **{o: F.first(c).over(whole) for o, c in first.items()},
        **{o: F.last(c).over(whole) for o, c in last.items()},
    }
    kept = [c for c in seq.df.columns if c not in made]
    return seq.derive(seq.df.select(*kept, *[column.alias(name) for name, column in made.items()]))


def numbered(seq: Ordered, name: str = "rn", size: str | None = None) -> Ordered:
    """1-based row number inside each key, optionally with the key's row count."""
    base = seq.derive(seq.df.withColumn("_one", F.lit(1).cast("bigint")))
    out = scan(base, before_sum={name: "_one"}, total={size: "_one"} if size else None)
    return seq.derive(out.df.withColumn(name, (F.col(name) + 1).cast("bigint")).drop("_one"))


def islands(seq: Ordered, starts: Column, name: str = "island") -> Ordered:
    """Number runs of rows; ``starts`` is true on the first row of each run."""
    flagged = seq.derive(seq.df.withColumn("_start", F.when(starts, 1).otherwise(0).cast("bigint")))
    out = scan(flagged, before_sum={"_runs": "_start"})
    return seq.derive(
        out.df.withColumn(name, (F.col("_runs") + F.col("_start")).cast("bigint")).drop("_runs", "_start")
    )


def exact_quantiles(
    df: DataFrame, keys: Seq[str], value: str, quantiles: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without one task per key; nulls are left out, a row counts ``weight`` times.

    Values are counted per (key, value) with map-side combine.  Where the planner knows the input to be small, cumulative counts
    locate the two ranks next to each quantile.  Otherwise ``_selected`` narrows all of them at once.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    ranks = {f"_{side}_{name}": end(_position(q)) for name, q in quantiles.items() for side, end in (("a", F.floor), ("b", F.ceil))}
    if estimated_bytes(df) <= row_limit(df) * ROW_BYTES:
        ranked = scan(Ordered(counts.withColumn(CHUNK, F.lit(0)), tuple(keys), (value,), chunked=False), before_sum={"_lo": "_n"}, total={"_all": "_n"}).df
        inside = lambda rank: (F.col("_lo") <= rank) & (rank < F.col("_lo") + F.col("_n"))
        found = ranked.groupBy(*keys).agg(F.first("_all").alias("_all"), *[F.max(F.when(inside(rank), F.col(value))).alias(name) for name, rank in ranks.items()])
    else:
        found = _selected(cut(counts), list(keys), value, ranks)
    share = lambda q: _position(q) - F.floor(_position(q))
    return found.select(
        *keys, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * share(q)).alias(n) for n, q in quantiles.items()],
    )


def _position(q: float) -> Column:
    """Where a quantile lies among ``_all`` values, counted from 0."""
    return (F.col("_all") - 1) * F.lit(float(q))


def sortable_bits(value: Column, kind: str) -> Column:
    """A long that orders numbers as their values do; NaN is greatest, and the two zeros are one."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("bigint")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def _selected(counts: DataFrame, keys: list[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """Radix selection: ``_all`` and the values at some ranks per key, from (keys, value, ``_n``) of distinct values.

    Values are read as sortable 64-bit numbers.  A histogram of the leading ``DIGIT_BITS`` bits per key tells the bucket of each
    rank; those buckets that hold more than ``LEAST_BUCKET`` distinct values are narrowed by their next bits, at most six times in
    all.  What is shuffled are partial histograms, no window sees more than 2,048 rows of a key and rank, and one last join reads
    the few values of each final bucket.
    """
    kind = dict(counts.dtypes)[value]
    rows = cut(counts.withColumn("_u", sortable_bits(F.col(value), kind)))
    sums = [F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_d")]

    def picked(hist: DataFrame, by: list[str], rank: Column) -> DataFrame:
        """Buckets of a histogram that hold a rank, with the rank inside."""
        order = Window.partitionBy(*by).orderBy("_prefix")
        sized = hist.withColumn("_lo", F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return sized.withColumn("_rank", rank - F.col("_lo")).where("_rank >= 0 and _rank < _m")

    shift = 64 - DIGIT_BITS
    first = rows.groupBy(*keys, F.shiftright("_u", shift).alias("_prefix")).agg(*sums)
    first = first.withColumn("_all", F.sum("_m").over(Window.partitionBy(*keys)))
    order = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_lo", F.coalesce(F.sum("_m").over(order), F.lit(0)))
    asked = F.array(*[F.struct(F.lit(name).alias("_target"), (rank - F.col("_lo")).alias("_rank")) for name, rank in ranks.items()])
    buckets = first.select(*keys, "_all", "_prefix", "_m", "_d", F.inline(asked)).where("_rank >= 0 and _rank < _m")
    kept = ["_all", "_target", "_rank", "_prefix", "_d"]
    buckets, done = cut(buckets.select(*keys, *kept)), []
    while True:
        small = (F.col("_d") <= LEAST_BUCKET) | F.lit(shift == 0)
        done.append(_within(rows, buckets.where(small), keys, shift))
        wide = buckets.where(~small)
        if shift == 0 or wide.isEmpty():
            break
        met, shift = _within(rows, wide, keys, shift), max(0, shift - DIGIT_BITS)
        hist = met.groupBy(*keys, "_target", "_all", F.col("_rank").alias("_asked"), F.shiftright("_u", shift).alias("_prefix")).agg(*sums)
        buckets = cut(picked(hist, [*keys, "_target"], F.col("_asked")).select(*keys, *kept))
    order = Window.partitionBy(*keys, "_target").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    lowest = union_all(done).withColumn("_lo", F.coalesce(F.sum("_n").over(order), F.lit(0))).where("_lo <= _rank and _rank < _lo + _n")
    return lowest.groupBy(*keys).agg(F.first("_all").alias("_all"), *[F.max(F.when(F.col("_target") == name, F.col(value))).alias(name) for name in ranks])


def _within(rows: DataFrame, buckets: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """Rows of (keys, _u) joined to their buckets at a shift; null keys are keys, too."""
    marks = {c: f"_of_{c}" for c in keys}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(m)) for c, m in marks.items()], F.shiftright("_u", shift) == F.col("_prefix"))
    return rows.join(buckets.drop("_d").withColumnsRenamed(marks), same).drop(*marks.values(), "_prefix")


def best_per_key(df: DataFrame, keys: Seq[str], rank: Seq[Column]) -> DataFrame:
    """The smallest row per key by ``rank``; partial aggregation, no sort."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*rank)).alias("_best"))
    return picked.select("_best.*")


def union_all(frames: Seq[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
