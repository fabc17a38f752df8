"""Ordered positions: nearest, brackets, aliases, offsets, grids, events, durations, roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed
from proofline.operators.sequence import numbered, ordered, scan


def nearest_timestamp(frames: DataFrame, asks: DataFrame, keys: Sequence[str], index: str, time: str, ask: str) -> DataFrame:
    """Frame index with the smallest time distance to every ask; ties go to the earlier frame.

    Frames and asks are merged into one order, and each ask looks at the nearest
    frame on both sides, so no ask is compared with more than two frames.
    """
    marks = frames.groupBy(*keys, F.col(time).alias("_t")).agg(F.min(index).alias("_index"))
    points = marks.select(*keys, "_t", F.lit(0).alias("_kind"), F.struct("_t", "_index").alias("_frame")).unionByName(
        asks.select(*keys, F.col(ask).alias("_t")).distinct().select(
            "*", F.lit(1).alias("_kind"), F.lit(None).cast(f"struct<_t:{dict(marks.dtypes)['_t']},_index:{dict(marks.dtypes)['_index']}>").alias("_frame"))
    )
    merged = scan(ordered(points, keys, ["_t", "_kind"]), before_valid={"_a": "_frame"}, after_valid={"_b": "_frame"}).plain()
    before, after = F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_t")
    pick = F.when(F.col("_b").isNull() | (before <= after), F.col("_a")).otherwise(F.col("_b"))
    return merged.where("_kind = 1").select(
        *keys, F.col("_t").alias(ask), pick["_index"].alias(index), F.abs(pick["_t"] - F.col("_t")).alias("distance")
    )


def bracket_lookup(positions: DataFrame, clip: str, order: Sequence[str], position_id: str, is_key: Column, loops: str) -> DataFrame:
    """Nearest keyframe on both sides of every in-between, wrapping around in looping clips."""
    marked = positions.withColumn("_key", F.when(is_key, F.col(position_id))).withColumn("_is_key", is_key)
    seq = scan(ordered(marked, [clip], order), before_valid={"_before": "_key"}, after_valid={"_after": "_key"}).plain()
    place = F.struct(*order)
    ends = positions.where(is_key).groupBy(clip).agg(
        F.min_by(position_id, place).alias("_first"), F.max_by(position_id, place).alias("_last")
    )
    joined = seq.where(~F.col("_is_key")).join(ends, on=clip, how="left")

    def wrapped(found: str, other_end: str) -> Column:
        return F.coalesce(F.col(found), F.when(F.col(loops), F.col(other_end)))

    return joined.select(
        clip, position_id, wrapped("_before", "_last").alias("previous_keyframe"), wrapped("_after", "_first").alias("next_keyframe")
    )


def alias_resolution(positions: DataFrame, clip: str) -> DataFrame:
    """Aliases that do not point to an earlier concrete position, or close where nothing ends.

    Columns: clip, index, id, role, alias_of, alias_kind, loop.
    """
    concrete = positions.where("role <> 'alias'").groupBy(clip, F.col("id").alias("alias_of")).agg(F.min("index").alias("_at"))
    ends = positions.groupBy(clip).agg(F.max("index").alias("_end"))
    aliases = positions.where("role = 'alias'").join(concrete, on=[clip, "alias_of"], how="left").join(ends, on=clip)
    reasons = listed(
        F.when(F.col("_at").isNull(), "no such concrete position"),
        F.when(F.col("_at") >= F.col("index"), "not earlier"),
        F.when(~F.coalesce(F.col("alias_kind").isin("hold", "closing"), F.lit(False)), "unknown kind"),
        F.when((F.col("alias_kind") == "closing") & ~(F.col("loop") & (F.col("index") == F.col("_end"))), "closing must end a loop"),)
    return aliases.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("_at", "_end")


def running_offset(clips: DataFrame, package: str, order: str, count: str) -> DataFrame:
    """Global index of the first cell of every clip."""
    return scan(ordered(clips, [package], [order]), before_sum={"offset": count}).plain()


def grid_position(df: DataFrame, index: str, columns: Column, rows: Column, column_major: Column) -> DataFrame:
    i = F.col(index)
    return df.withColumn(
        "column", F.when(column_major, F.floor(i / rows)).otherwise(i % columns).cast("bigint")
    ).withColumn("row", F.when(column_major, i % rows).otherwise(F.floor(i / columns)).cast("bigint"))


def unused_slots(sheets: DataFrame, sheet: str, count: str, columns: int) -> DataFrame:
    """Slots after the last cell of every sheet; fewer than ``columns`` each."""
    rows = F.ceil(F.col(count) / columns)
    return sheets.select(sheet, F.explode(F.filter(
        F.sequence(F.col(count), rows * columns), lambda s: s < rows * columns)).alias("slot"))


def event_positions(plan: DataFrame, clip: str, position: str, events: str, counts: DataFrame) -> DataFrame:
    """Events of every position in order, each marked when its position is out of range."""
    flat = plan.select(clip, F.col(position).alias("position"), F.posexplode(events).alias("ordinal", "name"))
    inside = (F.col("position") >= 0) & (F.col("position") < F.col("positions"))
    return flat.join(counts, on=clip).select(clip, "position", "ordinal", "name", inside.alias("in_range"))


def duration_audit(positions: DataFrame, clips: DataFrame, clip: str, duration: str, limit: int = 60_000) -> DataFrame:
    """Per clip: every duration a positive integer within the limit, one per position, total preserved.

    ``clips`` holds the declared ``positions`` and ``total_ms``.
    """
    d = F.col(duration)
    stats = positions.groupBy(clip).agg(
        F.count(duration).alias("durations"), F.count_if(d < 1).alias("not_positive"),
        F.count_if(d > limit).alias("too_long"), F.sum(duration).alias("measured_ms"),
    )
    joined = clips.join(stats, on=clip, how="left")
    reasons = listed(
        F.when(~F.col("durations").eqNullSafe(F.col("positions")), "one duration per position"),
        F.when(F.col("not_positive") > 0, "not positive"), F.when(F.col("too_long") > 0, "too long"),
        F.when(~F.col("measured_ms").eqNullSafe(F.col("total_ms")), "total not preserved"),)
    return joined.select(clip, "durations", "measured_ms", reasons.alias("reasons"))


def role_topology(positions: DataFrame, approved: DataFrame, clip: str, order: Sequence[str]) -> DataFrame:
    """Per clip: role counts and whether approved keyframes kept their order.

    ``positions``: clip, order columns, id, role.  ``approved``: clip, ordinal, id.
    """
    roles = positions.groupBy(clip).agg(
        F.count_if(F.col("role") == "keyframe").alias("keyframes"),
        F.count_if(F.col("role") == "in-between").alias("in_betweens"),
        F.count_if(F.col("role") != "alias").alias("concrete"),
    )
    now = numbered(ordered(positions.where("role = 'keyframe'").select(*dict.fromkeys([clip, *order, "id"])), [clip], order), "ordinal").plain()
    moved = now.select(clip, "ordinal", F.col("id").alias("_now")).join(
        approved.select(clip, "ordinal", F.col("id").alias("_then")), on=[clip, "ordinal"], how="full_outer"
    ).where(~F.col("_now").eqNullSafe(F.col("_then"))).groupBy(clip).agg(F.count(F.lit(1)).alias("_moved"))
    joined = roles.join(moved, on=clip, how="left").withColumn("moved_keyframes", F.coalesce("_moved", F.lit(0)))
    reasons = listed(
        F.when(F.col("keyframes") < 2, "at least two keyframes"),
        F.when(F.col("in_betweens") < 2, "at least two in-betweens"),
        F.when(F.col("concrete") < 1, "a concrete position"),
        F.when(F.col("moved_keyframes") > 0, "approved keyframe order"),)
    return joined.withColumn("reasons", reasons).drop("_moved")
