"""Rectangles, raster geometry, dominant values and nearest centres."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.arrays import squared_distance, total
from proofline.operators.sequence import (
    best_per_key, exact_quantiles, numbered, ordered, scan,
)
from proofline.session import cut


def _levels(df: DataFrame, cell: int) -> DataFrame:
    """``_level``: the first grid whose cells, twice as wide from level to level, are at least as wide and high as the rectangle."""
    longest = F.greatest(F.col("width"), F.col("height"), F.lit(cell)).cast("double")
    return df.withColumn("_level", F.ceil(F.log2(longest / cell)).cast("int"))


def _cells(df: DataFrame, cell: int, levels: Sequence[int]) -> DataFrame:
    """One row per cell that a rectangle touches on its own level and on the coarser ones in use: four a level at most, give or take rounding."""
    used = F.array_union(F.array("_level"), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k > F.col("_level")))
    at = df.withColumn("_grid", F.explode(used)).withColumn("_wide", F.pow(F.lit(2.0), F.col("_grid")) * cell)
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return at.withColumn(
        "_cx", F.explode(F.sequence(F.floor(F.col("left") / F.col("_wide")), F.floor(right / F.col("_wide"))))
    ).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("top") / F.col("_wide")), F.floor(bottom / F.col("_wide"))))).drop("_wide")


def region_overlap(cands: DataFrame, regions: DataFrame, clip: str, row_id: Sequence[str], cell: int = 64) -> DataFrame:
    """Mark candidates that strictly intersect a reviewed region of their clip.

    Rectangles lie on grids of doubling cells, each on the level of its size.  Two of them meet on the coarser of their levels, where
    both touch a handful of cells, so a rectangle gives a few rows for each level in use, however large it is.  The semi join never
    multiplies candidates.
    """
    box = _levels(regions.select(clip, "left", "top", "width", "height").distinct(), cell)
    asked = _levels(cands.select(clip, *row_id, *(c for c in ("left", "top", "width", "height") if c not in row_id)), cell)
    used = [r[0] for r in box.select("_level").union(asked.select("_level")).where("_level is not null").distinct().collect()]  # at most one per power of two
    spread = _cells(box, cell, used).select(
        clip, "_grid", "_cx", "_cy", F.col("_level").alias("_own"), F.col("left").alias("_l"), F.col("top").alias("_t"),
        (F.col("left") + F.col("width")).alias("_r"), (F.col("top") + F.col("height")).alias("_b"),
    ).withColumnsRenamed({clip: "_clip", "_cx": "_rx", "_cy": "_ry", "_grid": "_rg"})
    probes = _cells(asked, cell, used)
    meets = (
        (F.col(clip) == F.col("_clip")) & (F.col("_grid") == F.col("_rg")) & (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
        & (F.col("_grid") == F.greatest("_level", "_own"))
        & (F.col("left") < F.col("_r")) & (F.col("left") + F.col("width") > F.col("_l"))
        & (F.col("top") < F.col("_b")) & (F.col("top") + F.col("height") > F.col("_t"))
    )
    hits = probes.join(spread, meets, "left_semi").select(clip, *row_id).distinct().withColumn("in_scope", F.lit(True))
    return cands.join(hits, on=[clip, *row_id], how="left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def scoped_review(reviews: DataFrame, marked: DataFrame, clip: str) -> DataFrame:
    """Review status per clip after scoping; an ambiguous review passes through unchanged."""
    found = marked.groupBy(clip).agg(
        F.count_if("in_scope").alias("kept"), F.count_if(~F.col("in_scope")).alias("ignored")
    )
    unchanged = F.col("status") == "ambiguous"
    scoped = F.coalesce("kept", F.lit(0))
    outside = F.coalesce("ignored", F.lit(0))
    return reviews.join(found, on=clip, how="left").select(
        clip,
        F.when(unchanged, F.col("status")).when(scoped > 0, "detected").otherwise("clear").alias("status"),
        F.when(unchanged, scoped + outside).otherwise(scoped).alias("candidates"),
        F.when(unchanged, F.lit(0)).otherwise(outside).cast("bigint").alias("ignored"),
    )


def _at(test, plane: str) -> Column:
    """Positions of the cells that satisfy ``test``."""
    return F.filter(F.sequence(F.lit(0), F.size(plane) - 1), lambda i: test(F.element_at(F.col(plane), i + 1), i))


def _where(plane: str, test) -> Column:
    return F.when(F.size(plane) > 0, _at(test, plane)).otherwise(F.array().cast("array<int>"))


def frame_geometry(rasters: DataFrame, plane: str, width: int, anchor: tuple[int, int] = (0, 0)) -> DataFrame:
    """Box, area, plain and weighted centroid, anchor offset, margins, opaque and partial counts."""
    w = F.lit(width)
    on = rasters.withColumn("_on", _where(plane, lambda v, i: v > 0)).withColumn("_h", F.expr(f"div(size({plane}), {width})"))
    xs, ys = F.transform("_on", lambda i: i % w), F.transform("_on", lambda i: F.floor(i / w))
    area = F.size("_on").cast("bigint")
    weight = total(F.col(plane), "bigint")

    def weighted(coordinate) -> Column:
        value = F.transform("_on", lambda i: coordinate(i) * F.element_at(F.col(plane), i + 1))
        return F.round(total(value, "bigint") / F.nullif(weight, F.lit(0)), 6)

    out = on.select(
        "*",
        area.alias("area"),
        F.array_min(xs).cast("bigint").alias("left"), F.array_min(ys).cast("bigint").alias("top"),
        (F.array_max(xs) + 1).cast("bigint").alias("right"), (F.array_max(ys) + 1).cast("bigint").alias("bottom"),
        F.round(total(xs, "bigint") / F.nullif(area, F.lit(0)), 6).alias("centroid_x"),
        F.round(total(ys, "bigint") / F.nullif(area, F.lit(0)), 6).alias("centroid_y"),
        weighted(lambda i: i % w).alias("weighted_x"), weighted(lambda i: F.floor(i / w)).alias("weighted_y"),
        F.size(F.filter(plane, lambda v: v == 255)).cast("bigint").alias("opaque"),
        F.size(F.filter(plane, lambda v: (v > 0) & (v < 255))).cast("bigint").alias("partial"),
    )
    margin = F.least("left", "top", F.lit(width) - F.col("right"), F.col("_h") - F.col("bottom"))
    return out.select(
        "*", margin.cast("bigint").alias("margin"),
        F.round(F.col("centroid_x") - anchor[0], 6).alias("offset_x"),
        F.round(F.col("centroid_y") - anchor[1], 6).alias("offset_y"),
    ).drop("_on", "_h")


def safe_bounds_audit(rasters: DataFrame, plane: str, width: int, bounds: tuple[int, int, int, int]) -> DataFrame:
    """Visible cells beyond each side of the safe box and the canvas edges that are touched."""
    left, top, right, bottom = bounds
    height = F.expr(f"div(size({plane}), {width})")
    on = rasters.withColumn("_on", _where(plane, lambda v, i: v != 0)).withColumn("_h", height)

    def n(test) -> Column:
        return F.size(F.filter("_on", test)).cast("bigint")

    x, y = (lambda i: i % width), (lambda i: F.floor(i / width))
    edges = F.concat_ws(
        ",",
        F.when(F.exists("_on", lambda i: x(i) == 0), "left"), F.when(F.exists("_on", lambda i: y(i) == 0), "top"),
        F.when(F.exists("_on", lambda i: x(i) == width - 1), "right"),
        F.when(F.exists("_on", lambda i: y(i) == F.col("_h") - 1), "bottom"),
    )
    return on.select(
        "*", n(lambda i: x(i) < left).alias("left_pixels"), n(lambda i: y(i) < top).alias("top_pixels"),
        n(lambda i: x(i) >= right).alias("right_pixels"), n(lambda i: y(i) >= bottom).alias("bottom_pixels"),
        edges.alias("clipped_edges"),
    ).drop("_on", "_h")


def raster_diff(rasters: DataFrame, clip: str, order: str, plane: str) -> DataFrame:
    """Changed cells and summed absolute difference to the previous raster of the clip."""
    seq = scan(ordered(rasters.select(clip, order, plane), [clip], [order]), prev={"_prev": plane}).plain()
    gaps = F.zip_with(plane, "_prev", lambda a, b: F.abs(a - b))
    return seq.where("_prev is not null").select(
        clip, order, F.size(F.filter(gaps, lambda g: g > 0)).cast("bigint").alias("changed"),
        total(gaps, "bigint").alias("absolute_difference"),
    )


def edge_residue(rasters: DataFrame, plane: str, colour: str, width: int, outline: float) -> DataFrame:
    """Border residue share (corners count on both sides), clipping, and colour under zero alpha."""
    need = math.ceil(outline + 1.0)
    on = rasters.withColumn("_h", F.expr(f"div(size({plane}), {width})")).withColumn("_solid", _where(plane, lambda v, i: v >= 128))
    loud = on.withColumn("_loud", _where(plane, lambda v, i: v > 8))

    def hits(test) -> Column:
        return F.size(F.filter("_loud", test))

    border = (
        hits(lambda i: F.floor(i / width) == 0) + hits(lambda i: F.floor(i / width) == F.col("_h") - 1)
        + hits(lambda i: i % width == 0) + hits(lambda i: i % width == width - 1)
    )
    xs, ys = F.transform("_solid", lambda i: i % width), F.transform("_solid", lambda i: F.floor(i / width))
    margin = F.least(F.array_min(xs), F.array_min(ys), width - 1 - F.array_max(xs), F.col("_h") - 1 - F.array_max(ys))
    hidden = F.size(F.filter(F.zip_with(plane, colour, lambda a, c: (a == 0) & (c != 0)), lambda t: t)).cast("bigint")
    return loud.select(
        "*", (border / (2 * width + 2 * F.col("_h"))).alias("residue_rate"),
        ((F.size("_solid") == 0) | F.coalesce(margin < need, F.lit(True))).alias("clipped"), hidden.alias("hidden_colour"),
    ).drop("_h", "_solid", "_loud")


def centroid_step_gate(metrics: DataFrame, clip: str, order: str, x: str, y: str, max_step: float) -> DataFrame:
    """Neighbours whose centroid moves too far, or where either side shows nothing."""
    seq = scan(ordered(metrics.select(clip, order, x, y), [clip], [order]), prev={"_i": order, "_x": x, "_y": y}).plain()
    step = F.greatest(F.abs(F.col(x) - F.col("_x")), F.abs(F.col(y) - F.col("_y")))
    empty = F.col(x).isNull() | F.col("_x").isNull()
    reason = F.when(empty, "no visible content").when(step > max_step, "step too large")
    return seq.where("_i is not null").select(
        clip, order, F.when(~empty, step).alias("step"), reason.alias("reason")
    ).where("reason is not null")


def region_persistence(detections: DataFrame, frames: DataFrame, dominant: DataFrame, clip: str, region: str) -> DataFrame:
    """Per region: first and last frame, frames seen, share of analysed frames, area against the dominant subject."""
    seen = detections.groupBy(clip, region, "frame").agg(F.max("area").alias("area"))
    spans = seen.groupBy(clip, region).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("frame_count"), F.max("area").alias("area"),
    )
    analysed = frames.select(clip, "frame").distinct().groupBy(clip).agg(F.count(F.lit(1)).alias("_frames"))
    largest = dominant.groupBy(clip).agg(F.max("area").alias("_dominant"))
    return spans.join(analysed, on=clip).join(largest, on=clip, how="left").select(
        clip, region, "first_frame", "last_frame", "frame_count",
        (F.col("frame_count") / F.col("_frames")).alias("frame_coverage"),
        (F.col("area") / F.coalesce("_dominant", F.lit(1))).alias("area_ratio"),
    )


# Share of samples one cluster must explain, and its smallest size.
EXPLAINED_SHARE = 0.80
SMALLEST_CLUSTER = 16


def dominant_bin(samples: DataFrame, keys: Sequence[str], axes: Sequence[str], tolerance: float) -> DataFrame:
    """Fullest bin per key, the cluster around its mean, and how well that explains the samples.

    Equal samples are counted first, with map-side combine, and weighted from then on.  Seeds and centres, one row per key, are written
    before they are joined, so samples are not dealt by keys, of which a few may have most of them.
    """
    size = max(2.0, min(6.0, tolerance * 0.35))
    radius = max(3.0, tolerance * 0.55)
    bins = [f"_b{i}" for i in range(len(axes))]
    samples = cut(samples.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_w")))
    binned = samples.select(*keys, *axes, "_w", *[F.floor(F.col(a) / size).alias(b) for a, b in zip(axes, bins)])

    def mean(axis: str, of: Column) -> Column:
        known = F.when(F.col(axis).isNotNull() & of, F.col("_w"))
        return F.sum(F.col(axis).cast("double") * known) / F.sum(known)

    filled = binned.groupBy(*keys, *bins).agg(F.sum("_w").alias("_n"), *[mean(a, F.lit(True)).alias(f"_s_{a}") for a in axes])
    seeds = cut(best_per_key(filled, keys, [-F.col("_n"), *[F.col(b) for b in bins]]).select(
        *keys, F.col("_n").alias("bin_count"), *[f"_s_{a}" for a in axes]))

    def distance(prefix: str) -> Column:
        return F.sqrt(sum(((F.col(a) - F.col(f"{prefix}_{a}")) * (F.col(a) - F.col(f"{prefix}_{a}")) for a in axes), F.lit(0.0)))

    near = samples.join(seeds, on=list(keys)).withColumn("_in", distance("_s") <= radius)
    centre = cut(near.groupBy(*keys).agg(
        F.sum("_w").alias("samples"), F.sum(F.when(F.col("_in"), F.col("_w")).otherwise(0)).alias("members"), F.first("bin_count").alias("bin_count"),
        *[mean(a, F.col("_in")).alias(f"_c_{a}") for a in axes],
    ))
    measured = samples.join(centre, on=list(keys)).withColumn("_d", distance("_c"))
    known = F.when(F.col("_d").isNotNull(), F.col("_w"))
    spread = measured.groupBy(*keys).agg((F.sum(F.when(F.col("_d") <= tolerance, F.col("_w")).otherwise(0)) / F.sum(known)).alias("confidence"))
    tail = exact_quantiles(measured, keys, "_d", {"residual_p95": 0.95}, weight="_w")
    enough = F.col("members") >= F.greatest(F.lit(SMALLEST_CLUSTER), F.floor(F.col("samples") * EXPLAINED_SHARE))
    return centre.join(spread, on=list(keys)).join(tail, on=list(keys)).select(
        *keys, "samples", "members", "bin_count", *[F.col(f"_c_{a}").alias(f"centre_{a}") for a in axes],
        "confidence", "residual_p95", F.when(enough, "OK").otherwise("UNSUPPORTED_BACKGROUND").alias("status"),
    )


def center_blocks(centers: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """A metric partition of centres: rings (cell, pivot, ring, near, far) and (cell, ring, centres) of each.

    Every centre belongs to the nearest of a few pivots, which are centres themselves; a cell's centres are cut into blocks of about
    ``block`` by their distance to the pivot, so that a block is a ring around it.  Centres with equal vectors count as their first.
    """
    own = cut(centers.groupBy("center").agg(F.min("center_id").alias("center_id")))
    count = own.count()
    pivots = own.orderBy(F.xxhash64("center_id"), "center_id").limit(max(1, 2 * math.isqrt(count // block)))
    pivots = cut(pivots.select(F.col("center_id").alias("cell"), F.col("center").alias("pivot")))
    table = pivots.agg(F.collect_list(F.struct("cell", "pivot")).alias("p")).scalar()
    home = F.array_min(F.transform("_pivots", lambda p: F.struct(F.sqrt(squared_distance(F.col("center"), p["pivot"])).alias("d"), p["cell"].alias("cell"))))
    placed = cut(own.withColumn("_pivots", table).withColumn("_home", home).select("center_id", "center", "_home.*"))
    spot = numbered(ordered(placed.select("cell", "d", "center_id"), ["cell"], ["d", "center_id"]), "_rn").plain()
    dealt = cut(spot.withColumn("ring", F.expr(f"(_rn - 1) div {block}")).select("cell", "ring", "center_id", "d"))
    rings = cut(dealt.groupBy("cell", "ring").agg(F.min("d").alias("near"), F.max("d").alias("far")))
    members = placed.select("cell", "center_id", "center").join(dealt.select("cell", "ring", "center_id"), ["cell", "center_id"])
    return pivots.join(rings, "cell"), members.groupBy("cell", "ring").agg(F.collect_list(F.struct("center_id", F.col("center").alias("v"))).alias("_centers"))


def nearest_center(points: DataFrame, centers: DataFrame, point_id: str, vector: str, block: int = 256, report: bool = False) -> DataFrame:
    """Nearest centre per point, the first one on ties; with ``report`` also ``blocks``, the blocks of centres the point was compared to.

    A point measures its distance to each pivot; the least of these bounds its result.  By the triangle inequality a ring cannot hold
    anything nearer if the point's distance to its pivot lies further from the ring than that, so the point only visits the
    other rings, through an equi-join.  Pivots and rings grow with the square root of the centres and with their number over ``block``.
    """
    rings, members = center_blocks(centers, block)
    cells = rings.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.collect_list(F.struct("ring", "near", "far")).alias("rings"))
    table = cells.agg(F.collect_list(F.struct("cell", "pivot", "rings")).alias("c")).scalar()
    measured = points.select(point_id, vector).withColumn("_cells", table).withColumn(
        "_seen", F.transform("_cells", lambda c: F.struct(c["cell"].alias("cell"), F.sqrt(squared_distance(F.col(vector), c["pivot"])).alias("d"), c["rings"].alias("rings"))))
    bound = F.array_min(F.transform("_seen", lambda c: c["d"]))
    slack = 1e-9  # of the distances, for rounding
    wins = lambda d, r: F.greatest(d - r["far"], r["near"] - d) <= F.col("_bound") + slack * (d + r["far"])
    visits = F.flatten(F.transform("_seen", lambda c: F.transform(
        F.filter(c["rings"], lambda r: wins(c["d"], r)), lambda r: F.struct(c["cell"].alias("cell"), r["ring"].alias("ring")))))
    asked = measured.withColumn("_bound", bound).select(point_id, vector, F.inline(visits))
    scored = F.array_min(F.transform(
        "_centers", lambda c: F.struct(squared_distance(F.col(vector), c["v"]).alias("d"), c["center_id"].alias("id"))
    ))
    best = asked.join(members, ["cell", "ring"]).withColumn("_best", scored).groupBy(point_id).agg(F.min("_best").alias("_best"), F.count(F.lit(1)).alias("blocks"))
    return best.select(point_id, F.col("_best.id").alias("center_id"), F.sqrt("_best.d").alias("distance"), *(["blocks"] if report else []))


# Luminance weights, darkest share, smallest sample, widest spread.
LUMINANCE = (0.2126, 0.7152, 0.0722)
DARKEST_SHARE = 0.30
SMALLEST_SAMPLE = 16
WIDEST_SPREAD = 24.0


def palette_consensus(
    samples: DataFrame, clip: str, frame: str, channels: Sequence[str], reference: Sequence[float], max_distance: float
) -> DataFrame:
    """Median of the darkest samples per frame, agreement across frames, distance to a reference."""
    light = sum((F.col(c) * w for c, w in zip(channels, LUMINANCE)), F.lit(0.0))
    lit = samples.withColumn("_y", light)
    sizes = lit.groupBy(clip, frame).agg(F.count(F.lit(1)).alias("_n"))
    cutoff = exact_quantiles(lit, [clip, frame], "_y", {"_cut": DARKEST_SHARE}).join(sizes, on=[clip, frame])
    dark = lit.join(cutoff, on=[clip, frame]).where("_y <= _cut")
    long = dark.unpivot([clip, frame, "_n"], list(channels), "channel", "value")
    per_frame = exact_quantiles(long, [clip, frame, "channel"], "value", {"estimate": 0.5})
    spread = per_frame.groupBy(clip, "channel").agg((F.max("estimate") - F.min("estimate")).alias("spread"))
    middle = exact_quantiles(per_frame, [clip, "channel"], "estimate", {"colour": 0.5}).join(spread, on=[clip, "channel"])
    fewest = sizes.groupBy(clip).agg(F.min("_n").alias("fewest_samples"))

    def of(channel: str, value: str) -> Column:
        return F.max(F.when(F.col("channel") == channel, F.col(value)))

    wide = middle.withColumn("colour", F.bround("colour")).groupBy(clip).agg(
        F.max("spread").alias("widest_spread"), *[of(c, "colour").cast("bigint").alias(c) for c in channels]
    )
    gap = F.sqrt(sum(((F.col(c) - r) * (F.col(c) - r) for c, r in zip(channels, reference)), F.lit(0.0)))
    judged = wide.join(fewest, on=clip).withColumn("distance", gap)
    status = (
        F.when((F.col("fewest_samples") < SMALLEST_SAMPLE) | (F.col("widest_spread") > WIDEST_SPREAD), "OUTLINE_COLOR_UNCERTAIN")
        .when(F.col("distance") > max_distance, "OUTLINE_COLOR_MISMATCH").otherwise("OK")
    )
    return judged.withColumn("status", status)
