"""Ordered frame analytics: timing, neighbour deltas, loops, near-duplicates, outliers, cycles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.cases import lookup
from proofline.functions.arrays import abs_diff_sum, mask_counts, mean_abs_diff, total
from proofline.operators.sequence import (
    Ordered, exact_quantiles, islands, ordered, scan,
)
from proofline.session import cut

# Collapse thresholds, materiality floors and outlier rule.
DELTAS = ("mean_alpha_difference", "contour_change_ratio", "area_change_ratio")
COLLAPSE_AT_MOST = {
    "mean_alpha_difference": 0.003,
    "contour_change_ratio": 0.012,
    "area_change_ratio": 0.003,
}
MATERIALITY = {
    "mean_alpha_difference": 0.015,
    "contour_change_ratio": 0.040,
    "area_change_ratio": 0.015,
}
MAD_SCALE = 1.4826
MAD_LIMIT = 6.0
SOLID = 128
LISTED_CYCLES = 100


def timing_repair(stamps: DataFrame, clips: DataFrame, clip: str, index: str) -> DataFrame:
    """Repair non-positive durations; a clip whose stamp count disagrees gets a uniform grid.

    ``stamps``: clip, index, timestamp, duration.  ``clips``: clip, decoded (frame
    count), fps (0 when unknown).
    """
    fallback = F.when(F.col("fps") > 0, F.lit(1.0) / F.col("fps")).otherwise(F.lit(1.0 / 24.0))
    counts = stamps.groupBy(clip).agg(F.count(F.lit(1)).alias("_n"))
    judged = clips.join(counts, on=clip, how="left").withColumn("_fallback", fallback)
    agrees = F.coalesce(F.col("_n"), F.lit(0)) == F.col("decoded")
    seq = scan(ordered(stamps, [clip], [index]), next={"_next": "timestamp"}).plain()
    kept = seq.join(judged.where(agrees).select(clip, "_fallback"), on=clip)
    repaired = F.when(F.col("duration") > 0, F.col("duration")).otherwise(
        F.coalesce(F.greatest(F.col("_next") - F.col("timestamp"), F.col("_fallback")), F.col("_fallback"))
    )
    # greatest() skips nulls, so a missing successor must be tested first
    repaired = F.when((F.col("duration") <= 0) & F.col("_next").isNull(), F.col("_fallback")).otherwise(repaired)
    block = 65_536
    grid = judged.where(~agrees & (F.col("decoded") > 0)).select(
        clip, "decoded", "_fallback", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("decoded") - 1, F.lit(block).cast("bigint"))).alias("_from")
    ).select(
        clip, "_fallback",
        F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + block, F.col("decoded")) - 1)).alias(index),
    )
    return kept.select(clip, index, "timestamp", repaired.alias("duration"), F.lit(False).alias("synthetic")).unionByName(
        grid.select(clip, index, (F.col(index) * F.col("_fallback")).alias("timestamp"),
                    F.col("_fallback").alias("duration"), F.lit(True).alias("synthetic"))
    )


def step_motion(frames: DataFrame, clip: str, order: str, feature: str) -> DataFrame:
    """Mean absolute difference to the previous frame; the first frame of a clip has none."""
    seq = scan(ordered(frames.select(clip, order, feature), [clip], [order]), prev={"_prev": feature})
    steps = seq.plain().where(F.col("_prev").isNotNull())
    return steps.select(clip, order, mean_abs_diff(F.col(feature), F.col("_prev")).alias("step"))


def typical_motion(steps: DataFrame, clip: str) -> DataFrame:
    medians = exact_quantiles(steps, [clip], "step", {"median_step": 0.5})
    return medians.withColumn("typical_motion", F.greatest("median_step", F.lit(1e-6)))


def delta_columns(left: Column, right: Column) -> dict[str, Column]:
    """Difference, contour and area metrics between two 0..255 planes."""
    counts = mask_counts(left, right, SOLID)
    union = counts["both"] + counts["only_a"] + counts["only_b"]
    a, b = total(left, "bigint"), total(right, "bigint")
    return {
        "mean_alpha_difference": abs_diff_sum(left, right, "bigint") / (F.size(left) * F.lit(255.0)),
        "contour_change_ratio": F.when(union > 0, (counts["only_a"] + counts["only_b"]) / union).otherwise(F.lit(0.0)),
        "area_change_ratio": (F.abs(a - b) / F.lit(255.0)) / F.greatest((a + b) / F.lit(510.0), F.lit(1.0)),
    }


def neighbours(frames: DataFrame, clip: str, order: str, plane: str, extra: Sequence[str] = ()) -> Ordered:
    """Every frame with deltas to its predecessor (null on the first), chunks kept for more scans."""
    seq = scan(ordered(frames.select(clip, order, plane, *extra), [clip], [order]),
               prev={"_plane": plane, "from_frame": order})
    metrics = delta_columns(F.col("_plane"), F.col(plane))
    first = F.col("from_frame").isNull()
    return seq.derive(seq.df.select("*", *[F.when(~first, m).alias(n) for n, m in metrics.items()]).drop("_plane"))


def pair_deltas(frames: DataFrame, clip: str, order: str, plane: str) -> DataFrame:
    out = neighbours(frames, clip, order, plane).plain()
    return out.where(F.col("from_frame").isNotNull()).select(
        clip, "from_frame", F.col(order).alias("to_frame"), F.lit(False).alias("is_loop"), *DELTAS
    )


def loop_pair(frames: DataFrame, clip: str, order: str, plane: str) -> DataFrame:
    """The same metrics from the last frame of a clip back to its first."""
    ends = frames.groupBy(clip).agg(
        F.min_by(F.struct(F.col(order).alias("i"), F.col(plane).alias("p")), order).alias("_first"),
        F.max_by(F.struct(F.col(order).alias("i"), F.col(plane).alias("p")), order).alias("_last"),
    )
    metrics = delta_columns(F.col("_last.p"), F.col("_first.p"))
    return ends.select(
        clip, F.col("_last.i").alias("from_frame"), F.col("_first.i").alias("to_frame"), F.lit(True).alias("is_loop"),
        *[m.alias(n) for n, m in metrics.items()],
    )


def collapse_near_duplicates(frames: DataFrame, clip: str, order: str, plane: str, duration: str) -> DataFrame:
    """Runs of frames within all thresholds of their predecessor.

    Members of a run are contiguous, so first frame, last frame and count name
    them all; durations add up and the first frame is retained.
    """
    seq = neighbours(frames, clip, order, plane, [duration])
    near = F.lit(True)
    for name, limit in COLLAPSE_AT_MOST.items():
        near = near & (F.col(name) <= limit)
    runs = islands(seq, ~F.coalesce(near, F.lit(False)), "group").plain()
    return runs.groupBy(clip, "group").agg(
        F.min(order).alias("first_frame"), F.max(order).alias("last_frame"),
        F.count(F.lit(1)).alias("frames"), F.sum(duration).alias("duration"),
    )


def robust_envelope(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and scaled median absolute deviation per key, both exact."""
    medians = exact_quantiles(values, keys, value, {"median": 0.5})
    away = values.select(*keys, value).join(medians, on=list(keys)).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    mads = exact_quantiles(away, keys, "_away", {"mad": 0.5})
    return medians.join(mads, on=list(keys)).withColumn("robust_scale", F.col("mad") * MAD_SCALE)


def beyond_envelope(value: Column, floor: Column) -> Column:
    """Outlier test against columns ``median`` and ``robust_scale``."""
    scale = F.col("robust_scale")
    far = F.when(scale <= 1e-12, value > F.col("median") + 1e-6).otherwise(
        (value - F.col("median")) / F.greatest(scale, F.lit(1e-12)) > MAD_LIMIT
    )
    return far & (value > floor)


def robust_outliers(pairs: DataFrame, clip: str, floors: Mapping[str, float] = MATERIALITY) -> DataFrame:
    """Pairs that leave the sequence's robust envelope; the loop pair is judged but not counted."""
    long = cut(pairs.unpivot([clip, "from_frame", "to_frame", "is_loop"], list(floors), "metric", "value"))  # read three times below
    envelope = robust_envelope(long.where(~F.col("is_loop")), [clip, "metric"], "value")
    floor = lookup(F.col("metric"), floors)
    judged = long.join(envelope, on=[clip, "metric"])
    return judged.where(beyond_envelope(F.col("value"), floor)).select(
        clip, "from_frame", "to_frame", "is_loop", "metric", "value", "median", "robust_scale"
    )


# --- cycle search ---------------------------------------------------------------------------


def frame_statistics(frames: DataFrame, clip: str, index: str, feature: str) -> DataFrame:
    """Per frame: speeds, path length so far, clip size and typical motion, pivot distances.

    ``index`` must count 0..n-1 inside each clip.  The pivots are the first and
    the last frame; distances to them bound the distance of any two frames.
    """
    base = frames.select(F.col(clip).alias("clip"), F.col(index).cast("bigint").alias("i"), F.col(feature).cast("array<double>").alias("f"))
    near = scan(ordered(base.withColumn("_one", F.lit(1).cast("bigint")), ["clip"], ["i"]),
                prev={"_pf": "f"}, next={"_nf": "f"}, total={"n": "_one"}, first={"_p1": "f"}, last={"_p2": "f"})
    speeds = near.derive(near.df.select(
        "clip", "i", "f", "n", "_chunk",
        F.coalesce(mean_abs_diff(F.col("_nf"), F.col("f")), F.lit(0.0)).alias("speed_out"),
        F.coalesce(mean_abs_diff(F.col("f"), F.col("_pf")), F.lit(0.0)).alias("speed_in"),
        mean_abs_diff(F.col("f"), F.col("_p1")).alias("d1"), mean_abs_diff(F.col("f"), F.col("_p2")).alias("d2"),
    ))
    paths = scan(speeds, before_sum={"path": "speed_out"}).plain()
    steps = paths.where("i > 0").select("clip", F.col("speed_in").alias("step"))
    typical = typical_motion(steps, "clip").select("clip", F.col("typical_motion").alias("typical"))
    minimum = F.greatest(F.lit(3), F.least(F.lit(8), F.expr("div(n, 4)")))
    return cut(paths.join(typical, on="clip").withColumn("least_frames", minimum))


def _side(stats: DataFrame, prefix: str) -> DataFrame:
    return stats.select("clip", *[F.col(c).alias(f"{prefix}_{c}") for c in stats.columns if c != "clip"])


# Weights of the velocity and of standing still, the share of the typical motion below which a range stands still,
# and the share that a range away from both clip ends pays.
VELOCITY_WEIGHT = 0.5
STILL_WEIGHT = 4.0
STILL_SHARE = 0.25
EDGE_SHARE = 0.02


def _scored(pairs: DataFrame) -> DataFrame:
    """Score pairs that carry ``s_*`` and ``e_*`` frame statistics."""
    span = F.col("e_i") - F.col("s_i")
    pose = mean_abs_diff(F.col("s_f"), F.col("e_f"))
    velocity = F.abs(F.col("s_speed_out") - F.col("e_speed_in"))
    energy = (F.col("e_path") - F.col("s_path")) / span
    still = F.greatest(F.lit(0.0), F.col("s_typical") * STILL_SHARE - F.col("motion_energy")) * STILL_WEIGHT
    edge = F.when((F.col("s_i") == 0) | (F.col("e_i") == F.col("e_n") - 1), F.lit(0.0)).otherwise(F.col("s_typical") * EDGE_SHARE)
    measured = pairs.where(span + 1 >= F.col("s_least_frames")).select(
        "clip", F.col("s_i").alias("start_frame"), F.col("e_i").alias("end_frame"), (span + 1).alias("frame_count"),
        F.col("s_n").alias("n"), pose.alias("pose_distance"), velocity.alias("velocity_distance"),
        energy.alias("motion_energy"), "s_typical", edge.alias("_edge"),
    )
    score = F.col("pose_distance") + F.col("velocity_distance") * VELOCITY_WEIGHT + still + F.col("_edge")
    return measured.withColumn("score", score).drop("s_typical", "_edge")


def _best(cands: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("clip").orderBy("score", F.desc("frame_count"), "start_frame")
    return cands.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


# Frames of a block, of an area's side and of a strip of it; frames of a clip whose distances bound those of all others; components
# added between two looks at the sums; slack of bounds for rounding.
BLOCK_FRAMES = 64
AREA_FRAMES = 2048
STRIP_FRAMES = 64
PIVOTS = 8
STEP = 8
SLACK = 1e-9


def cycle_blocks(inner: DataFrame, size: int = BLOCK_FRAMES) -> DataFrame:
    """Blocks of ``size`` neighbouring frames: clip, block, and per pivot the least and greatest distance of a frame to it."""
    spot = F.expr(f"(i - 1) * {PIVOTS - 1} div greatest(n - 3, 1)")  # inner frames are 1 to n - 2; the first of each stretch is a pivot
    pivots = inner.select("clip", "i", "f", spot.alias("_at")).groupBy("clip", "_at").agg(F.min_by("f", "i").alias("f"))
    pivots = cut(pivots.groupBy("clip").agg(F.collect_list("f").alias("_pivots")))
    far = [mean_abs_diff(F.col("f"), F.get("_pivots", F.lit(k))).alias(f"_d{k}") for k in range(PIVOTS)]
    rows = inner.join(pivots, on="clip").select("clip", F.expr(f"i div {size}").alias("block"), *far)
    return cut(rows.groupBy("clip", "block").agg(
        F.array(*[F.min(f"_d{k}") for k in range(PIVOTS)]).alias("low"), F.array(*[F.max(f"_d{k}") for k in range(PIVOTS)]).alias("high")))


def cycle_tiles(blocks: DataFrame, clips: DataFrame, size: int = BLOCK_FRAMES) -> DataFrame:
    """Pairs of blocks (clip, first, second) and whether they ``may_win``: by the pivots, no two of their frames need be further apart than the clip's width.

    ``clips``: clip, n, width, least_frames.  A clip has a tile for each square of ``size`` frames above the diagonal.
    """
    last = F.expr(f"(n - 2) div {size}")
    tiles = clips.select("clip", "width", "least_frames", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("first"), last.alias("_last"))
    tiles = tiles.select("clip", "width", "least_frames", "first", F.explode(F.sequence(F.col("first"), F.col("_last"))).alias("second"))
    side = lambda name: blocks.select("clip", F.col("block").alias(name), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"))
    joined = tiles.join(side("first"), on=["clip", "first"]).join(side("second"), on=["clip", "second"])
    gap = lambda a, b: F.array_max(F.zip_with(f"low_{a}", f"high_{b}", lambda x, y: x - y))
    apart = F.greatest(gap("first", "second"), gap("second", "first"))
    long_enough = (F.col("second") + 1) * size - 1 - F.col("first") * size + 1 >= F.col("least_frames")
    return joined.select("clip", "first", "second", (((apart <= F.col("width") + SLACK) | F.isnan(apart)) & long_enough).alias("may_win"))


def _leading(total: np.ndarray, i: np.ndarray, j: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``keep`` pairs by score, longer ranges and earlier starts first among equal scores."""
    if len(total) > keep:
        near = ~(total > np.partition(total, keep - 1)[keep - 1])
        total, i, j = total[near], i[near], j[near]
    order = np.lexsort((i, i - j, total))[:keep]
    return total[order], i[order], j[order]


def _area_best(frames: pa.Table, keep: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, start and end of the best ``keep`` interior ranges of an area, from the frames of its two sides.

    Strips of the first side meet those frames of the second that a few pivots leave.  Components are added in the order in which
    Spark adds them, so scores equal its own; pairs whose sum has passed the bound are given up, and the bound follows the best so far.
    """
    first, second, typical, least, bound = (frames.column(c)[0].as_py() for c in ("first", "second", "typical", "least_frames", "bound"))
    at = frames.column("i").to_numpy()
    order = np.argsort(at)
    values = lambda name: frames.column(name).to_numpy()[order]
    at, speed_out, speed_in, path = at[order], values("speed_out"), values("speed_in"), values("path")
    flat = frames.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    dims = len(flat) // len(at)
    vectors = flat.reshape(len(at), dims)[order]
    side = at // size
    rows, cols = np.nonzero(side == first)[0], np.nonzero(side == second)[0]
    turned = np.ascontiguousarray(vectors[cols].T)
    pivots = vectors[np.linspace(0, len(at) - 1, PIVOTS).astype(int)]
    distance = np.stack([np.abs(vectors - p).mean(axis=1) for p in pivots])
    shortest, edge = max(1, least - 1), typical * EDGE_SHARE
    best = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    for begin in range(0, len(rows), STRIP_FRAMES):
        strip = rows[begin : begin + STRIP_FRAMES]
        width = (bound - edge) * (1 + SLACK) + SLACK
        near, there = distance[:, strip], distance[:, cols]
        gap = np.maximum(near.min(axis=1)[:, None] - there, there - near.max(axis=1)[:, None]).max(axis=0)
        met = np.nonzero(~(gap > width + SLACK) & (at[cols] >= at[strip[0]] + shortest))[0]
        if not len(met):
            continue
        u, v = vectors[strip], turned[:, met]
        limit = width * dims
        sums, part = np.zeros((len(strip), len(met))), np.empty((len(strip), len(met)))
        done = 0
        a, b = None, None
        while done < dims:
            upto = min(dims, done + STEP)
            for k in range(done, upto):
                if a is None:
                    np.subtract(u[:, k, None], v[k], out=part)
                    np.abs(part, out=part)
                    sums += part
                else:
                    sums += np.abs(u[a, k] - v[k, b])
            done = upto
            open_ = ~(sums > limit)
            if a is not None:
                sums, a, b = sums[open_], a[open_], b[open_]
            elif np.count_nonzero(open_) * 8 <= open_.size:
                a, b = np.nonzero(open_)
                sums = sums[open_]
        if a is None:
            a, b = np.nonzero(~(sums > limit))
            sums = sums[a, b]
        s, e = strip[a], cols[met[b]]
        span = at[e] - at[s]
        long_enough = span >= shortest
        s, e, span, pose = s[long_enough], e[long_enough], span[long_enough], sums[long_enough] / dims
        energy = (path[e] - path[s]) / span
        still = np.maximum(0.0, typical * STILL_SHARE - energy) * STILL_WEIGHT
        total = pose + np.abs(speed_out[s] - speed_in[e]) * VELOCITY_WEIGHT + still + edge
        good = ~(total > bound * (1 + SLACK) + SLACK)
        found = [np.concatenate(x) for x in zip(best, (total[good], at[s[good]], at[e[good]]))]
        best = _leading(*found, keep)
        if len(best[0]) == keep and best[0][-1] < bound:
            bound = float(best[0][-1])
    return best


def _area_winners(areas: DataFrame, inner: DataFrame, clips: DataFrame, keep: int, size: int) -> DataFrame:
    """(clip, s_i, e_i): the best ``keep`` interior ranges of each clip; an area scores a fixed number of pairs and passes on at most ``keep``."""
    limits = clips.select("clip", "typical", "least_frames", "bound")
    asked = cut(areas.join(limits, on="clip").withColumn("block", F.explode(F.array_distinct(F.array("first", "second")))))
    frames = inner.select("clip", "i", F.expr(f"i div {size}").alias("block"), F.col("f").cast("array<double>").alias("f"), "speed_out", "speed_in", "path")
    dealt = frames.join(asked, on=["clip", "block"]).drop("block")
    kind = areas.schema["clip"].dataType.simpleString()

    def score(group: pa.Table) -> pa.Table:
        total, s, e = _area_best(group, keep, size)
        clip = group.column("clip").combine_chunks().take(pa.array(np.zeros(len(s), np.int64)))
        return pa.table({"clip": clip, "s_i": s, "e_i": e, "total": total})

    found = dealt.groupBy("clip", "first", "second").applyInArrow(score, f"clip {kind}, s_i bigint, e_i bigint, total double")
    order = Window.partitionBy("clip").orderBy("total", F.desc(F.col("e_i") - F.col("s_i")), "s_i")
    return cut(found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep).select("clip", "s_i", "e_i"))


def cycle_candidates(stats: DataFrame, keep: int = LISTED_CYCLES, area: int = AREA_FRAMES) -> DataFrame:
    """The exact ``keep`` best (start, end) ranges per clip, by branch and bound over areas.

    Ranges that touch a clip end are linear in number and all scored.  With one neighbour per frame in pivot order they give a bound
    on the keep-th best score.  Interior ranges lie in areas of two blocks of ``area`` frames.  The pose distance of any range
    in an area is at least the gap between the blocks' distances to a pivot, and its score at least that and the edge penalty, so only
    areas that may stay within the bound get their frames.  An area scores the same number of pairs whatever the clip, so a long clip
    is many equal pieces of work, and passes on its ``keep`` best, ties decided; those of a clip are scored again by Spark.
    The range over the whole clip is always part of the result (rank 0 when it is not among the best).
    """
    s, e = _side(stats, "s"), _side(stats, "e")
    heads = s.where("s_i = 0").join(e, on="clip")
    tails = s.where("s_i > 0").join(e.where("e_i = e_n - 1"), on="clip")
    touching = cut(_scored(heads).unionByName(_scored(tails)))

    in_order = scan(ordered(stats.select("clip", "d1", "i"), ["clip"], ["d1", "i"]), next={"_j": "i"}).plain().where("_j is not null")
    near = in_order.select("clip", F.least("i", "_j").alias("s_i"), F.greatest("i", "_j").alias("e_i"))
    near = near.join(s, on=["clip", "s_i"]).join(e, on=["clip", "e_i"]).where("s_i > 0 and e_i < e_n - 1")
    seeds = _best(touching.unionByName(_scored(near)), keep)
    bounds = seeds.groupBy("clip").agg(F.count(F.lit(1)).alias("_k"), F.max("score").alias("_u")).select(
        "clip", F.when(F.col("_k") < keep, F.lit(1e300)).otherwise(F.col("_u")).alias("bound")
    )
    sizes = stats.groupBy("clip").agg(F.max("n").alias("n"), F.max("typical").alias("typical"), F.max("least_frames").alias("least_frames"))
    clips = cut(sizes.join(bounds, on="clip").withColumn("width", F.col("bound") - F.col("typical") * EDGE_SHARE).where(f"width > -{SLACK} and n > 2"))
    inner = stats.where("i > 0 and i < n - 1")
    areas = cycle_tiles(cycle_blocks(inner, area), clips, area).where("may_win").drop("may_win")
    winners = _area_winners(areas, inner, clips, keep, area)
    inside = _scored(winners.join(s, on=["clip", "s_i"]).join(e, on=["clip", "e_i"]))
    everything = touching.unionByName(inside)
    best = _best(everything, keep)
    full = touching.where("start_frame = 0 and end_frame = n - 1").join(
        best.select("clip", "start_frame", "end_frame"), on=["clip", "start_frame", "end_frame"], how="left_anti"
    ).withColumn("rank", F.lit(0))
    return best.unionByName(full)


def explicit_cycles(stats: DataFrame, asked: DataFrame) -> DataFrame:
    """Score explicitly requested (clip, start_frame, end_frame) ranges."""
    s, e = _side(stats, "s"), _side(stats, "e")
    pairs = asked.select("clip", F.col("start_frame").alias("s_i"), F.col("end_frame").alias("e_i"))
    return _scored(pairs.join(s, on=["clip", "s_i"]).join(e, on=["clip", "e_i"]))


def cycle_select(cands: DataFrame, clips: DataFrame, explicit: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Chosen range per clip with status OK, AMBIGUOUS_CYCLE or NO_COMPLETE_CYCLE.

    ``cands`` comes from ``cycle_candidates``.  At most 25 ranges lie within two
    frames of a choice, so the list always contains the first different one.
    """
    row = F.struct("start_frame", "end_frame", "frame_count", "motion_energy", "score")
    heads = cands.groupBy("clip").agg(
        F.min_by(F.when(F.col("rank") > 0, row), F.when(F.col("rank") > 0, F.col("rank"))).alias("_top"),
        F.max(F.when((F.col("start_frame") == 0) & (F.col("end_frame") == F.col("n") - 1), row)).alias("_full"),
    )
    whole = F.col("_full").isNotNull() & (F.col("_full.score") <= F.col("_top.score") * 1.15 + 1e-6)
    chosen = heads.select("clip", F.when(whole, F.col("_full")).otherwise(F.col("_top")).alias("pick"))
    apart = (F.abs(F.col("start_frame") - F.col("pick.start_frame")) > 2) | (F.abs(F.col("end_frame") - F.col("pick.end_frame")) > 2)
    rivals = cands.where("rank > 0").join(chosen, on="clip").where(apart).groupBy("clip").agg(
        F.min_by("score", "rank").alias("rival_score")
    )
    judged = chosen.join(rivals, on="clip", how="left")
    ambiguous = F.coalesce(
        (F.col("rival_score") <= F.col("pick.score") * 1.01) & (F.col("pick.score") > 1e-6), F.lit(False)
    )
    if explicit is not None:
        fixed = explicit.select("clip", row.alias("_fixed"))
        judged = judged.join(asked.select("clip", F.lit(True).alias("_asked")), on="clip", how="left").join(fixed, on="clip", how="left")
        ambiguous = ambiguous & F.col("_asked").isNull()
        judged = judged.withColumn("pick", F.when(F.col("_asked").isNull(), F.col("pick")).otherwise(F.col("_fixed")))
    status = (
        F.when(F.col("pick").isNull(), "NO_COMPLETE_CYCLE").when(ambiguous, "AMBIGUOUS_CYCLE")
        .when(F.col("pick.motion_energy") <= 1e-6, "NO_COMPLETE_CYCLE").otherwise("OK")
    )
    return clips.select("clip").distinct().join(judged.withColumn("_ambiguous", ambiguous), on="clip", how="left").select(
        "clip", status.alias("status"), "pick.start_frame", "pick.end_frame", "pick.score"
    )
