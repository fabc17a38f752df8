"""Frame sequences against brute force and the expected outcomes of known clips."""

from __future__ import annotations

import numpy as np
from proofline.operators import motion


def circle(shift, size=96, radius=20):
    y, x = np.mgrid[0:size, 0:size]
    return [int(v) for v in np.where((x - 40 - shift) ** 2 + (y - 48) ** 2 <= radius ** 2, 255, 0).reshape(-1)]


def planes(spark, frames):
    return spark.createDataFrame([("c", i, p, 10) for i, p in enumerate(frames)], "clip string, frame int, plane array<int>, ms bigint")


def test_jump_and_loop_seam_are_outliers(spark):
    df = planes(spark, [circle(s) for s in (0, 1, 2, 3, 18)])
    pairs = motion.pair_deltas(df, "clip", "frame", "plane").unionByName(motion.loop_pair(df, "clip", "frame", "plane"))
    found = {(r["from_frame"], r["to_frame"]) for r in motion.robust_outliers(pairs, "clip").collect()}
    assert found == {(3, 4), (4, 0)}


def test_near_duplicate_pairs_collapse(spark):
    df = planes(spark, [circle(4 * (i // 2)) for i in range(24)])
    out = motion.collapse_near_duplicates(df, "clip", "frame", "plane", "ms").collect()
    assert len(out) == 12 and sum(r["duration"] for r in out) == 240 and {r["frames"] for r in out} == {2}


def brute(features):
    f = np.asarray(features, dtype=np.float64)
    n = len(f)
    step = np.abs(np.diff(f, axis=0)).mean(axis=1)
    typical = max(float(np.median(step)), 1e-6)
    least = max(3, min(8, n // 4))
    out = []
    for s in range(n):
        for e in range(s + least - 1, n):
            pose = float(np.abs(f[s] - f[e]).mean())
            velocity = abs((step[s] if s < n - 1 else 0.0) - (step[e - 1] if e else 0.0))
            energy = float(step[s:e].mean())
            score = pose + 0.5 * velocity + max(0.0, typical * 0.25 - energy) * 4.0 + (0.0 if s == 0 or e == n - 1 else typical * 0.02)
            out.append((score, -(e - s + 1), s, e, energy))
    return sorted(out)


def clips(spark, data):
    rows = [(c, i, [float(x) for x in v]) for c, frames in data.items() for i, v in enumerate(frames)]
    return spark.createDataFrame(rows, "clip string, i bigint, f array<double>")


def test_pruned_cycles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    t = np.arange(90)
    data = {
        "periodic": np.stack([np.sin(2 * np.pi * t / 24 + k) for k in range(6)], axis=1) + rng.normal(0, 0.01, (90, 6)),
        "noise": rng.normal(0, 1, (40, 6)), "still": np.zeros((60, 6)),
        "half still": np.concatenate([np.zeros((40, 6)), np.cumsum(rng.normal(0, 1, (40, 6)), axis=0)]),
        "short": rng.normal(0, 1, (4, 6)),
    }
    stats = motion.frame_statistics(clips(spark, data), "clip", "i", "f")
    for keep in (5, 100):
        got = motion.cycle_candidates(stats, keep=keep).where("rank > 0").collect()
        for name, frames in data.items():
            want = brute(frames)[:keep]
            have = sorted((r["rank"], r["score"]) for r in got if r["clip"] == name)
            assert np.allclose([s for _, s in have], [w[0] for w in want], atol=1e-9), name


def test_cycle_choice(spark):
    wave = [np.sin(2 * np.pi * np.arange(49) / 24 + k) for k in range(4)]
    data = {"still": np.zeros((20, 4)), "two cycles": np.stack(wave, axis=1), "tiny": np.zeros((2, 4))}
    frames = clips(spark, data)
    stats = motion.frame_statistics(frames, "clip", "i", "f")
    out = {r["clip"]: r["status"] for r in motion.cycle_select(motion.cycle_candidates(stats), frames).collect()}
    assert out["still"] == "NO_COMPLETE_CYCLE" and out["tiny"] == "NO_COMPLETE_CYCLE"
    assert out["two cycles"] in ("OK", "AMBIGUOUS_CYCLE")


def test_zero_durations_are_repaired(spark):
    stamps = spark.createDataFrame([("c", 0, 0.0, 0.0), ("c", 1, 0.5, 0.2), ("c", 2, 0.6, 0.0), ("x", 0, 0.0, 1.0)], "clip string, i bigint, timestamp double, duration double")
    info = spark.createDataFrame([("c", 3, 10.0), ("x", 2, 0.0)], "clip string, decoded bigint, fps double")
    out = {(r["clip"], r["i"]): round(r["duration"], 6) for r in motion.timing_repair(stamps, info, "clip", "i").collect()}
    assert out == {("c", 0): 0.5, ("c", 1): 0.2, ("c", 2): 0.1, ("x", 0): round(1 / 24, 6), ("x", 1): round(1 / 24, 6)}
