"""Operators whose plan must hold for long chains, hot keys, large rectangles and many centres, against plain Python."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.operators import geometry, jobs, motion, reviews, sequence
from proofline.operators.sequence import exact_quantiles
from proofline.session import cut, scratch_path
from proofline.sources import files


def jobs_of(spark, run):
    """What ``run`` returns, and the number of jobs it started."""
    group = f"count-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


# ---- task graphs

def plain_waves(nodes, edges):
    needs = {v: {u for a, u in edges if a == v and u in nodes} for v in nodes}
    waves, level = {}, 0
    while ready := [v for v in nodes if v not in waves and all(u in waves for u in needs[v])]:
        waves.update(dict.fromkeys(ready, level))
        level += 1
    return {v: waves.get(v, -1) for v in nodes}


def waves_of(spark, nodes, edges, plan="p"):
    n = spark.createDataFrame([(plan, v) for v in nodes], "plan string, id long")
    e = spark.createDataFrame([(plan, a, b) for a, b in edges], "plan string, id long, depends_on long")
    return {r.id: r.wave for r in jobs.task_waves(n, e).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_waves_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    edges = [(v, rng.randrange(v)) for v in nodes[1:] for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))]
    edges += [(3, 999), *edges[:5]]  # an unknown dependency, and repeated edges
    if seed % 2:
        edges += [(10, 40), (40, 41), (41, 10), (50, 50)]
    assert waves_of(spark, nodes, edges) == plain_waves(nodes, edges)


def test_a_chain_of_2000_tasks(spark):
    nodes = random.Random(1).sample(range(10_000), 2000)
    edges = [*zip(nodes[1:], nodes), (nodes[1500], nodes[3])]  # and a shortcut
    begin = time.time()
    assert waves_of(spark, nodes, edges) == {v: i for i, v in enumerate(nodes)}
    assert time.time() - begin < 60


def test_waves_of_nothing(spark):
    assert waves_of(spark, [], []) == {} and waves_of(spark, [5], [(5, 5)]) == {5: -1} and waves_of(spark, [5], []) == {5: 0}


# ---- quantiles

QUANTILES = {"m": 0.5, "p30": 0.3, "p95": 0.95, "least": 0.0, "most": 1.0}


def radix(spark, frame, value, least=4096):
    """Quantiles by radix selection, whatever the size."""
    conf = spark.conf
    conf.set("spark.proofline.maxRowsPerKey", "0")
    old, sequence.LEAST_BUCKET = sequence.LEAST_BUCKET, least
    try:
        return exact_quantiles(frame, ["k"], value, QUANTILES)
    finally:
        sequence.LEAST_BUCKET = old
        conf.unset("spark.proofline.maxRowsPerKey")


@pytest.mark.parametrize("least", [4096, 1])
def test_radix_selection_matches_numpy(spark, least):
    rng = np.random.default_rng(7)
    groups = {
        "hot": [*rng.normal(size=900), *rng.normal(size=300) * 1e-9], "near": 1.0 + np.arange(500) * 2.0**-52, "wide": 10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400),
        "one": [3.5], "zeros": [0.0, -0.0, 0.0, -1.0], None: [5.0, 6.0], "same": [2.25] * 700,
    }
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    found = {r.k: r for r in radix(spark, spark.createDataFrame(data, "k string, v double").repartition(5), "v", least).collect()}
    assert found.keys() == groups.keys()
    for k, r in found.items():
        assert np.array_equal([r.m, r.p30, r.p95, r.least, r.most], np.quantile(np.array(groups[k], float), list(QUANTILES.values()))) or np.allclose(
            [r.m, r.p30, r.p95, r.least, r.most], np.quantile(np.array(groups[k], float), list(QUANTILES.values())), rtol=1e-15, atol=0)
    whole = spark.createDataFrame([("k", 2**62 + i) for i in range(50)], "k string, v long")
    assert radix(spark, whole, "v", least).first()["most"] == float(2**62 + 49)
    assert radix(spark, whole.limit(0), "v", least).count() == 0


def test_sortable_bits_order_as_values(spark):
    values = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").withColumn("u", sequence.sortable_bits(F.col("v"), "double"))
    assert [r.i for r in frame.orderBy("u").collect()] == list(range(len(values)))
    assert spark.range(1).select(sequence.sortable_bits(F.lit(-0.0), "double") == sequence.sortable_bits(F.lit(0.0), "double")).first()[0]


def test_small_quantiles_and_scans_start_no_job_of_their_own(spark):
    frame = cut(spark.range(2000).selectExpr("id % 3 as k", "cast(id * 7919 % 911 as double) as v"))
    lazy, n = jobs_of(spark, lambda: exact_quantiles(frame, ["k"], "v", QUANTILES))
    assert n == 0
    _, n = jobs_of(spark, lambda: sequence.numbered(sequence.ordered(frame, ["k"], ["v"]), "rn").plain())
    assert n == 0
    rows, n = jobs_of(spark, lazy.collect)
    assert len(rows) == 3 and n <= 3


# ---- centres and rectangles

@pytest.mark.parametrize("block", [4, 40])
def test_nearest_centers_against_brute_force(spark, block):
    rng = np.random.default_rng(11)
    groups = rng.normal(size=(12, 6)) * 20
    centers = np.concatenate([groups[i] + rng.normal(size=(40, 6)) for i in range(12)] + [np.repeat(groups[:1], 30, axis=0)])
    points = np.concatenate([groups[rng.integers(0, 12, 200)] + rng.normal(size=(200, 6)), centers[:20]])
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centers)], "center_id int, center array<double>").repartition(4)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "p int, f array<double>").repartition(4)
    found = geometry.nearest_center(p, c, "p", "f", block=block, report=True).collect()
    square = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
    assert {r.p: r.center_id for r in found} == dict(enumerate(square.argmin(axis=1).tolist()))
    assert np.allclose([r.distance for r in sorted(found)], np.sqrt(square.min(axis=1)))
    rings, _ = geometry.center_blocks(c, block)
    if block == 4:  # most blocks cannot win and are not visited
        assert np.mean([r.blocks for r in found]) < 0.25 * rings.count()


def plain_overlap(a, b):
    return a[0] < b[0] + b[2] and a[0] + a[2] > b[0] and a[1] < b[1] + b[3] and a[1] + a[3] > b[1]


def test_overlap_of_rectangles_of_all_sizes(spark):
    rng = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            size = 2 ** rng.randrange(0, 21)
            out.append((i, rng.choice("ab"), rng.randrange(-2000, 10**6), rng.randrange(-2000, 10**6), rng.randrange(1, size + 1), rng.randrange(1, size + 1)))
        return out

    boxes, regions = some(300), some(120) + [(0, "a", 0, 0, 64, 64)]
    schema = "id int, clip string, left int, top int, width int, height int"
    c, r = spark.createDataFrame(boxes, schema), spark.createDataFrame(regions, schema)
    found = {x.id: x.in_scope for x in geometry.region_overlap(c, r, "clip", ["id"]).collect()}
    assert found == {b[0]: any(b[1] == g[1] and plain_overlap(b[2:], g[2:]) for g in regions) for b in boxes} and len(set(found.values())) == 2
    huge = spark.createDataFrame([(1, "a", 5, 5, 10**6, 10**6)], schema)
    assert geometry._cells(geometry._levels(huge, 64), 64, [0, 3, 14, 15, 20]).count() <= 12


# ---- cycles

def test_a_long_clip_scores_few_tiles_of_equal_size(spark):
    """A walk far from itself but for one return: most tiles cannot win."""
    rng = np.random.default_rng(6)
    steps = np.cumsum(rng.normal(size=(5000, 8)) * 0.05 + 0.1, axis=0)
    steps[4000:4400] = steps[1000:1400] + 1e-4
    frames = spark.createDataFrame([("long", i, x.tolist()) for i, x in enumerate(steps)], "clip string, i long, f array<double>").repartition(8)
    stats = motion.frame_statistics(frames, "clip", "i", "f")
    clips = stats.groupBy("clip").agg(F.max("n").alias("n"), F.max("least_frames").alias("least_frames")).withColumn("width", F.lit(0.2))
    tiles = motion.cycle_tiles(motion.cycle_blocks(stats.where("i > 0 and i < n - 1")), clips).groupBy().agg(F.count("*").alias("n"), F.count_if("may_win").alias("kept")).first()
    assert tiles.n == 79 * 80 // 2 and tiles.kept < 0.1 * tiles.n
    best = motion.cycle_candidates(stats, keep=20).where("rank > 0").collect()
    assert len(best) == 20 and any(abs(r.end_frame - r.start_frame - 3000) < 5 for r in best) or min(r.frame_count for r in best) >= 3


# ---- reviews

def test_keyframe_sets_meet_sequences_on_their_rarest_frame(spark):
    rows = [("p", 900, 0, "canonical", ["c"])]
    rows += [("p", i, 1 + i, "set", ["c", "shared", f"f{i}"]) for i in range(30)] + [("p", 100 + i, 100 + i, "sequence", ["c", "shared", f"f{i}", f"g{i}"]) for i in range(30)]
    rows += [("p", 777, 300, "set", ["c", "shared", "f5"])]
    names = dict(zip(("canonical", "set", "sequence"), reviews.GATE_RANK))
    rows = [(*r[:3], names[r[3]], r[4]) for r in rows]
    frame = spark.createDataFrame(rows, "package string, id long, declared_order int, gate string, subject_ids array<string>")
    found = {(r.id, r.code) for r in reviews.gate_order_audit(frame, "package").collect()}
    assert {i for i, code in found if code == "keyframes-not-before-sequence"} == {105}


# ---- reports and documents

def test_a_report_is_replaced_at_once_or_not_at_all(spark):
    path = scratch_path(spark, "report")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    files.write_report(first, path)
    read = lambda: sorted(tuple(r) for r in files.read_report(spark, path, "n int, t string").collect())
    assert read() == [(1, "a"), (2, "b")]
    dies = spark.range(2000).repartition(4).selectExpr("cast(id as int) as n", "if(id = 1777, raise_error('killed'), 'x') as t")
    with pytest.raises(Exception, match="killed"):
        files.write_report(dies, path)
    assert read() == [(1, "a"), (2, "b")]
    files.write_report(first.where("n = 2"), path)
    assert read() == [(2, "b")]
    files.write_report(first.limit(0), path)
    assert read() == []
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    left = [x.getPath().getName() for x in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    assert len([x for x in left if x.startswith("version-")]) == 1  # what the killed job left went with the next one


def test_an_oversized_document_is_not_read(spark, tmp_path):
    (tmp_path / "small.json").write_text('{"a": 1}')
    (tmp_path / "list.json").write_text("[1]")
    with (tmp_path / "large.json").open("wb") as sparse:
        sparse.truncate(3 << 31)  # 6 GB of holes: a row could not hold it
    found = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path), "a int").collect()}
    assert found["large.json"].error == "too large" and found["large.json"].raw is None and found["large.json"].bytes == 3 << 31
    assert found["small.json"].document.a == 1 and found["list.json"].error == "not an object"


# ---- typed values

def test_values_are_told_by_how_they_are_written(spark):
    from proofline.operators.contracts import ValueRule, value_domain_audit

    good = '{"a": {"n": 3, "s": "x"}, "b": [0, 0, 4, 4], "e": "on", "l": [1], "p": [-1, 2], "t": true}'
    rules = [ValueRule("a.n", "integer", minimum=1, maximum=9), ValueRule("a.s", "string"), ValueRule("b", "box"), ValueRule("e", "enum", domain=("on", "off")),
             ValueRule("l", "array", minimum=1, maximum=2), ValueRule("p", "point"), ValueRule("t", "boolean"), ValueRule("a", "string")]
    every = [r.path for r in rules]
    texts = {
        good: ["a"], None: every, "": every, "[]": every, good + " {}": every, good.replace('"e"', '"t"'): every, '{"a": NaN}': every,
        good.replace(": 3", ": 3.0"): ["a.n", "a"], good.replace(": 3", ": true"): ["a.n", "a"], good.replace(": 3", ": 10"): ["a.n", "a"],
        good.replace(": 3", ": 99999999999999999999"): ["a.n", "a"], good.replace("[0, 0, 4, 4]", "[0, 0, 5, 4]"): ["b", "a"], good.replace("[-1, 2]", "[-1, 2.0]"): ["p", "a"],
        good.replace("[-1, 2]", "[-1, null]"): ["p", "a"], good.replace('"on"', "1"): ["e", "a"], good.replace("[1]", "[]"): ["l", "a"], good.replace("true", '"true"'): ["t", "a"],
        good.replace('{"n": 3, "s": "x"}', '"own"'): ["a.n", "a.s"],
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, raw string, breaches string").drop("breaches")
    found = {r.raw: r.breaches for r in value_domain_audit(docs, "raw", rules, canvas=(4, 4)).collect()}
    assert found == texts
