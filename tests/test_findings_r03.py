"""Cases of the third review."""

from __future__ import annotations

import duckdb
import numpy as np
from compare import compare
from pyspark.sql import functions as F

from proofline import plans
from proofline.operators import contracts, geometry, jobs, motion, reviews, scoring, sequence


def twin(spark, folder, name: str, **tables: str) -> str | None:
    """A query against its SQL twin on tables that DuckDB writes from the given selects."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return compare(plans.queries()[name](spark, str(folder)), con, plans.oracle_sql()[name])


def test_a_clip_without_observed_events_keeps_its_order(spark, tmp_path):
    """the only events of users 1 and 10 in a clip are missing ones (ids divisible by 37)."""
    events = """select event_id::bigint as event_id, timestamp '2024-01-01' + interval (event_id) second as ts, user_id::bigint as user_id,
        event_type, 1.0::double as value, '' as props from (values (37, 1, 'view'), (74, 10, 'view'), (111, 10, 'click'), (41, 1, 'click'), (43, 2, 'view'), (5, 20, 'view'))
        as t(event_id, user_id, event_type)"""
    assert twin(spark, tmp_path, "b31_observed_events_audit", events=events) is None


def test_cycles_of_repeated_frames_break_ties_within_and_across_areas(spark):
    """copies of frames tie by the thousand; an area passes on no more than the list is long."""
    rng = np.random.default_rng(11)
    frames = np.tile(rng.normal(size=(15, 5)), (8, 1))
    rows = spark.createDataFrame([("copies", i, x.tolist()) for i, x in enumerate(frames)], "clip string, i long, f array<double>")
    stats = motion.frame_statistics(rows, "clip", "i", "f").cache()
    ranges = lambda found: [(r.start_frame, r.end_frame) for r in found.where("rank > 0").orderBy("rank").collect()]
    s, e = motion._side(stats, "s"), motion._side(stats, "e")
    want = ranges(motion._best(motion._scored(s.join(e, "clip").where("s_i < e_i")), 20))
    assert ranges(motion.cycle_candidates(stats, keep=20)) == want
    assert ranges(motion.cycle_candidates(stats, keep=20, area=16)) == want
    inner = stats.where("i > 0 and i < n - 1")
    clips = stats.groupBy("clip").agg(F.max("n").alias("n"), F.max("typical").alias("typical"), F.max("least_frames").alias("least_frames")).withColumn("bound", F.lit(1e300))
    areas = spark.createDataFrame([("copies", 0, 0)], "clip string, first long, second long")
    assert motion._area_winners(areas, inner, clips, 20, 2048).count() == 20


def test_outputs_are_not_dealt_by_case(spark):
    """four cases hold all outputs, so a shuffle by case reads most texts in one task."""
    outputs = spark.range(40).selectExpr("id", "if(id % 2 = 0, 'en', if(id % 3 = 0, null, 'fr')) as case_id", "repeat('the ', 1 + cast(id as int)) as output")
    cases = spark.sql("select case_id, array('the') as must, array('of') as must_not from values ('en'), ('it'), (cast(null as string)) as t(case_id)")
    checked = scoring.must_checks(outputs, cases)
    found = checked.groupBy("status", "passed").count().collect()
    assert {(r.status, r.passed, r["count"]) for r in found} == {("judged", True, 20), ("no case", False, 20), ("no output", False, 2)}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "BroadcastHashJoin" in plan


def test_reviews_are_joined_to_hashes_without_their_maps(spark):
    """scopes meet in one aggregate, and rows of the joins hold one hash of 32 bytes; other texts and nulls compare as before."""
    kind = "package int, id long, gate string, subject_ids array<string>, subject_sha256 map<string,string>, declared_order int"
    sha = "ab" * 32
    rows = [(1, 1, "g", ["a"], {"a": sha}, 1), (1, 2, None, ["b"], {"b": sha.upper()}, 2), (1, 3, "h", ["c"], {}, 3), (1, 4, "h", ["d"], {"d": "zz"}, 4)]
    current = [(1, "a", sha), (1, "b", sha), (1, "d", "zz")]
    wanted = spark.createDataFrame([(1, "g", ["a"]), (1, None, ["b"]), (1, "x", ["a"])], "package int, gate string, subject_ids array<string>")
    out = reviews.review_scope_audit(spark.createDataFrame(rows, kind), wanted, spark.createDataFrame(current, "package int, subject_id string, sha256 string"), "package")
    assert sorted((r.id, r.code) for r in out.collect()) == [(-1, "missing"), (-1, "missing"), (2, "stale"), (2, "unexpected"), (3, "unexpected"), (4, "unexpected")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def test_samples_are_counted_before_they_are_joined(spark):
    """three keys hold all samples; equal samples are one row, and none is shuffled by key alone."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') as flag", "id % 7 as a", "cast(id % 5 as double) as b")
    doubled = sequence.exact_quantiles(spark.sql("select 'k' as k, v, v as w from values (1L), (2L), (3L) as t(v)"), ["k"], "v", {"q": 0.5}, weight="w")
    assert doubled.first().q == 2.5
    out = geometry.dominant_bin(rows, ["flag"], ["a", "b"], 20.0)
    got = {r.flag: (r.samples, r.members, round(r.centre_a, 6), round(r.centre_b, 6), r.confidence) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 1000, "b": 2000} and all(v[1] == v[0] and v[4] == 1.0 for v in got.values())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_w" in plan and out.inputFiles() and not any("Range" in line for line in plan.splitlines())


def test_task_graphs_are_not_broadcast(spark):
    """F6, F8: every join side is about as large as the graph and must not pass through the driver."""
    nodes = spark.range(40).selectExpr("1 as plan", "id")
    edges = nodes.where("id > 0").selectExpr("plan", "id", "id div 2 as depends_on")
    waves = jobs.task_waves(nodes, edges)
    found = jobs.graph_findings(nodes, edges, nodes.where("id > 20").selectExpr("plan", "'d' as deliverable", "id as task_id"), waves)
    assert waves.agg(F.max("wave")).first()[0] == 6
    assert all("Broadcast" not in x._jdf.queryExecution().executedPlan().toString() for x in (waves, found))


def test_documents_share_one_decoder(monkeypatch):
    """a decoder made for each document took a quarter of the time."""
    monkeypatch.setattr(contracts.json, "JSONDecoder", None)
    assert contracts.flattened('{"a":{"b":1}}', frozenset(["a", "a.b"])) == {"a": {"b": 1}, "a.b": 1}
    assert contracts.flattened('{"a":1,"a":2}', frozenset(["a"])) == {} == contracts.flattened('{"a":NaN}', frozenset(["a"]))
    assert contracts._whole(10**38 - 1) and not contracts._whole(-(10**38)) and not contracts._whole(True)
