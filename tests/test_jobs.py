"""Job protocol in batch, stream and plain Python; task graphs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from proofline.functions.protocol import FIRST_PHASE, KEYFRAMES_ONLY, STEPS, answer, checkpoint_id, context_hash
from proofline.operators import jobs
from proofline.streaming import jobs as live

FIELDS = "job bigint, event_id bigint, ts timestamp, kind string, gate string, decision string, return_to string, checkpoint_id string, job_revision bigint, context_sha256 string"


def random_responses(seed, n_jobs=6, n=60, version="v1"):
    """Mostly plausible answers, with stale, early, repeated and wrong ones mixed in."""
    rng = random.Random(seed)
    rows, event = [], 0
    for job in range(n_jobs):
        phase, revision = FIRST_PHASE, 1
        for _ in range(n if job else n * 5):
            event += 1
            fitting = [s for s in STEPS[version] if s.phase == phase] or STEPS[version]
            step = rng.choice(fitting if rng.random() < 0.7 else STEPS[version])
            bound = max(1, revision + rng.choice([0, 0, 0, 0, 1, -1, 2]))
            row = dict(job=job, event_id=event, ts=None, kind=step.kind, gate=step.gate, decision=step.decision, return_to=step.return_to,
                       checkpoint_id=checkpoint_id(job, bound) if rng.random() < 0.95 else "cp-x", job_revision=bound, context_sha256=context_hash(job, bound) if rng.random() < 0.9 else "x")
            phase, revision, _ = answer(version, job, phase, revision, row)
            rows.append(row)
    return rows


def plain_fold(rows, version):
    states, out = {}, []
    for row in sorted(rows, key=lambda r: r["event_id"]):
        phase, revision = states.get(row["job"], (FIRST_PHASE, 1))
        phase, revision, status = answer(version, row["job"], phase, revision, row)
        states[row["job"]] = (phase, revision)
        out.append((row["job"], row["event_id"], status, phase, revision))
    return sorted(out)


def as_frame(spark, rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FIELDS)


def test_parallel_fold_equals_the_sequential_one(spark):
    for version, seed in (("v1", 1), ("v1", 2), ("v2", 3), (KEYFRAMES_ONLY, 4)):
        rows = random_responses(seed, version=version)
        got = sorted(tuple(r) for r in jobs.checkpoint_fold(as_frame(spark, rows), version).collect())
        assert got == plain_fold(rows, version)
        assert sum(r[2] == "applied" for r in got) > 20


def test_stream_in_two_batches_equals_batch(spark, tmp_path):
    rows = random_responses(5, n_jobs=3)
    df = as_frame(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    middle = max(r["event_id"] for r in rows) // 2
    for part in (df.where(F.col("event_id") <= middle), df.where((F.col("event_id") > middle) | (F.col("event_id") % 7 == 0))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(live.RESPONSE_SCHEMA).parquet(f"{tmp_path}/in")
        live.run_to_end(live.checkpoint_fold_stream(stream.dropDuplicates(["event_id"])), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == plain_fold(rows, "v1")


def full_script(job, last=None):
    script = [s for s in STEPS["v1"] if s.decision != "changes-requested"]
    return [dict(job=job, event_id=job * 100 + i, ts=None, kind=s.kind, gate=s.gate, decision=s.decision, return_to="", checkpoint_id=checkpoint_id(job, i), job_revision=i,
                 context_sha256=context_hash(job, i)) for i, s in enumerate(script, 1)][:last]


def state_keys(spark, checkpoint, variable):
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    return sorted(r[0] for r in reader.load().select("key.job").collect())


def test_a_late_first_delivery_counts_and_repeats_commit_nothing(spark, tmp_path):
    rows = full_script(1)
    # each delivery is a year older than the one before; every second one comes twice
    df = as_frame(spark, rows).withColumn("ts", F.timestamp_seconds(F.lit(8_000_000_000) - F.col("event_id") * 31_536_000))
    for n, part in enumerate((df.where("event_id <= 104"), df.where("event_id > 104 or event_id % 2 = 0"))):
        part.withColumn("delivery", F.col("event_id") * 2 + n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(live.RESPONSE_SCHEMA + ", delivery bigint").parquet(f"{tmp_path}/in")
        live.run_to_end(live.stale_responses_stream(stream), f"{tmp_path}/once", f"{tmp_path}/state-once")
        live.run_to_end(live.checkpoint_fold_stream(stream), f"{tmp_path}/all", f"{tmp_path}/state-all")
    for folder, second in (("once", "duplicate"), ("all", "stale")):
        found = spark.read.parquet(f"{tmp_path}/{folder}").groupBy("status").count().collect()
        assert {r["status"]: r["count"] for r in found} == {"applied": len(rows), second: 2}


def test_state_is_that_of_open_jobs_and_survives_a_restart(spark, tmp_path):
    first = full_script(1) + full_script(2, 4) + full_script(3, 1)
    second = full_script(1)[:1] + full_script(2)[3:] + full_script(3)[:3]  # the first of 1, the fourth of 2 and the first of 3 come again

    def deliver(rows, keep):
        as_frame(spark, rows).withColumn("delivery", F.col("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(live.RESPONSE_SCHEMA + ", delivery bigint").parquet(f"{tmp_path}/in")
        live.run_to_end(live.stale_responses_stream(stream, keep=keep), f"{tmp_path}/out", f"{tmp_path}/state")

    deliver(first, live.KEEP)
    assert state_keys(spark, f"{tmp_path}/state", "open") == [2, 3] and state_keys(spark, f"{tmp_path}/state", "finished") == [1]
    deliver(second, live.KEEP)  # a new run of the stream, from its checkpoint
    assert state_keys(spark, f"{tmp_path}/state", "open") == [3] and state_keys(spark, f"{tmp_path}/state", "finished") == [1, 2]
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.job, r.event_id) for r in out if r.status == "duplicate"} == {(1, 101), (2, 204), (3, 301)}
    assert sum(r.status == "applied" for r in out) == len(first + second) - 3 == len(out) - 3


def test_finished_jobs_are_forgotten(spark, tmp_path):
    for n in range(2):
        as_frame(spark, full_script(1) + full_script(2 + n, 2)).withColumn("delivery", F.col("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(live.RESPONSE_SCHEMA + ", delivery bigint").parquet(f"{tmp_path}/in")
        live.run_to_end(live.stale_responses_stream(stream, keep=1), f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in out} == {"applied": 2 * len(full_script(1)) + 4}
    assert state_keys(spark, f"{tmp_path}/state", "open") == [2, 3]


def test_retention_by_version(spark):
    names = [("output", "motion_plan"), ("output", "motion_blueprints"), ("output", "raw_frame_admissions"), ("approval", "motion-plan"), ("plan", "spacing_plan")]
    rows = [(v, 3, route, *part) for v in ("v1", "v2") for route in ("keyframes", "sequence", "nowhere") for part in names]
    state = spark.createDataFrame(rows, "protocol string, material_revision int, return_to string, section string, name string")
    out = jobs.rework_retention(state).collect()
    kept = {(r["protocol"], r["return_to"], r["name"]) for r in out if r["kept"]}
    v2 = {"motion_plan", "raw_frame_admissions", "motion-plan"}
    assert kept == {("v1", route, "motion_blueprints") for route in ("keyframes", "sequence")} | {
        ("v2", route, n) for route in ("keyframes", "sequence") for n in v2} | {(v, "sequence", "spacing_plan") for v in ("v1", "v2")}
    assert {(r["return_to"], r["material_revision"]) for r in out} == {("keyframes", 4), ("sequence", 4), ("nowhere", 3)}


def test_full_history_reaches_package_ready(spark):
    script = [s for s in STEPS["v1"] if s.decision != "changes-requested"]
    rows = [dict(job=1, event_id=i, ts=None, kind=s.kind, gate=s.gate, decision=s.decision, return_to="", checkpoint_id=checkpoint_id(1, i), job_revision=i, context_sha256=context_hash(1, i))
            for i, s in enumerate(script, 1)]
    (state,) = jobs.job_states(jobs.checkpoint_fold(as_frame(spark, rows))).collect()
    assert (state["phase"], state["revision"]) == ("package-ready", len(script) + 1)


def test_repeated_delivery_commits_once(spark):
    rows = random_responses(9, n_jobs=2, n=20)
    df = as_frame(spark, rows).withColumn("delivery", F.col("event_id") * 10)
    twice = df.unionByName(df.withColumn("delivery", F.col("delivery") + 1))
    out = jobs.stale_responses(twice).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in out}["duplicate"] == len(rows)


def graph(spark, edges, nodes):
    n = spark.createDataFrame([("p", i) for i in nodes], "plan string, id string")
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "plan string, id string, depends_on string")
    return n, e


def test_waves_of_diamond_and_cycle(spark):
    nodes, edges = graph(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "y"), ("d", "ghost")], "abcdxyz")
    waves = jobs.task_waves(nodes, edges)
    assert {r["id"]: r["wave"] for r in waves.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": -1, "y": -1, "z": -1}
    deliverables = spark.createDataFrame([("p", "D", "d"), ("p", "E", "none")], "plan string, deliverable string, task_id string")
    found = {(r["subject"], r["code"]) for r in jobs.graph_findings(nodes, edges, deliverables, waves).collect()}
    assert found == {("x", "cycle"), ("y", "cycle"), ("z", "cycle"), ("ghost", "unknown-dependency"), ("x", "untraceable"),
                     ("y", "untraceable"), ("z", "untraceable"), ("z", "unconsumed"), ("E", "uncovered")}
