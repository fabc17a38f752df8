"""Task graphs, logs and job protocol over part, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.hashing import canonical_sha256, sha256
from proofline.functions.protocol import KEYFRAMES_ONLY, PACKAGE_STATES, PHASES, PROTOCOL, STEPS, checkpoint_name, context_text
from proofline.operators import jobs as ops
from proofline.operators.sequence import numbered, ordered, scan
from proofline.plans.registry import Registry
from proofline.plans.tracks import micros
from proofline.session import load, scratch_path
from proofline.streaming import jobs as live

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def task_graph(spark: SparkSession, d: str):
    """Parts as tasks of four plans; plan 3 holds cycles, every plan some loose ends."""
    tasks = load(spark, d, "part").select((F.col("p_partkey") % 4).alias("plan"), F.expr("div(p_partkey, 4)").alias("id"), "p_size")
    edges = tasks.where("id > 0").select("plan", "id", F.expr("div(id, 2)").alias("depends_on")).union(
        tasks.where("id > 2").select("plan", "id", F.expr("div(id, 3)"))).union(
        tasks.where("plan = 3 and id % 50 = 7").select("plan", "id", F.expr("id * 2"))).union(
        tasks.where("id % 97 = 5").select("plan", "id", F.expr("id + 1000000")))
    deliverables = tasks.where("p_size > 40").select("plan", F.expr("concat('d', id)").alias("deliverable"), F.col("id").alias("task_id")).union(
        tasks.where("id % 101 = 3").select("plan", F.expr("concat('lost', id)"), F.expr("-1L")))
    return tasks.select("plan", "id"), edges, deliverables


GRAPH = """
    with recursive t as (select p_partkey % 4 as plan, p_partkey // 4 as id, p_size from part),
    e0 as (select distinct plan, id, dep from (
      select plan, id, id // 2 as dep from t where id > 0 union all select plan, id, id // 3 from t where id > 2
      union all select plan, id, id * 2 from t where plan = 3 and id % 50 = 7 union all select plan, id, id + 1000000 from t where id % 97 = 5)),
    e as (select e0.* from e0 join t on t.plan = e0.plan and t.id = e0.dep),
    cl as (select plan, id, dep from e union select c.plan, c.id, e.dep from cl c join e on e.plan = c.plan and e.id = c.dep),
    cy as (select distinct plan, id from cl where id = dep),
    bad as (select plan, id from cy union select cl.plan, cl.id from cl join cy on cy.plan = cl.plan and cy.id = cl.dep),
    good as (select plan, id from t except select plan, id from bad),
    w as (select g.plan, g.id, 0 as wave from good g where not exists (select 1 from e where e.plan = g.plan and e.id = g.id)
          union select e.plan, e.id, w.wave + 1 from w join e on e.plan = w.plan and e.dep = w.id join good g on g.plan = e.plan and g.id = e.id),
    wv as (select plan, id, cast(max(wave) as bigint) as wave from w group by 1, 2 union all select plan, id, -1 from bad)"""


@R.add("f01_task_waves", GRAPH + "select plan, id, wave from wv")
def f01(spark, d):
    nodes, edges, _ = task_graph(spark, d)
    return ops.task_waves(nodes, edges)


@R.add("f01_graph_findings", GRAPH + """,
    dl as (select plan, 'd' || id as deliverable, id as task from t where p_size > 40 union all select plan, 'lost' || id, -1 from t where id % 101 = 3),
    tr as (select plan, task as id from dl where task >= 0 union select cl.plan, cl.dep from cl join dl on dl.plan = cl.plan and dl.task = cl.id)
    select plan, cast(id as varchar) as subject, 'cycle' as code from bad
    union all select distinct plan, cast(dep as varchar), 'unknown-dependency' from e0 where not exists (select 1 from t where t.plan = e0.plan and t.id = e0.dep)
    union all select plan, cast(id as varchar), 'untraceable' from (select plan, id from t except select plan, id from tr)
    union all select plan, cast(id as varchar), 'unconsumed' from (select plan, id from t except select plan, dep from e except select plan, task from dl)
    union all select distinct plan, deliverable, 'uncovered' from dl where task = -1""")
def f01_findings(spark, d):
    nodes, edges, deliverables = task_graph(spark, d)
    return ops.graph_findings(nodes, edges, deliverables, ops.task_waves(nodes, edges))


def transition_log(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a state log: each state twice, some blocked, some without a time."""
    ev = load(spark, d, "events").select("user_id", "event_id", micros().alias("us"))
    rows = numbered(ordered(ev, ["user_id"], ["us", "event_id"]), "rn").plain()
    names = F.array(*[F.lit(s) for s in PACKAGE_STATES])
    state = F.when(F.col("event_id") % 17 == 0, "blocked").when(F.col("event_id") % 71 == 0, "paused").otherwise(
        F.element_at(names, F.least(F.lit(8), F.expr("div(rn - 1, 2) + 1")).cast("int")))
    return rows.select(F.col("user_id").alias("package"), F.col("rn").alias("seq"), state.alias("state"),
                       F.when(F.col("event_id") % 23 != 0, F.timestamp_micros("us")).alias("at"))


LOG = """
    with n as (select user_id as package, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events),
    s as (select package, seq, event_id % 23 = 0 as untimed, case when event_id % 17 = 0 then 'blocked' when event_id % 71 = 0 then 'paused' else
            list_extract(['initialized', 'probed', 'source-selected', 'source-acquired', 'corrected', 'translated', 'chaptered', 'complete'], least(8, (seq - 1) // 2 + 1)) end as state from n),
    b as (select *, lag(state) over (partition by package order by seq) as was,
            coalesce(list_position(['initialized', 'probed', 'source-selected', 'source-acquired', 'corrected', 'translated', 'chaptered', 'complete'], state), 0) as here from s),
    c as (select *, coalesce(list_position(['initialized', 'probed', 'source-selected', 'source-acquired', 'corrected', 'translated', 'chaptered', 'complete'], was), 0) as last from b),
    r as (select package, seq, case when was = state then 'collapsed' when here = 0 and state <> 'blocked' then 'unknown-state'
                 when was is null then case when state <> 'initialized' then 'wrong-start' end when was in ('blocked', 'complete') then 'after-terminal'
                 when state = 'blocked' then null when last = 0 or here <> last + 1 then 'illegal-transition' end as code,
                 case when untimed and was is distinct from state then 'missing-time' end as time_code from c)
    select package, seq, code from r where code is not null union all select package, seq, time_code from r where time_code is not null"""


@R.add("f02_transition_log_audit", LOG)
def f02(spark, d):
    return ops.transition_log_audit(transition_log(spark, d), "package", "seq", "state", "at")


@R.add("f02_transition_stream", LOG)
def f02_stream(spark, d):
    root = scratch_path(spark, "transitions")
    transition_log(spark, d).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("package bigint, seq bigint, state string, at timestamp").parquet(f"{root}/in")
    live.run_to_end(live.transition_audit_stream(stream), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


# A production history with rework, as (kind, gate, decision, return_to).
SCRIPT = (
    ("review", "canonical", "approved", ""), ("review", "motion-blueprint", "approved", ""), ("input", "keyframes", "", ""),
    ("review", "keyframe-set", "changes-requested", ""), ("input", "keyframes", "", ""), ("review", "keyframe-set", "approved", ""),
    ("input", "spacing-plan", "", ""), ("review", "spacing-plan", "approved", ""), ("input", "sequence", "", ""),
    ("review", "sequence", "approved", ""), ("review", "package", "changes-requested", "keyframes"), ("input", "keyframes", "", ""),
    ("review", "keyframe-set", "approved", ""), ("input", "spacing-plan", "", ""), ("review", "spacing-plan", "approved", ""),
    ("input", "sequence", "", ""), ("review", "sequence", "changes-requested", ""), ("input", "sequence", "", ""),
    ("review", "sequence", "approved", ""), ("review", "package", "approved", ""),
)
SCRIPT_FIELDS = ("kind", "gate", "decision", "return_to")
# Histories under the second version: even jobs have in-between positions, odd ones have none.
SCRIPT_V2 = (
    ("review", "canonical", "approved", ""), ("review", "motion-plan", "approved", ""), ("input", "keyframes", "", ""),
    ("review", "keyframe-set", "changes-requested", ""), ("input", "keyframes", "", ""), ("review", "keyframe-set", "approved", ""),
    ("input", "sequence", "", ""), ("review", "sequence", "approved", ""), ("review", "package", "changes-requested", "keyframes"),
    ("input", "keyframes", "", ""), ("review", "keyframe-set", "approved", ""), ("input", "sequence", "", ""),
    ("review", "sequence", "changes-requested", ""), ("input", "sequence", "", ""), ("review", "sequence", "approved", ""),
    ("review", "package", "approved", ""),
)
SCRIPT_KEYFRAMES_ONLY = (
    ("review", "canonical", "approved", ""), ("review", "motion-plan", "approved", ""), ("input", "keyframes", "", ""),
    ("review", "keyframe-set", "approved", ""), ("review", "sequence", "changes-requested", ""), ("input", "sequence", "", ""),
    ("review", "sequence", "approved", ""), ("review", "package", "changes-requested", "keyframes"), ("input", "keyframes", "", ""),
    ("review", "keyframe-set", "approved", ""), ("review", "sequence", "approved", ""), ("review", "package", "approved", ""),
)


def job_responses(spark: SparkSession, d: str, scripts=(SCRIPT,)) -> DataFrame:
    """Events of a user as responses: the user's script (by id), interleaved with noise of four kinds; wrong bindings miss the context or the checkpoint."""
    ev = load(spark, d, "events").select(
        F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.expr("event_id % 4 = 0"), F.lit(0)).otherwise(1).cast("bigint").alias("_real"))
    steps = scan(ordered(ev, ["job"], ["event_id"]), before_sum={"_done": "_real"}).plain()
    lines = [F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, SCRIPT_FIELDS)]) for row in script]) for script in scripts]
    of_job = F.element_at(F.array(*lines), (F.col("job") % len(scripts) + 1).cast("int"))
    rows = steps.withColumn("_script", of_job).withColumn("_s", F.element_at("_script", (F.col("_done") % F.size("_script") + 1).cast("int")))
    noise, which = F.col("_real") == 0, F.expr("div(event_id, 4) % 4")
    revision = F.col("_done") + 1 - F.when(noise & (which == 0), 1).otherwise(0)
    bound = sha256(context_text(F.col("job"), revision))
    other, lost = noise & (which == 1), F.expr("div(event_id, 16) % 2 = 0")
    return rows.select(
        "job", "event_id", "ts",
        F.when(noise & (which == 2), F.expr("if(_s.kind = 'input', 'review', 'input')")).otherwise(F.col("_s.kind")).alias("kind"),
        F.when(noise & (which == 3), F.lit("unknown")).otherwise(F.col("_s.gate")).alias("gate"),
        F.col("_s.decision").alias("decision"), F.col("_s.return_to").alias("return_to"), F.when(other & ~lost, F.lit("cp-0-gone")).otherwise(checkpoint_name(F.col("job"), revision)).alias("checkpoint_id"),
        revision.cast("bigint").alias("job_revision"), F.when(other & lost, F.lit("0" * 64)).otherwise(bound).alias("context_sha256"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _fold_sql(tables, scripts) -> str:
    """The sequential fold; the n-th table and script hold for jobs whose id leaves n."""
    steps = [(n, *row) for n, table in enumerate(tables) for row in table]
    lines = [(n, len(script), i, *row) for n, script in enumerate(scripts) for i, row in enumerate(script)]
    return f"""
    with recursive tr(v, p, kind, gate, decision, return_to, nxt) as (values {_values(steps)}),
    sc(v, size, i, kind, gate, decision, return_to) as (values {_values(lines)}),
    ev as (select user_id as job, event_id, event_id % 4 = 0 as noise, event_id // 4 % 4 as which,
                  row_number() over (partition by user_id order by event_id) as rn,
                  coalesce(sum(case when event_id % 4 = 0 then 0 else 1 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as done
           from events),
    rs as (select job, event_id, rn, case when noise and which = 2 then case when sc.kind = 'input' then 'review' else 'input' end else sc.kind end as kind,
                  case when noise and which = 3 then 'unknown' else sc.gate end as gate, sc.decision, sc.return_to,
                  done + 1 - case when noise and which = 0 then 1 else 0 end as rev, not (noise and which = 1) as bound
           from ev join sc on sc.v = job % {len(scripts)} and sc.i = done % sc.size),
    st as (
      select job, cast(0 as bigint) as rn, cast(-1 as bigint) as event_id, 'awaiting-canonical-review' as phase, cast(1 as bigint) as revision, '' as status
      from (select distinct job from rs)
      union all
      select rs.job, rs.rn, rs.event_id, case when ok then tr.nxt else s.phase end, s.revision + case when ok then 1 else 0 end,
             case when ok then 'applied' when rs.rev <> s.revision or not rs.bound then 'stale'
                  when rs.kind <> case when s.phase like '%-input' then 'input' when s.phase like '%-review' then 'review' else 'none' end then 'kind-mismatch' else 'invalid' end
      from st s join rs on rs.job = s.job and rs.rn = s.rn + 1
           left join tr on tr.v = rs.job % {len(tables)} and tr.p = s.phase and tr.kind = rs.kind and tr.gate = rs.gate and tr.decision = rs.decision and tr.return_to = rs.return_to,
           lateral (select rs.rev = s.revision and rs.bound and tr.nxt is not null as ok) z)"""


FOLD = _fold_sql([[(s.phase, s.kind, s.gate, s.decision, s.return_to, s.then) for s in STEPS["v1"]]], [SCRIPT])
# The second version, written out: what follows an approval, a request for changes and an input.
_BOTH_V2 = [
    ("awaiting-canonical-review", "review", "canonical", "approved", "", "awaiting-motion-plan-review"),
    ("awaiting-canonical-review", "review", "canonical", "changes-requested", "", "awaiting-canonical-review"),
    ("awaiting-motion-plan-review", "review", "motion-plan", "approved", "", "awaiting-keyframe-input"),
    ("awaiting-motion-plan-review", "review", "motion-plan", "changes-requested", "", "awaiting-motion-plan-review"),
    ("awaiting-keyframe-input", "input", "keyframes", "", "", "awaiting-keyframe-review"),
    ("awaiting-keyframe-review", "review", "keyframe-set", "changes-requested", "", "awaiting-keyframe-input"),
    ("awaiting-sequence-input", "input", "sequence", "", "", "awaiting-sequence-review"),
    ("awaiting-sequence-review", "review", "sequence", "approved", "", "awaiting-package-review"),
    ("awaiting-sequence-review", "review", "sequence", "changes-requested", "", "awaiting-sequence-input"),
    ("awaiting-package-review", "review", "package", "approved", "", "package-ready"),
    ("awaiting-package-review", "review", "package", "changes-requested", "keyframes", "awaiting-keyframe-input"),
    ("awaiting-package-review", "review", "package", "changes-requested", "sequence", "awaiting-sequence-input"),
]
_APPROVED_SET = ("awaiting-keyframe-review", "review", "keyframe-set", "approved", "")
FOLD_V2 = _fold_sql(
    [[*_BOTH_V2, (*_APPROVED_SET, "awaiting-sequence-input")], [*_BOTH_V2, (*_APPROVED_SET, "awaiting-sequence-review")]], [SCRIPT_V2, SCRIPT_KEYFRAMES_ONLY])


@R.add("f03_checkpoint_fold", FOLD + "select job, event_id, status, phase, revision from st where rn > 0")
def f03(spark, d):
    return ops.checkpoint_fold(job_responses(spark, d))


def responses_v2(spark: SparkSession, d: str) -> DataFrame:
    return job_responses(spark, d, (SCRIPT_V2, SCRIPT_KEYFRAMES_ONLY)).withColumn(PROTOCOL, F.when(F.col("job") % 2 == 0, "v2").otherwise(KEYFRAMES_ONLY))


@R.add("f03_checkpoint_fold_v2", FOLD_V2 + "select job, event_id, status, phase, revision from st where rn > 0")
def f03_v2(spark, d):
    return ops.checkpoint_fold(responses_v2(spark, d), "v2")


@R.add("f03_checkpoint_stream", FOLD + "select job, event_id, status, phase, revision from st where rn > 0")
def f03_stream(spark, d):
    root = scratch_path(spark, "responses")
    job_responses(spark, d).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(live.RESPONSE_SCHEMA).parquet(f"{root}/in")
    live.run_to_end(live.checkpoint_fold_stream(stream), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@R.add("f03_job_states", FOLD + """
    select job, arg_max(phase, rn) as phase, max(revision) as revision, count(*) filter (status = 'applied') as applied from st where rn > 0 group by 1""")
def f03_states(spark, d):
    return ops.job_states(f03(spark, d))


@R.add("f04_stale_responses", FOLD + """
    select job, event_id, event_id * 2 as delivery, status from st where rn > 0
    union all select job, event_id, event_id * 2 + 1, 'duplicate' from st where rn > 0 and event_id % 5 = 0""")
def f04(spark, d):
    once = job_responses(spark, d).withColumn("delivery", F.col("event_id") * 2)
    again = once.where("event_id % 5 = 0").withColumn("delivery", F.col("delivery") + 1)
    return ops.stale_responses(once.unionByName(again))


@R.add("f05_change_scope", """
    with v as (select o_custkey as job, o_orderkey, '{"clip_bindings":"' || (o_orderkey % 40 < 2) || '","clips":"' || substr(o_orderpriority, 1, 1)
                 || '","identity":"' || o_custkey || '","output_scope":"' || (o_orderkey % 3) || '","rendering_profile":"p","runtime_scope":"' || (o_orderkey % 2)
                 || '","source_bindings":"' || (o_orderkey // 32 % 9 = 4) || '","target":"' || case when o_orderkey % 9 = 0 then 'x' else 'y' end || '"}' as j, substr(o_orderpriority, 1, 1) as clips,
                 o_orderkey % 40 < 2 as bind, o_orderkey % 9 = 0 as target, o_orderkey // 32 % 9 = 4 as src, o_orderkey % 3 as outp, o_orderkey % 2 as run from orders),
    l as (select *, lag({'j': j, 'c': clips, 'b': bind, 't': target, 's': src, 'o': outp, 'r': run}) over (partition by job order by o_orderkey) as w from v)
    select job, o_orderkey, sha256(j) as material_sha256, case when w is null then 'new' when w.j = j then 'unchanged'
       when w.b <> bind or w.t <> target or w.s <> src then 'restart' when w.c <> clips then 'motion-review' when w.o <> outp or w.r <> run then 'package-review' else 'revision-only' end as scope
    from l""")
def f05(spark, d):
    versions = load(spark, d, "orders").select(
        F.col("o_custkey").alias("job"), "o_orderkey", F.col("o_custkey").alias("identity"), F.expr("if(o_orderkey % 9 = 0, 'x', 'y')").alias("target"),
        F.lit("p").alias("rendering_profile"), (F.col("o_orderkey") % 40 < 2).alias("clip_bindings"), F.expr("div(o_orderkey, 32) % 9 = 4").alias("source_bindings"),
        F.substring("o_orderpriority", 1, 1).alias("clips"),
        (F.col("o_orderkey") % 3).alias("output_scope"), (F.col("o_orderkey") % 2).alias("runtime_scope"))
    return ops.change_scope(versions, "job", "o_orderkey")


STATE_PARTS = (
    ("output", "canonical_references"), ("output", "identity_bible"), ("output", "motion_blueprints"), ("output", "spacing_plan_drafts"),
    ("output", "spacing_plans"), ("output", "sealed_delivery"), ("input", "keyframes"), ("input", "sequence"), ("approval", "canonical"),
    ("approval", "motion-blueprint"), ("approval", "keyframes"), ("approval", "spacing-plan"), ("approval", "sequence"),
    ("approval", "awaiting-package-review-changes-requested"), ("output", "motion_plan"), ("output", "raw_frame_admissions"),
    ("approval", "motion-plan"), ("plan", "spacing_plan"),
)


@R.add("f06_rework_retention", f"""
    with p(section, name) as (values {_values(STATE_PARTS)}),
    s as (select o_orderkey as job, case o_orderstatus when 'F' then 'keyframes' when 'O' then 'spacing-plan' else 'sequence' end as route,
          o_custkey % 2 = 0 as second, o_orderkey % 5 + 2 as material_revision from orders)
    select job, section, name, route as return_to, material_revision, name in ('canonical_references', 'identity_bible', 'canonical')
        or (not second and name in ('motion_blueprints', 'motion-blueprint')) or (second and name in ('motion_plan', 'raw_frame_admissions', 'motion-plan'))
        or name like '%-changes-requested' or (route in ('spacing-plan', 'sequence') and name = 'keyframes')
        or (route = 'sequence' and name in ('spacing_plan_drafts', 'spacing_plans', 'spacing-plan', 'spacing_plan')) as kept from s, p""")
def f06(spark, d):
    parts = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name")) for s, n in STATE_PARTS])
    state = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"), F.expr("case o_orderstatus when 'F' then 'keyframes' when 'O' then 'spacing-plan' else 'sequence' end").alias("return_to"),
        F.expr("if(o_custkey % 2 = 0, 'v2', 'v1')").alias(PROTOCOL), (F.col("o_orderkey") % 5 + 1).alias("material_revision"), F.inline(parts))
    return ops.rework_retention(state).drop(PROTOCOL)


def persisted_jobs(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in PHASES])
    jobs = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 60 == 7, "paused").otherwise(
            F.element_at(names, (F.col("o_custkey") % len(PHASES) + 1).cast("int"))).alias("phase"),
        (F.col("o_orderkey") % 45).alias("revision"), F.expr("if(o_orderkey % 80 = 1, -1L, 1L)").alias("material_revision"))
    context = {c: F.col(c) for c in ("job", "phase", "revision")}
    jobs = jobs.withColumn("context_sha256", F.when(F.col("job") % 70 == 3, F.lit("0" * 64)).otherwise(canonical_sha256(context)))
    keys = F.array(*map(F.lit, ("phase", "revision", "material_revision", "checkpoint", "checkpoint_id", "context_sha256")))
    jobs = jobs.withColumn("checkpoint_id", checkpoint_name(F.col("job"), F.col("revision"))).withColumn(
        "state_keys", F.when(F.col("job") % 110 == 9, F.array_append(keys, "debug")).otherwise(keys))
    return jobs.withColumn("checkpoint", F.when(F.col("job") % 100 != 33, F.struct(
        F.when(F.col("job") % 90 == 5, "cp-0-gone").otherwise(F.col("checkpoint_id")).alias("id"),
        (F.col("revision") + F.when(F.col("job") % 95 == 6, 1).otherwise(0)).alias("job_revision"), "context_sha256")))


PHASE_LIST = "[" + ", ".join(repr(p) for p in PHASES) + "]"


@R.add("f07_phase_funnel", f"""
    with j as (select case when o_orderkey % 60 = 7 then 'paused' else list_extract({PHASE_LIST}, o_custkey % {len(PHASES)} + 1) end as phase from orders)
    select phase, case phase when 'awaiting-canonical-review' then 'canonical' when 'awaiting-production-blueprint-review' then 'motion-blueprint'
       when 'awaiting-motion-plan-review' then 'motion-plan' when 'awaiting-keyframe-review' then 'keyframe-set' when 'awaiting-spacing-plan-review' then 'spacing-plan'
       when 'awaiting-sequence-review' then 'sequence' when 'awaiting-package-review' then 'package' when 'awaiting-keyframe-input' then 'keyframes'
       when 'awaiting-spacing-plan-input' then 'spacing-plan' when 'awaiting-sequence-input' then 'sequence' else 'none' end as gate,
       case when phase like 'awaiting-%-input' then 'input' when phase like 'awaiting-%-review' then 'review' else 'none' end as waiting, count(*) as jobs
    from j group by 1""")
def f07(spark, d):
    return ops.phase_funnel(persisted_jobs(spark, d), "phase")


@R.add("f08_state_integrity", """
    select o_orderkey as job, concat_ws('; ', case when o_orderkey % 60 = 7 then 'unknown phase' end, case when o_orderkey % 45 < 1 then 'revision' end,
        case when o_orderkey % 80 = 1 then 'material revision' end, case when o_orderkey % 110 = 9 then 'state keys' end,
        case when o_orderkey % 100 = 33 or o_orderkey % 90 = 5 or o_orderkey % 95 = 6 then 'checkpoint binding' end, case when o_orderkey % 70 = 3 then 'context hash' end) as reasons from orders""")
def f08(spark, d):
    out = ops.state_integrity(persisted_jobs(spark, d), {c: F.col(c) for c in ("job", "phase", "revision")})
    return out.select("job", F.array_join("reasons", "; ").alias("reasons"))
