"""Task graphs, transition logs and the checkpointed job protocol in batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed, lookup
from proofline.functions.hashing import canonical_sha256, sha256
from proofline.functions.protocol import (
    FIRST_PHASE, PACKAGE_FAILURES, PACKAGE_STATES, PHASES, PROTOCOL, STEPS, checkpoint_name, context_text, gate_of, waiting_kind,
)
from proofline.operators.sequence import ordered, scan, union_all
from proofline.session import cut, scratch_path


# --- task graphs ----------------------------------------------------------------------------


def task_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependency-safe wave per task, -1 for tasks on or behind a cycle.

    ``nodes``: plan, id.  ``edges``: plan, id, depends_on; repeated edges and unknown dependencies do no harm.  The wave of a task is
    the longest path to it, held as constraints wave(id) >= wave(root) + w, or wave(id) >= w without a root.  A task with one root is a
    function max(base, wave(root) + w) of that root; chains of such tasks are contracted by pointer doubling, which composes these
    functions, and are put in for the roots of all other tasks.  A round thus takes away every chain and tree, so rounds follow the
    nesting of joins in the graph, and steps within one the logarithm of the longest chain.  Found waves are only ever appended.
    Joins of these tables are told to merge: each is about as large as the graph, and a broadcast in every step would pass it through the driver.
    """
    spark, task = nodes.sparkSession, ["plan", "id"]
    tasks = cut(nodes.select(*task).distinct())
    known = tasks.withColumnRenamed("id", "root")
    needs = edges.select("plan", "id", F.col("depends_on").alias("root")).distinct().join(known.hint("merge"), ["plan", "root"], "left_semi")
    none = F.lit(None).cast(tasks.schema["id"].dataType)
    rules = cut(needs.join(tasks.hint("merge"), task, "left_semi").select(*task, "root", F.lit(1).cast("bigint").alias("w")).unionByName(
        tasks.select(*task, none.alias("root"), F.lit(0).cast("bigint").alias("w"))))
    found, chains = scratch_path(spark, "waves"), []
    while True:
        free = F.col("root").isNull()
        state = cut(rules.groupBy(*task).agg(
            F.count("root").alias("roots"), F.max(F.when(free, F.col("w"))).alias("base"), F.max("root").alias("root"), F.max(F.when(~free, F.col("w"))).alias("w"),
        ))
        chain = _contracted(cut(state.where("roots < 2").select(*task, "root", "w", "base")))
        if chain.isEmpty():  # all that is left lies on or behind a cycle
            break
        chain.where("root is null").select(*task, F.col("base").alias("wave")).write.mode("append").parquet(found)
        chains.append(chain.where("root is not null"))
        via = chain.select("plan", F.col("id").alias("root"), F.col("root").alias("_root"), F.col("w").alias("_w"), F.col("base").alias("_base"))
        open_rules = rules.join(state.where("roots > 1").hint("merge"), task, "left_semi").join(via.hint("merge"), ["plan", "root"], "left")
        # a rule on a contracted task becomes one on its root and one on its base
        moved = F.when(F.col("_base").isNull(), F.array(F.struct("root", "w"))).otherwise(
            F.filter(F.array(F.struct(F.col("_root").alias("root"), (F.col("w") + F.col("_w")).alias("w")), F.struct(none.alias("root"), (F.col("w") + F.col("_base")).alias("w"))),
                     lambda r: r["w"].isNotNull()))
        rules = cut(open_rules.select(*task, F.inline(moved)).groupBy(*task, "root").agg(F.max("w").alias("w")))
    schema = tasks.withColumn("wave", F.lit(0).cast("bigint")).schema
    if chains:
        for chain in reversed(chains):
            heads = spark.read.schema(schema).parquet(found).select("plan", F.col("id").alias("root"), "wave")
            hung = chain.join(heads.hint("merge"), ["plan", "root"]).select(*task, F.greatest("base", F.col("wave") + F.col("w")).alias("wave"))
            hung.write.mode("append").parquet(found)
    waves = spark.read.schema(schema).parquet(found) if chains else tasks.limit(0).withColumn("wave", F.lit(0).cast("bigint"))
    return tasks.join(waves.hint("merge"), task, "left").select(*task, F.coalesce("wave", F.lit(-1).cast("bigint")).alias("wave"))


def _contracted(chain: DataFrame) -> DataFrame:
    """Tasks (plan, id, root, w, base) with one root or none, led to roots outside of the table or to none; tasks on or behind a loop are left out.

    Each step doubles the way a pointer has gone.  While any task can still arrive, one arrives in each step, so a step without an
    arrival leaves loops only.
    """
    waiting = None
    while True:
        ends = chain.select("plan", F.col("id").alias("root"), F.col("root").alias("_root"), F.col("w").alias("_w"), F.col("base").alias("_base"), F.lit(True).alias("_on"))
        met = cut(chain.join(ends.hint("merge"), ["plan", "root"], "left"))
        left = met.where("_on").count()
        if not left:
            return chain
        if left == waiting:
            return cut(met.where("_on is null").select("plan", "id", "root", "w", "base"))
        waiting = left
        chain = met.select(
            "plan", "id", F.when(F.col("_on"), F.col("_root")).otherwise(F.col("root")).alias("root"),
            F.when(F.col("_on"), F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"),
            F.when(F.col("_on"), F.greatest("base", F.col("w") + F.col("_base"))).otherwise(F.col("base")).alias("base"),
        )


def traceable_tasks(nodes: DataFrame, edges: DataFrame, deliverables: DataFrame) -> DataFrame:
    """Tasks that are a deliverable's task or a prerequisite of one, found backwards."""
    found = cut(deliverables.select("plan", F.col("task_id").alias("id")).distinct().join(nodes.select("plan", "id").hint("merge"), ["plan", "id"], "left_semi"))
    frontier = found
    while not frontier.isEmpty():
        needed = edges.join(frontier.hint("merge"), ["plan", "id"], "left_semi").select("plan", F.col("depends_on").alias("id")).distinct()
        frontier = cut(needed.join(nodes.select("plan", "id").hint("merge"), ["plan", "id"], "left_semi").join(found.hint("merge"), ["plan", "id"], "left_anti"))
        found = cut(found.union(frontier))
    return found


def graph_findings(nodes: DataFrame, edges: DataFrame, deliverables: DataFrame, waves: DataFrame) -> DataFrame:
    """Cycles, unknown dependencies, untraceable tasks, unconsumed outputs, uncovered deliverables."""
    ids = nodes.select("plan", "id").distinct().hint("merge")

    def finding(df: DataFrame, subject: str, code: str) -> DataFrame:
        return df.select("plan", F.col(subject).cast("string").alias("subject"), F.lit(code).alias("code")).distinct()

    wanted = deliverables.select("plan", F.col("task_id").alias("id"))
    return union_all([
        finding(waves.where("wave = -1"), "id", "cycle"),
        finding(edges.join(ids.withColumnRenamed("id", "depends_on"), ["plan", "depends_on"], "left_anti"), "depends_on", "unknown-dependency"),
        finding(ids.join(traceable_tasks(nodes, edges, deliverables).hint("merge"), ["plan", "id"], "left_anti"), "id", "untraceable"),
        finding(ids.join(edges.select("plan", F.col("depends_on").alias("id")).hint("merge"), ["plan", "id"], "left_anti").join(
            wanted.hint("merge"), ["plan", "id"], "left_anti"), "id", "unconsumed"),
        finding(deliverables.join(ids.withColumnRenamed("id", "task_id"), ["plan", "task_id"], "left_anti"), "deliverable", "uncovered"),
    ])


# --- transition logs ------------------------------------------------------------------------


def transition_problem(before: Column, state: Column) -> Column:
    """Why ``state`` may not follow ``before`` (null on the first record); null when it may."""
    order = F.array(*[F.lit(s) for s in PACKAGE_STATES])
    here, last = F.array_position(order, state), F.array_position(order, before)
    failure = state.isin(*PACKAGE_FAILURES)
    return (
        F.when((here == 0) & ~failure, "unknown-state")
        .when(before.isNull(), F.when(state != PACKAGE_STATES[0], "wrong-start"))
        .when(before.isin(*PACKAGE_FAILURES, PACKAGE_STATES[-1]), "after-terminal")
        .when(failure, F.lit(None))
        .when((last == 0) | (here != last + 1), "illegal-transition")
    )


def transition_log_audit(log: DataFrame, package: str, seq: str, state: str, at: str) -> DataFrame:
    """Findings per record; equal consecutive states collapse, every transition needs a time."""
    rows = scan(ordered(log.select(package, seq, state, at), [package], [seq]), prev={"_before": state}).plain()
    repeat = F.col("_before").eqNullSafe(F.col(state))
    problem = F.when(repeat, "collapsed").otherwise(transition_problem(F.col("_before"), F.col(state)))
    missing = F.when(~repeat & F.col(at).isNull(), "missing-time")
    return rows.select(package, seq, F.explode(listed(problem, missing)).alias("code"))


# --- job protocol ---------------------------------------------------------------------------


def _matched(responses: DataFrame, version: str) -> DataFrame:
    """Attach the phase a response is valid in and the phase it leads to (null when none)."""
    answers = {"|".join((v, s.kind, s.gate, s.decision, s.return_to)): s for v, steps in STEPS.items() for s in steps}
    of_job = F.coalesce(F.col(PROTOCOL), F.lit(version)) if PROTOCOL in responses.columns else F.lit(version)
    token = F.concat_ws("|", of_job, "kind", "gate", "decision", "return_to")
    phase = lookup(token, {k: s.phase for k, s in answers.items()})
    then = lookup(token, {k: s.then for k, s in answers.items()})
    bound = (sha256(context_text(F.col("job"), F.col("job_revision"))) == F.col("context_sha256")) & (
        checkpoint_name(F.col("job"), F.col("job_revision")) == F.col("checkpoint_id"))
    return responses.withColumns({"_phase": phase, "_then": then, "_bound": F.coalesce(bound, F.lit(False))})


def applied_responses(matched: DataFrame) -> DataFrame:
    """Ids of the responses a job accepts, from ``_matched`` rows, without folding a job in one task.

    A response fits exactly one phase and answers one revision, so whatever is
    accepted after it is determined: the first later response that answers the
    next revision in the phase it leads to.  Those successor links come from one
    ordered scan keyed by (job, revision, phase).  The accepted responses are the
    chain that starts at the first valid answer to revision 1; pointer doubling
    walks it in logarithmically many joins on the unique response id.
    """
    usable = matched.where("_bound and _phase is not null and job_revision >= 1")
    targets = usable.select("job", F.col("job_revision").alias("_rev"), "_phase", "event_id", F.lit(1).alias("_side"),
                            F.col("event_id").alias("_target"))
    asks = usable.select("job", (F.col("job_revision") + 1).alias("_rev"), F.col("_then").alias("_phase"), "event_id",
                         F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_target"))
    merged = ordered(targets.unionByName(asks), ["job", "_rev", "_phase"], ["event_id", "_side"])
    linked = scan(merged, after_valid={"_next": "_target"}).plain()
    jump = cut(linked.where("_side = 0 and _next is not null").select(F.col("event_id").alias("id"), F.col("_next").alias("to")))
    marked = cut(usable.where((F.col("job_revision") == 1) & (F.col("_phase") == FIRST_PHASE)).groupBy("job").agg(
        F.min("event_id").alias("id")).select("id"))
    while True:
        reached = cut(marked.join(jump, "id").select(F.col("to").alias("id")))
        if reached.isEmpty():
            return marked
        marked = cut(marked.union(reached))
        further = jump.select(F.col("id").alias("to"), F.col("to").alias("_far"))
        jump = cut(jump.join(further, "to").select("id", F.col("_far").alias("to")))


def checkpoint_fold(responses: DataFrame, version: str = "v1") -> DataFrame:
    """Status of every response and the job state right after it.

    ``responses``: job, event_id (arrival order, unique), kind, gate, decision,
    return_to (empty strings when unused), checkpoint_id, job_revision, context_sha256, and
    optionally protocol, the version of the job where it differs from ``version``.
    """
    matched = cut(_matched(responses, version))
    hits = applied_responses(matched).select(F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("_hit"))
    rows = matched.join(hits, "event_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    rows = rows.withColumn("_led", F.when(F.col("_hit") == 1, F.col("_then")))
    seq = scan(ordered(rows, ["job"], ["event_id"]), before_sum={"_done": "_hit"}, before_valid={"_was": "_led"}).plain()
    phase, revision = F.coalesce("_was", F.lit(FIRST_PHASE)), F.col("_done") + 1
    status = (
        F.when(F.col("_hit") == 1, "applied")
        .when((F.col("job_revision") != revision) | ~F.col("_bound"), "stale")
        .when(F.col("kind") != waiting_kind(phase), "kind-mismatch").otherwise("invalid")
    )
    return seq.select(
        "job", "event_id", status.alias("status"), F.coalesce("_led", phase).alias("phase"),
        (revision + F.col("_hit")).cast("bigint").alias("revision"),
    )


def job_states(folded: DataFrame) -> DataFrame:
    """Last state of every job."""
    return folded.groupBy("job").agg(
        F.max_by("phase", "event_id").alias("phase"), F.max("revision").alias("revision"), F.count_if(F.col("status") == "applied").alias("applied")
    )


def stale_responses(deliveries: DataFrame, version: str = "v1") -> DataFrame:
    """Status per delivery; only the first delivery of an event can commit.

    ``deliveries``: the response columns plus ``delivery`` (unique arrival number).
    """
    first = deliveries.groupBy("event_id").agg(F.min("delivery").alias("_first"))
    marked = deliveries.join(first, "event_id").withColumn("_again", F.col("delivery") > F.col("_first"))
    unique = marked.where(~F.col("_again")).drop("_first", "_again", "delivery")
    folded = checkpoint_fold(unique, version).select("event_id", F.col("status").alias("_status"))
    return marked.join(folded, "event_id").select(
        "job", "event_id", "delivery", F.when(F.col("_again"), "duplicate").otherwise(F.col("_status")).alias("status")
    )


# Sections whose change restarts a job, reopens motion review, or only package review.
RESTART = ("identity", "target", "rendering_profile", "clip_bindings", "source_bindings")
MOTION = ("clips",)
PACKAGE = ("output_scope", "runtime_scope")


def change_scope(versions: DataFrame, job: str, order: str, others: Sequence[str] = ()) -> DataFrame:
    """What each new intent of a job invalidates; ``base_revision`` never counts as a change.

    ``source_bindings`` holds the hashes of the identity's source files: new bytes restart a job even under equal intent texts.
    """
    sections = (*RESTART, *MOTION, *PACKAGE, *others)
    digest = canonical_sha256({s: F.col(s).cast("string") for s in sections})
    rows = versions.select(job, order, *sections).withColumn("material_sha256", digest).withColumn("_all", F.struct("material_sha256", *sections))
    seq = scan(ordered(rows, [job], [order]), prev={"_was": "_all"}).plain()

    def changed(names: Sequence[str]) -> Column:
        test = F.lit(False)
        for name in names:
            test = test | ~F.col(name).eqNullSafe(F.col(f"_was.{name}"))
        return test

    scope = (
        F.when(F.col("_was").isNull(), "new").when(F.col("material_sha256") == F.col("_was.material_sha256"), "unchanged")
        .when(changed(RESTART), "restart").when(changed(MOTION), "motion-review").when(changed(PACKAGE), "package-review")
        .otherwise("revision-only")
    )
    return seq.select(job, order, "material_sha256", scope.alias("scope"))


# What survives each rework route, by section of the job state.
RETAINED_ALWAYS = {
    "v1": {
        "output": ("canonical_references", "identity_bible", "motion_blueprints"),
        "approval": ("canonical", "motion-blueprint"),
    },
    "v2": {
        "output": ("canonical_references", "identity_bible", "motion_plan", "raw_frame_admissions"),
        "approval": ("canonical", "motion-plan"),
    },
}
RETAINED_ALSO = {
    "keyframes": {},
    "spacing-plan": {"input": ("keyframes",), "approval": ("keyframes",)},
    "sequence": {
        "input": ("keyframes",),
        "approval": ("keyframes", "spacing-plan"),
        "output": ("spacing_plan_drafts", "spacing_plans"),
        "plan": ("spacing_plan",),
    },
}


def rework_retention(state: DataFrame, version: str = "v1") -> DataFrame:
    """Mark which parts of a job survive its rework route; columns section, name, return_to.

    A column protocol names the version of a job where it differs from ``version``.  A column material_revision, if there
    is one, goes up by one wherever the route reopens the job.
    """
    of_job = F.coalesce(F.col(PROTOCOL), F.lit(version)) if PROTOCOL in state.columns else F.lit(version)
    first = of_job == "v1"
    kept = (F.col("section") == "approval") & F.col("name").endswith("-changes-requested")
    for protocol, parts in RETAINED_ALWAYS.items():
        for section, names in parts.items():
            kept = kept | ((first if protocol == "v1" else ~first) & (F.col("section") == section) & F.col("name").isin(*names))
    for route, parts in RETAINED_ALSO.items():
        for section, names in parts.items():
            kept = kept | ((F.col("return_to") == route) & (F.col("section") == section) & F.col("name").isin(*names))
    reopened = F.coalesce(F.col("return_to").isin(*RETAINED_ALSO), F.lit(False))
    if "material_revision" in state.columns:
        state = state.withColumn("material_revision", F.col("material_revision") + reopened.cast("int"))
    return state.withColumn("kept", reopened & kept)


def phase_funnel(jobs: DataFrame, phase: str) -> DataFrame:
    counts = jobs.groupBy(phase).agg(F.count(F.lit(1)).alias("jobs"))
    return counts.select(phase, gate_of(F.col(phase)).alias("gate"), waiting_kind(F.col(phase)).alias("waiting"), "jobs")


# The only keys a persisted job state may have.
STATE_KEYS = (
    "schema_version", "pixel_protocol_id", "revision", "material_revision", "phase", "intent", "inputs", "approvals", "outputs",
    "intent_material_sha256", "checkpoint_id", "context_sha256", "checkpoint", "spacing_plan",
)


def state_integrity(jobs: DataFrame, context: Mapping[str, Column]) -> DataFrame:
    """Reasons why a persisted job state is corrupt; ``context`` names what its hash covers.

    ``jobs``: phase, revision, material_revision, context_sha256, checkpoint_id, state_keys (the keys of the persisted
    object) and checkpoint (struct of id, job_revision, context_sha256), which must repeat the state's own values.
    """
    same = [("id", "checkpoint_id"), ("job_revision", "revision"), ("context_sha256", "context_sha256")]
    binding = reduce(lambda a, b: a & b, [F.col(f"checkpoint.{c}").eqNullSafe(F.col(own)) for c, own in same])
    reasons = listed(
        F.when(~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)), "unknown phase"),
        F.when(~F.coalesce(F.col("revision") >= 1, F.lit(False)), "revision"),
        F.when(~F.coalesce(F.col("material_revision") >= 1, F.lit(False)), "material revision"),
        F.when(~F.coalesce(F.size(F.array_except("state_keys", F.array(*map(F.lit, STATE_KEYS)))) == 0, F.lit(False)), "state keys"),
        F.when(F.col("checkpoint").isNull() | ~binding, "checkpoint binding"),
        F.when(~F.col("context_sha256").eqNullSafe(canonical_sha256(context)), "context hash"),)
    return jobs.withColumn("reasons", reasons)
