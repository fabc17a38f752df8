"""Review scopes, gate order, decisions and admission lineage."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed, lookup
from proofline.functions.hashing import sha256
from proofline.operators.sequence import ordered, scan

# Gate ranks and the largest number of reviews one package may declare.
GATE_RANK = {"canonical-approval": 0, "keyframe-set-approval": 1, "sequence-approval": 2}
MAX_REVIEWS = 768


def gate_rank(gate: Column) -> Column:
    return lookup(gate, GATE_RANK)


def _short(digest: Column) -> Column:
    """A lowercase hexadecimal SHA-256 as its 32 bytes, any other text as it is after a byte of its own; equal just where the texts are."""
    return F.when(digest.rlike("^[0-9a-f]{64}\\z"), F.unhex(digest)).otherwise(F.concat(F.lit(b"\x00"), digest.cast("binary")))


def review_scope_audit(
    reviews: DataFrame, expected: DataFrame, hashes: DataFrame, package: str, admissions: DataFrame | None = None,
) -> DataFrame:
    """One review per expected (gate, subject list), nothing else, with current subject hashes.

    ``reviews``: package, id, gate, subject_ids, subject_sha256 (map), declared_order.
    ``expected``: package, gate, subject_ids.  ``hashes``: package, subject_id, sha256.
    ``admissions``: package, subject_id, sha256 of the admission proof of canonical subjects; with it, reviews carry a map
    admission_sha256 that binds exactly the canonicals among their subjects to their current proof.
    """
    scope = [package, "gate", "subject_ids"]
    # one aggregate over both sides instead of a join of two; a scope with a null equals no other side's
    apart = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in scope])
    seen = reviews.select(*scope, "id", F.lit(1).cast("bigint").alias("_seen"), F.lit(0).alias("_wanted"))
    wanted = expected.select(*scope, F.lit(None).cast(reviews.schema["id"].dataType).alias("id"), F.lit(0).cast("bigint").alias("_seen"), F.lit(1).alias("_wanted"))
    both = seen.unionByName(wanted).groupBy(*scope, F.when(apart, F.col("_wanted")).alias("_side")).agg(
        F.sum("_seen").alias("_n"), F.min("id").alias("id"), F.max("_wanted").alias("_wanted"))
    code = F.when(F.col("_n") == 0, "missing").when(F.col("_wanted") == 0, "unexpected").when(F.col("_n") > 1, "duplicate")
    scopes = both.select(package, F.coalesce("id", F.lit(-1)).alias("id"), code.alias("code")).where(F.col("code").isNotNull())

    # a row takes the one hash it is compared by into the join, as bytes where it is one, and not the review's whole map
    bound = reviews.select(package, "id", "subject_sha256", F.explode("subject_ids").alias("subject_id")).select(
        package, "id", "subject_id", _short(F.try_element_at("subject_sha256", F.col("subject_id"))).alias("_held"))
    current = hashes.select(package, "subject_id", _short(F.col("sha256")).alias("_sha"))
    checked = bound.join(current, on=[package, "subject_id"], how="left")
    stale = checked.where(~F.col("_held").eqNullSafe(F.col("_sha"))).select(package, "id", F.lit("stale").alias("code")).distinct()
    surplus = reviews.where(
        F.size(F.array_except(F.map_keys("subject_sha256"), F.col("subject_ids"))) > 0
    ).select(package, "id", F.lit("surplus-hash").alias("code"))

    again = reviews.groupBy(package, "id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        package, "id", F.lit("repeated-id").alias("code")
    )
    orders = reviews.groupBy(package, "declared_order").agg(F.count(F.lit(1)).alias("_n")).groupBy(package).agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_d"), F.min("declared_order").alias("_lo"),
        F.max("declared_order").alias("_hi"),
    )
    gaps = orders.where((F.col("_rows") != F.col("_d")) | (F.col("_lo") != 1) | (F.col("_hi") != F.col("_d"))).select(
        package, F.lit(-1).cast("bigint").alias("id"), F.lit("order-not-contiguous").alias("code")
    )
    found = scopes.unionByName(stale).unionByName(surplus).unionByName(again).unionByName(gaps)
    if admissions is None:
        return found
    # every subject and every key of the map: either side may lack what the other holds
    named = reviews.select(package, "id", "admission_sha256", "subject_ids", F.explode(
        F.array_union("subject_ids", F.coalesce(F.map_keys("admission_sha256"), F.array().cast("array<string>")))).alias("subject_id")).select(
        package, "id", "subject_id", _short(F.try_element_at("admission_sha256", F.col("subject_id"))).alias("_held"),
        F.array_contains("subject_ids", F.col("subject_id")).alias("_own"))
    current = admissions.select(package, "subject_id", _short(F.col("sha256")).alias("_sha"))
    proofs = named.join(current, on=[package, "subject_id"], how="left")
    due = F.when(F.col("_own"), F.col("_sha"))
    unbound = proofs.where(~F.col("_held").eqNullSafe(due)).select(package, "id", F.lit("admission").alias("code")).distinct()
    return found.unionByName(unbound)


def gate_order_audit(reviews: DataFrame, package: str) -> DataFrame:
    """Findings on the declared order of scoped reviews.

    A package with more than ``MAX_REVIEWS`` reviews is itself a finding, and it is audited like any other.  A keyframe set
    belongs to a sequence that holds all its frames.  It is only sent to the sequences that hold the rarest of them, those of the
    frame that the fewest sequences of the canonical hold, and compared there; a frame that all share joins nothing.  A gate without a rank is a finding, too.
    """
    sizes = reviews.groupBy(package).agg(F.count(F.lit(1)).alias("_n"))
    too_many = sizes.where(F.col("_n") > MAX_REVIEWS).select(
        package, F.lit(-1).cast("bigint").alias("id"), F.lit("too-many-reviews").alias("code")
    )
    ranked = reviews.withColumn("_rank", gate_rank(F.col("gate"))).withColumn("_canonical", F.try_element_at("subject_ids", F.lit(1)))
    ranked = ranked.withColumn("_frames", F.slice("subject_ids", 2, F.greatest(F.size("subject_ids"), F.lit(1))))

    running = scan(ordered(ranked.select(package, "declared_order", "id", "_rank"), [package], ["declared_order", "id"]),
                   before_max={"_peak": "_rank"}).plain()
    backwards = running.where(F.col("_rank") < F.col("_peak")).select(package, "id", F.lit("rank-decreases").alias("code"))

    canonical = ranked.where(F.col("_rank") == 0).groupBy(package, "_canonical").agg(
        F.max_by("declared_order", "declared_order").alias("_approved_at")
    )
    dependents = ranked.where(F.col("_rank") > 0)
    early = dependents.join(canonical, on=[package, "_canonical"], how="left").where(
        F.col("_approved_at").isNull() | (F.col("_approved_at") >= F.col("declared_order"))
    ).select(package, "id", F.lit("before-canonical").alias("code"))

    unknown = ranked.where(F.col("_rank").isNull()).select(package, "id", F.lit("unknown-gate").alias("code"))
    scope = [package, "_canonical"]
    framed = ranked.where(F.col("_rank") > 0).withColumn("_frames", F.array_distinct("_frames"))
    sets = framed.where(F.col("_rank") == 1).select(
        *scope, F.struct("id", "declared_order").alias("_set"), F.size("_frames").alias("_size"), F.col("declared_order").alias("_key_order"), "_frames")
    sequences = framed.where(F.col("_rank") == 2).select(*scope, "id", "declared_order", "_frames")
    framed_sequences = sequences.select(*scope, "id", "declared_order", F.col("_frames").alias("_held"), F.explode("_frames").alias("_frame"))
    holders = framed_sequences.groupBy(*scope, "_frame").agg(F.count(F.lit(1)).alias("_n"))
    each = sets.where("_size > 0").select(*scope, "_set", "_key_order", "_frames", F.explode("_frames").alias("_frame"))
    rarest = each.join(holders, on=[*scope, "_frame"], how="left").groupBy(*scope, "_set", "_key_order", "_frames").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_frame")).alias("_rare"))
    asked = rarest.where("_rare.n > 0").select(*scope, "_set", "_key_order", "_frames", F.col("_rare._frame").alias("_frame"))
    met = framed_sequences.join(asked, on=[*scope, "_frame"])
    whole = met.where(F.size(F.array_except("_frames", "_held")) == 0)
    # a set without frames belongs to every sequence of its canonical: such sets are counted, not paired
    empty = sets.where("_size = 0").groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.min("_key_order").alias("_key_order"))
    plain = sequences.join(empty, on=scope, how="left").select(
        package, "id", "declared_order", F.coalesce("_n", F.lit(0)).alias("_n"), "_key_order")
    matches = plain.unionByName(whole.select(package, "id", "declared_order", F.lit(1).alias("_n"), "_key_order")).groupBy(package, "id").agg(
        F.sum("_n").alias("_matches"), F.min("_key_order").alias("_key_order"), F.min("declared_order").alias("declared_order"))
    wrong = matches.where(
        (F.col("_matches") != 1) | (F.col("_key_order") >= F.col("declared_order"))
    ).select(package, "id", F.lit("keyframes-not-before-sequence").alias("code"))
    return too_many.unionByName(unknown).unionByName(backwards).unionByName(early).unionByName(wrong)


def review_decision(packets: DataFrame, bound_text: Column) -> DataFrame:
    """Verdict per review packet, a document with nested arrays on one row.

    Columns: packet, subjects (array of ids), evidence (array of ids), reviews
    (array of reviewer, evidence_ids, observations), status, subject_sha256.
    ``bound_text`` is the canonical text the decision hash must cover.
    """
    observations = F.flatten(F.transform("reviews", lambda r: r["observations"]))
    cited = F.flatten(F.transform("reviews", lambda r: r["evidence_ids"]))
    # exactly one acceptable observation per subject
    accepted = F.transform(F.filter(observations, lambda o: o["disposition"] == "acceptable"), lambda o: o["subject_id"])
    problems = listed(
        F.when(F.exists("reviews", lambda r: F.size(r["evidence_ids"]) == 0), "review without evidence"),
        F.when(F.size(F.array_except(cited, F.col("evidence"))) > 0, "unknown evidence"),
        F.when(F.exists(observations, lambda o: ~o["classification"].eqNullSafe(F.lit("reviewed"))), "not reviewed"),
        F.when(F.size(F.array_except(F.transform(observations, lambda o: o["subject_id"]), F.col("subjects"))) > 0,
               "unknown subject"),
        F.when(~F.col("status").isin("approved", "rejected"), "invalid status"),
        F.when(~F.col("subject_sha256").eqNullSafe(sha256(bound_text)), "decision hash mismatch"),
        F.when((F.size(observations) == 0)
               | F.exists(observations, lambda o: ~o["disposition"].eqNullSafe(F.lit("acceptable"))), "not acceptable"),
        F.when((F.size(accepted) != F.size("subjects")) | (F.size(F.array_except(F.col("subjects"), accepted)) > 0), "subject coverage"),)
    return packets.withColumn("problems", problems).withColumn("approved", (F.size("problems") == 0))


def artifact_lineage(
    admissions: DataFrame, artifacts: DataFrame, plan: DataFrame, artifact_on: str, plan_on: str,
    artifact_pairs: Mapping[str, str], plan_pairs: Mapping[str, str], policy_ok: Column,
) -> DataFrame:
    """Admissions whose claims differ from their artifact or plan position, with reasons."""
    a = artifacts.select(artifact_on, *[F.col(c).alias(f"_a_{k}") for k, c in artifact_pairs.items()], F.lit(True).alias("_a"))
    p = plan.select(plan_on, *[F.col(c).alias(f"_p_{k}") for k, c in plan_pairs.items()], F.lit(True).alias("_p"))
    joined = admissions.join(a, on=artifact_on, how="left").join(p, on=plan_on, how="left")
    reasons = listed(
        F.when(F.col("_a").isNull(), "artifact missing"),
        F.when(F.col("_p").isNull(), "plan position missing"),
        *[F.when(F.col("_a").isNotNull() & ~F.col(k).eqNullSafe(F.col(f"_a_{k}")), f"{k} differs") for k in artifact_pairs],
        *[F.when(F.col("_p").isNotNull() & ~F.col(k).eqNullSafe(F.col(f"_p_{k}")), f"{k} differs") for k in plan_pairs],
        F.when(~F.coalesce(policy_ok, F.lit(False)), "policy"),)
    drop = ["_a", "_p", *[f"_a_{k}" for k in artifact_pairs], *[f"_p_{k}" for k in plan_pairs]]
    return joined.withColumn("reasons", reasons).drop(*drop)
