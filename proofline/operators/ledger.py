"""Hash-chained ledgers and complete grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed
from proofline.functions.hashing import ZERO_HASH


def chain_audit(ledger: DataFrame, recomputed: Column, finals: DataFrame | None = None) -> DataFrame:
    """Findings over (ledger, iteration, previous_hash, chain_hash) records.

    Neighbours meet through an equi-join on (ledger, iteration - 1), so one giant
    ledger still spreads over all tasks.  Every break is reported, not only the first.
    """
    back = ledger.select("ledger", (F.col("iteration") + 1).alias("iteration"), F.col("chain_hash").alias("_prior")).groupBy(
        "ledger", "iteration").agg(F.min("_prior").alias("_prior"))
    records = ledger.withColumn("_hash", recomputed).join(back, on=["ledger", "iteration"], how="left")
    start = F.col("iteration") == 1
    expected = F.when(start, F.lit(ZERO_HASH)).otherwise(F.col("_prior"))
    codes = listed(
        F.when(~start & F.col("_prior").isNull(), "order"),
        F.when(expected.isNotNull() & ~F.col("previous_hash").eqNullSafe(expected), "previous-hash"),
        F.when(~F.col("chain_hash").eqNullSafe(F.col("_hash")), "chain-hash"),)
    found = records.select("ledger", "iteration", F.explode(codes).alias("code"))
    repeats = ledger.groupBy("ledger", "iteration").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = found.unionByName(repeats.select("ledger", "iteration", F.lit("repeated").alias("code")))
    if finals is not None:
        ends = ledger.groupBy("ledger").agg(
            F.max("iteration").alias("iteration"), F.max_by("chain_hash", "iteration").alias("_end")
        ).join(finals, on="ledger")
        wrong = ends.where(~F.col("_end").eqNullSafe(F.col("final_chain_hash")))
        found = found.unionByName(wrong.select("ledger", "iteration", F.lit("final-hash").alias("code")))
    return found


def preserved_prefix(ledger: DataFrame, base: DataFrame) -> DataFrame:
    """Per ledger: the base records are unchanged and the next record continues from them."""
    fields = [c for c in base.columns if c not in ("ledger", "iteration")]
    now = ledger.select("ledger", "iteration", F.struct(*fields).alias("_now"))
    then = base.select("ledger", "iteration", F.struct(*fields).alias("_then"))
    same = then.join(now, on=["ledger", "iteration"], how="left").groupBy("ledger").agg(
        F.bool_and(F.col("_then").eqNullSafe(F.col("_now"))).alias("prefix_equal"),
        F.max("iteration").alias("base_count"), F.max_by("_then.chain_hash", "iteration").alias("_final"),
    )
    following = ledger.select("ledger", (F.col("iteration") - 1).alias("base_count"), "previous_hash")
    joined = same.join(following, on=["ledger", "base_count"], how="left")
    state = F.when(F.col("previous_hash").isNull(), "no-next-record").when(
        F.col("previous_hash") == F.col("_final"), "continues").otherwise("broken")
    return joined.select("ledger", "base_count", "prefix_equal", state.alias("continuation"))


def grid_coverage(cells: DataFrame, a: str, b: str, size_a: int, size_b: int) -> DataFrame:
    """Cells of the 1-based ``size_a`` x ``size_b`` grid that are missing, repeated or outside.

    Expected cells come from a distributed range of ordinals, whose coordinates
    are derived by division and remainder, so no dimension product is joined.
    """
    n = F.col("ordinal") - 1
    expected = cells.sparkSession.range(1, size_a * size_b + 1).withColumnRenamed("id", "ordinal").select(
        (F.expr(f"div(ordinal - 1, {size_b})") + 1).alias(a), (n % size_b + 1).alias(b), F.lit(True).alias("_cell")
    )
    seen = cells.groupBy(F.col(a).cast("bigint").alias(a), F.col(b).cast("bigint").alias(b)).agg(F.count(F.lit(1)).alias("copies"))
    status = (
        F.when(F.col("copies").isNull(), "missing").when(F.col("_cell").isNull(), "outside")
        .when(F.col("copies") > 1, "repeated").otherwise("once")
    )
    return expected.join(seen, on=[a, b], how="full_outer").select(
        a, b, F.coalesce("copies", F.lit(0)).alias("copies"), status.alias("status")
    )


def coordinate_audit(cells: DataFrame, ordinal: str, a: str, b: str, size_b: int) -> DataFrame:
    """Records whose stated coordinates differ from those derived from their ordinal."""
    want_a = F.expr(f"div({ordinal} - 1, {size_b}) + 1")
    want_b = (F.col(ordinal) - 1) % size_b + 1
    return cells.where(~(F.col(a).eqNullSafe(want_a) & F.col(b).eqNullSafe(want_b))).withColumn(
        "expected_a", want_a.cast("bigint")).withColumn("expected_b", want_b.cast("bigint"))
