"""Manifests, digests, keys, references, bindings and projections across many packages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed
from proofline.functions.hashing import canonical_sha256
from proofline.operators.sequence import ordered, scan, union_all


def tree_digest(files: DataFrame, package: str, path: str = "path", sha: str = "sha256") -> DataFrame:
    """One digest per package over (path length, path, raw content hash) in path order.

    SHA-256 is a sequential fold, so a package is *streamed*: rows arrive sorted
    (the sort spills), each Arrow batch updates the running hash once for each package in it and is dropped.
    Entries are built by Spark; content hashing itself happens earlier and in parallel.
    """
    length = F.unhex(F.lpad(F.hex(F.octet_length(path)), 8, "0"))
    entry = F.concat(length, F.encode(F.col(path), "UTF-8"), F.unhex(sha))
    rows = files.select(F.col(package).cast("string").alias("package"), F.col(path).alias("path"), entry.alias("entry"))
    sorted_rows = rows.repartition("package").sortWithinPartitions("package", "path")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, n = None, None, 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"package": [current], "tree_sha256": [digest.hexdigest()], "files": [n]}
            )

        for batch in batches:
            names, entries = batch.column("package").to_pylist(), batch.column("entry")
            if entries.null_count:
                raise ValueError("a file lacks its path or a hexadecimal digest")
            borders = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for begin, end in zip([0, *borders], [*borders, len(names)]) if names else []:
                if names[begin] != current or digest is None:
                    if digest is not None:
                        yield emit()
                    current, digest, n = names[begin], hashlib.sha256(), 0
                digest.update(b"".join(entries.slice(begin, end - begin).to_pylist()))
                n += end - begin
        if digest is not None:
            yield emit()

    return sorted_rows.mapInArrow(fold, "package string, tree_sha256 string, files bigint").withColumnRenamed(
        "package", package
    )


def manifest_diff(declared: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full comparison of two listings: missing, unexpected, mismatch or match."""
    left = declared.select(*keys, F.struct(*values).alias("_declared"))
    right = actual.select(*keys, F.struct(*values).alias("_actual"))
    status = (
        F.when(F.col("_actual").isNull(), "missing").when(F.col("_declared").isNull(), "unexpected")
        .when(~F.col("_declared").eqNullSafe(F.col("_actual")), "mismatch").otherwise("match")
    )
    return left.join(right, on=list(keys), how="full_outer").select(*keys, status.alias("status"))


def unique_key_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def reference_audit(children: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Children whose reference resolves to nothing; a null reference is also unresolved."""
    return children.join(parents.select(*on), on=list(on), how="left_anti")


def orphan_audit(parents: DataFrame, refs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parents nobody refers to."""
    return parents.join(refs.select(*on), on=list(on), how="left_anti")


def exact_coverage(expected: DataFrame, actual: DataFrame, scope: Sequence[str], key: str) -> DataFrame:
    """Per scope: missing, unexpected and duplicated keys, and whether the sets are equal."""
    by = [*scope, key]
    left = expected.groupBy(*by).agg(F.count(F.lit(1)).alias("_e"))
    right = actual.groupBy(*by).agg(F.count(F.lit(1)).alias("_a"))
    both = left.join(right, on=by, how="full_outer")
    counts = both.groupBy(*scope).agg(
        F.count("_e").alias("expected"),
        F.count_if(F.col("_a").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"),
        F.count_if((F.col("_a") > 1) | (F.col("_e") > 1)).alias("duplicated"),
    )
    return counts.withColumn("exact", (F.col("missing") + F.col("unexpected") + F.col("duplicated")) == 0)


def binding_audit(bindings: DataFrame, targets: DataFrame, on: Sequence[str], bound: str, current: str) -> DataFrame:
    """Compare a stored hash with the hash of the object it is bound to."""
    status = (
        F.when(F.col("_present").isNull(), "missing")
        .when(F.col(bound).eqNullSafe(F.col("_current")), "current").otherwise("stale")
    )
    now = targets.select(*on, F.col(current).alias("_current"), F.lit(True).alias("_present"))
    return bindings.join(now, on=list(on), how="left").withColumn("status", status).drop("_current", "_present")


def dimension_agreement(fact: DataFrame, dim: DataFrame, on: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """Fact rows whose copied attributes differ from the dimension; ``pairs`` maps fact to dimension column."""
    side = dim.select(*on, *[F.col(d).alias(f"_d_{f}") for f, d in pairs.items()])
    wrong = listed(
        *[F.when(~F.col(f).eqNullSafe(F.col(f"_d_{f}")), F.lit(f)) for f in pairs]
    )
    joined = fact.join(side, on=list(on)).withColumn("disagreeing", wrong)
    return joined.where(F.size("disagreeing") > 0).drop(*[f"_d_{f}" for f in pairs])


def contiguous_sequence(df: DataFrame, keys: Sequence[str], index: str, base: int = 0) -> DataFrame:
    """Per key: whether indexes are exactly base..base+n-1, and how many are missing or repeated."""
    seen = df.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("_n"))
    stats = seen.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("_d"),
        F.min(index).alias("_lo"), F.max(index).alias("_hi"),
    )
    repeated = F.col("rows") - F.col("_d")
    holes = F.greatest(F.col("_hi") + 1 - base, F.lit(0)) - F.col("_d")
    good = (F.col("_lo") == base) & (holes == 0) & (repeated == 0)
    return stats.select(
        *keys, "rows", repeated.alias("repeated"), holes.cast("bigint").alias("holes"), good.alias("contiguous")
    )


def content_address_audit(artifacts: DataFrame, path: str, sha: str, kind: str) -> DataFrame:
    """Paths must be portable, relative and equal to the content address of their artifact."""
    p = F.col(path)
    portable = (
        (p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.?(/|$)") & ~p.contains("//") & ~p.endswith("/")
    )
    expected = F.when(F.col(kind) == "spritesheet", F.lit("spritesheet.png")).otherwise(
        F.concat(F.lit("artifacts/"), F.col(sha), F.lit(".png"))
    )
    code = F.when(~F.coalesce(portable, F.lit(False)), "not-portable").when(p != expected, "wrong-address").otherwise("ok")
    return artifacts.withColumn("address_status", code)


def duplicate_content(df: DataFrame, content: str, scope: Sequence[str], row_id: str) -> DataFrame:
    """Rows whose content occurs more than once in their scope, with the first holder."""
    by = [*scope, content]
    repeated = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_holder")
    ).where("copies > 1")
    return df.join(repeated, on=by)


def budget_audit(
    files: DataFrame, package: str, path: str, size: str, max_bytes: int, max_files: int, max_item: int
) -> DataFrame:
    """Per package: totals, oversized items, and the first path that exceeds a running limit."""
    base = files.select(package, path, size).withColumn("_one", F.lit(1).cast("bigint"))
    seq = scan(ordered(base, [package], [path]), before_sum={"_bytes": size, "_files": "_one"})
    over = (F.col("_bytes") + F.col(size) > max_bytes) | (F.col("_files") + 1 > max_files)
    return seq.plain().groupBy(package).agg(
        F.sum(size).alias("total_bytes"), F.count(F.lit(1)).alias("files"),
        F.count_if(F.col(size) > max_item).alias("oversized_items"),
        F.min(F.when(over, F.col(path))).alias("first_overflow"),
    )


def reference_closure(refs: DataFrame, files: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct referenced paths against existing files: missing, unreferenced or ok."""
    left = refs.groupBy(*key).agg(F.count(F.lit(1)).alias("references"))
    right = files.select(*key).distinct().withColumn("_file", F.lit(True))
    status = (
        F.when(F.col("_file").isNull(), "missing").when(F.col("references").isNull(), "unreferenced").otherwise("ok")
    )
    return left.join(right, on=list(key), how="full_outer").select(
        *key, F.coalesce("references", F.lit(0)).alias("references"), status.alias("status")
    )


def projection_audit(
    package: DataFrame, projection: DataFrame, on: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Fields of a projection that differ from the package, per record; an absent record is reported whole."""
    left = package.select(*on, *[F.col(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_has"))
    right = projection.select(*on, *[F.col(f).alias(f"_q_{f}") for f in fields], F.lit(True).alias("_got"))
    both = left.join(right, on=list(on), how="full_outer")
    differing = listed(
        *[F.when(~F.col(f"_p_{f}").eqNullSafe(F.col(f"_q_{f}")), F.lit(f)) for f in fields]
    )
    status = (
        F.when(F.col("_got").isNull(), "absent").when(F.col("_has").isNull(), "extra")
        .when(F.size(differing) > 0, "differs").otherwise("equal")
    )
    both_sides = F.col("_got").isNotNull() & F.col("_has").isNotNull()
    return both.select(
        *on, status.alias("status"), F.when(both_sides, differing).otherwise(F.array().cast("array<string>")).alias("fields")
    )


def observed_events_audit(declared: DataFrame, observed: DataFrame, package: str, clips: DataFrame | None = None) -> DataFrame:
    """Declared events against observed ones at (clip, name, position); clips must keep their order.

    ``clips``: package, clip, clip_order as the observer lists its clips.  Without it the clips are those of the observed events, so a
    clip none of whose events was observed counts as out of order; with it such a clip keeps its place.
    """
    at = [package, "clip", "name", "position"]
    events = manifest_diff(
        declared.select(*at, F.lit(True).alias("observed")).distinct(), observed.select(*at, "observed"), at, ["observed"]
    ).where("status <> 'match'")
    order = [package, "clip"]
    listed_clips = observed if clips is None else clips
    moved = declared.select(*order, "clip_order").distinct().join(
        listed_clips.select(*order, F.col("clip_order").alias("_seen")).distinct(), on=order, how="full_outer"
    ).where(~F.col("clip_order").eqNullSafe(F.col("_seen")))
    return events.select(*at, "status").unionByName(
        moved.select(*order, F.lit("").alias("name"), F.lit(-1).cast("bigint").alias("position"),
                     F.lit("clip-order").alias("status"))
    )


def replay_audit(recorded: DataFrame, recomputed: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric whose recorded value differs from the recomputed one."""
    sides = [
        df.unpivot(list(keys), list(metrics), "metric", name)
        for df, name in ((recorded, "recorded"), (recomputed, "recomputed"))
    ]
    both = sides[0].join(sides[1], on=[*keys, "metric"], how="full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("recomputed")))


def job_cache_match(jobs: DataFrame, requests: DataFrame, sha: str, params: Sequence[str]) -> DataFrame:
    """Requests with the reusable job for the same input hash and identical parameters, if any."""
    token = canonical_sha256({p: F.col(p) for p in params})
    done = jobs.withColumn("_params", token).groupBy(F.col(sha), "_params").agg(F.min("job_id").alias("reused_job"))
    asked = requests.withColumn("_params", token)
    return asked.join(done, on=[sha, "_params"], how="left").drop("_params")


# Result classes of a verification report.
CLAIM_CLASSES = ("MACHINE-VERIFIED", "REVIEWED", "DECLARED", "SUPPLIED", "HUMAN-REVIEWED", "UNRESOLVED")


def findings(df: DataFrame, package: str, subject: str, checks: Mapping[tuple[str, str], Column]) -> DataFrame:
    """Long findings table from boolean checks keyed by (class, code)."""
    rows = F.array(*[
        F.struct(F.lit(cls).alias("class"), F.lit(code).alias("code"), F.coalesce(ok, F.lit(False)).alias("passed"))
        for (cls, code), ok in checks.items()
    ])
    return df.select(F.col(package).alias("package_id"), F.col(subject).cast("string").alias("subject"),
                     F.inline(rows))


def claim_rollup(found: DataFrame) -> DataFrame:
    """PASS or FAIL per (package, subject, class) plus one overall row per package."""
    per = found.groupBy("package_id", "subject", "class").agg(
        F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failures"),
    )
    overall = per.groupBy("package_id").agg(
        F.bool_and("passed").alias("passed"), F.sum("checks").alias("checks"), F.sum("failures").alias("failures")
    ).select("package_id", F.lit("*").alias("subject"), F.lit("OVERALL").alias("class"), "passed", "checks", "failures")
    return union_all([per, overall]).withColumn("result", F.when(F.col("passed"), "PASS").otherwise("FAIL")).drop("passed")
