"""Closed schemas, required parts, typed values and gates on documents and packages."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed
from proofline.functions.documents import kind_at, text_at, value_at, with_document
from proofline.operators.sequence import numbered, ordered

# Manifest paths that must be present and neither null nor empty.
REQUIRED_MANIFEST_PATHS = (
    "source.url",
    "source.platform",
    "source.video_id",
    "source.title",
    "source.duration_seconds",
    "access.probe_attempts",
    "access.paywall_outcome",
    "access.drm_outcome",
    "captions.tracks",
    "transcription.used",
    "lineage.source_authority",
    "lineage.source_corrected",
    "lineage.chinese_from",
    "lineage.english_from",
)
DECISION_MODES = ("unattended", "interactive")
NUMERIC = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def truthy_at(v: Column, path: str) -> Column:
    """False for absent, null, false, zero, and empty text, list or object; true for any other value."""
    kind, text = kind_at(v, path), text_at(v, path)
    told = (
        F.when(kind == "BOOLEAN", text == "true").when(kind.rlike(NUMERIC), value_at(v, path, "double") != 0)
        .when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}").when(kind == "STRING", text != "")
    )
    return F.coalesce(told, F.lit(False))


def closed_keys(docs: DataFrame, raw: str, allowed: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Unknown and missing keys of a text that is exactly one JSON object; anything else is no object and lacks all of ``required``."""
    parsed = with_document(docs, raw)
    is_object = F.coalesce(kind_at(F.col("_v")).startswith("OBJECT"), F.lit(False))
    keys = F.when(F.col("is_object"), F.json_object_keys(raw)).otherwise(F.array().cast("array<string>"))
    known = F.array(*[F.lit(k) for k in allowed])
    needed = F.array(*[F.lit(k) for k in required])
    return parsed.withColumn("is_object", is_object).drop("_v").withColumn(
        "unknown_keys", F.array_sort(F.array_except(keys, known))
    ).withColumn("missing_keys", F.array_sort(F.array_except(needed, keys)))


def required_paths(docs: DataFrame, raw: str, paths: Sequence[str]) -> DataFrame:
    """Dotted paths whose value is absent, null or the empty string, in the given order."""
    parsed = with_document(docs, raw)
    gaps = [F.when(F.coalesce(text_at(F.col("_v"), p), F.lit("")) == "", F.lit(p)) for p in paths]
    return parsed.withColumn("missing", listed(*gaps)).drop("_v")


def manifest_gaps(docs: DataFrame, raw: str) -> DataFrame:
    """Required paths plus the typed rules of a transcript package manifest."""
    parsed = with_document(docs, raw)
    v = F.col("_v")

    def filled_array(path: str) -> Column:
        return F.coalesce(kind_at(v, path).startswith("ARRAY<") & (text_at(v, path) != "[]"), F.lit(False))

    duration = "source.duration_seconds"
    numeric = kind_at(v, duration).rlike(NUMERIC)
    positive = F.coalesce(numeric & (value_at(v, duration, "double") > 0), F.lit(False))
    typed = [
        F.when(~F.coalesce(text_at(v, "decision_mode"), F.lit("")).isin(*DECISION_MODES), "decision_mode"),
        F.when(~filled_array("transitions"), "transitions"),
        F.when(~filled_array("access.probe_attempts"), "access.probe_attempts"),
        F.when(~positive, duration),
        F.when(~exclusive(truthy_at(v, "captions.selected"), truthy_at(v, "transcription.used")), "source_branch"),
    ]
    gaps = [F.when(F.coalesce(text_at(v, p), F.lit("")) == "", F.lit(p)) for p in REQUIRED_MANIFEST_PATHS]
    return parsed.withColumn("missing", listed(*typed, *gaps)).drop("_v")


def exclusive(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))


def exclusive_branch(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Exactly one of two branches selected."""
    return df.withColumn("branch_ok", exclusive(a, b))


# Smallest suite sizes and rubric sizes.
SUITE_MINIMUMS = {"positive": 40, "negative": 16, "must": 5, "must_not": 3}


def suite_gates(cases: DataFrame, suite: str, tracks: int) -> DataFrame:
    """Per suite: counts, unique ids, one case for every track, and strong rubrics."""
    weak = (F.size("must") < SUITE_MINIMUMS["must"]) | (F.size("must_not") < SUITE_MINIMUMS["must_not"])
    inside = F.when(F.col("track_id").between(1, tracks), F.col("track_id"))
    stats = cases.groupBy(suite).agg(
        F.count_if("should_trigger").alias("positive"), F.count_if(~F.col("should_trigger")).alias("negative"),
        F.count(F.lit(1)).alias("cases"), F.count_distinct("case_id").alias("ids"),
        F.count_distinct(inside).alias("tracks_covered"), F.count_if(weak).alias("weak_rubrics"),
    )
    failed = F.concat_ws(
        ",",
        F.when(F.col("positive") < SUITE_MINIMUMS["positive"], "too few positive"),
        F.when(F.col("negative") < SUITE_MINIMUMS["negative"], "too few negative"),
        F.when(F.col("ids") != F.col("cases"), "repeated ids"),
        F.when(F.col("tracks_covered") != tracks, "tracks not covered"),
        F.when(F.col("weak_rubrics") > 0, "weak rubrics"),
    )
    return stats.withColumn("failed_gates", failed)


def required_artifacts(
    packages: DataFrame, files: DataFrame, package: str, rules: Sequence[tuple[str, Column]], size: str = "bytes"
) -> DataFrame:
    """Required paths that are absent or empty; each rule is (path, condition on the package)."""
    wanted = F.filter(
        F.array(*[F.when(when, F.struct(F.lit(i).alias("rule"), F.lit(p).alias("path"))) for i, (p, when) in enumerate(rules)]),
        lambda r: r.isNotNull(),
    )
    needed = packages.select(package, F.inline(wanted))
    return needed.join(files.where(F.col(size) > 0).select(package, "path"), on=[package, "path"], how="left_anti")


def package_status(packages: DataFrame, missing: DataFrame, package: str, order: Sequence[str]) -> DataFrame:
    """Complete or incomplete per package, with one row per missing item in its order."""
    listed = numbered(ordered(missing, [package], order), "position", size="missing_count").plain()
    joined = packages.select(package).distinct().join(listed, on=package, how="left")
    return joined.withColumn("missing_count", F.coalesce("missing_count", F.lit(0)).cast("bigint")).withColumn(
        "status", F.when(F.col("missing_count") == 0, "complete").otherwise("incomplete")
    )


def state_evidence_gate(deliveries: DataFrame) -> DataFrame:
    """Reasons why a delivery status lacks the evidence it requires."""
    status, scope = F.col("status"), F.col("scope")
    runtime = status.isin("runtime-metadata-complete", "runtime-verified")
    reasons = listed(
        F.when(~scope.isin("required", "not-requested") | scope.isNull(), "scope is invalid"),
        F.when((status == "package-ready") & (scope != "not-requested"), "scope must be not-requested"),
        F.when(runtime & (scope != "required"), "scope must be required"),
        F.when(runtime & (F.col("contract").isNull() | F.col("projection").isNull()), "contract and projection required"),
        F.when((status == "runtime-verified") & F.col("proof").isNull(), "proof required"),)
    return deliveries.withColumn("reasons", reasons)


def evidence_key_audit(records: DataFrame, keys: str, sources: DataFrame, source_key: str) -> DataFrame:
    """Usage count of every cited key and whether the bibliography knows it."""
    cited = records.select(F.explode(F.split(keys, r",\s*")).alias("evidence_key")).where("evidence_key <> ''")
    used = cited.groupBy("evidence_key").agg(F.count(F.lit(1)).alias("uses"))
    known = sources.select(F.col(source_key).alias("evidence_key"), F.lit(True).alias("_known")).distinct()
    joined = used.join(known, on="evidence_key", how="full_outer")
    status = F.when(F.col("_known").isNull(), "unresolved").when(F.col("uses").isNull(), "unused").otherwise("resolved")
    return joined.select("evidence_key", F.coalesce("uses", F.lit(0)).alias("uses"), status.alias("status"))


def vocabulary_audit(docs: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Forbidden terms found anywhere in the whole text, ignoring case."""
    low = F.lower(text)
    hits = listed(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms])
    return docs.withColumn("forbidden_terms", hits)


@dataclass(frozen=True)
class ValueRule:
    """A typed rule on one JSON path; ``kind`` is string, boolean, integer, array, enum, point or box."""

    path: str
    kind: str
    minimum: int | None = None
    maximum: int | None = None
    domain: tuple[str, ...] = ()


#: Whole numbers of more than 38 digits are read as inexact ones, and those beyond 64 bits have no bounds to be in.
_BEYOND, _LONG = 10**38, 1 << 63


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is repeated")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Made once: json.loads with a hook makes a decoder for each document.
_DECODER = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_no_constant)


def flattened(raw: str | None, paths: frozenset[str]) -> dict[str, object]:
    """Values of a document by dotted path, from one parse; only ways that lead to ``paths`` are followed.  Nothing if the text is not one JSON value."""
    try:
        document = _DECODER.decode(raw or "")
    except (ValueError, RecursionError):
        return {}
    found: dict[str, object] = {}
    todo = [("", document)]
    while todo:
        prefix, node = todo.pop()
        for name, value in node.items() if isinstance(node, dict) else ():
            path = prefix + name
            if path in paths:
                found[path] = value
                if isinstance(value, dict):
                    todo.append((path + ".", value))
    return found


def _whole(value: object) -> bool:
    """A number written without fraction or exponent; booleans are none."""
    return type(value) is int and -_BEYOND < value < _BEYOND


def _fits(rule: ValueRule, x: object, canvas: tuple[int, int]) -> bool:
    if rule.kind == "string":
        return isinstance(x, str) and 1 <= len(x) <= (rule.maximum or 4096)
    if rule.kind == "boolean":
        return isinstance(x, bool)
    if rule.kind == "integer":
        bounded = rule.minimum is not None or rule.maximum is not None
        return _whole(x) and not (bounded and not -_LONG <= x < _LONG) and (rule.minimum is None or x >= rule.minimum) and (rule.maximum is None or x <= rule.maximum)
    if rule.kind == "enum":
        return isinstance(x, str) and x in rule.domain
    if rule.kind == "array":
        return isinstance(x, list) and (rule.minimum or 0) <= len(x) <= (rule.maximum or 256)
    numbers = isinstance(x, list) and all(_whole(n) and -_LONG <= n < _LONG for n in x)
    if rule.kind == "point":
        return numbers and len(x) == 2
    return numbers and len(x) == 4 and 0 <= x[0] < x[2] <= canvas[0] and 0 <= x[1] < x[3] <= canvas[1]


def value_domain_audit(docs: DataFrame, raw: str, rules: Sequence[ValueRule], canvas: tuple[int, int] = (0, 0)) -> DataFrame:
    """Paths whose value breaks its rule; booleans are never accepted as integers, nor is 3.0.

    A document is parsed once, in Arrow batches, and every rule looks its value up.  Reading the values by expressions instead parses
    the text once for the variant and again for each number's spelling, which a variant does not keep.  A text that is not exactly one
    JSON value, or repeats a key, breaks all rules.
    """
    steps = frozenset(".".join(parts[: i + 1]) for r in rules for parts in [r.path.split(".")] for i in range(len(parts)))

    @F.pandas_udf("array<string>")
    def broken(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            values = flattened(text, steps)
            out.append([r.path for r in rules if r.path not in values or not _fits(r, values[r.path], canvas)])
        return pd.Series(out)

    return docs.withColumn("breaches", broken(F.col(raw).cast("string"))).select(*docs.columns, "breaches")
