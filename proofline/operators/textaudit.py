"""Text and markup audits; every rule sees the whole text of a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed
from proofline.functions.text import count_matches, lines, strip, word_count
from proofline.operators.sequence import islands, ordered, scan

# Limits and labels of the text contracts.
WORD_BUDGET = 3800
SHORTEST_DESCRIPTION = 120
LONGEST_ASSET = 12 * 1024 * 1024
HEADING = r"(?U)^\s*(#{1,6})\s"
PLACEHOLDER = r"\[[A-Za-z][^\[\]\n]*\]"
LINKED = PLACEHOLDER + r"\("
PROVENANCE = {
    "verified": r"\[Verified \d{4}-\d{2}-\d{2} \d{2}:\d{2} [A-Za-z0-9+:/_-]+\]",
    "existing": r"\[Existing evidence, not reverified this turn\]",
    "inference": r"\[Inference\]",
    "unknown": r"\[Unknown\]",
}
INAUDIBLE = r"\[inaudible (\d{2}:\d{2}:\d{2})\]"
RECORD_FIELDS = {
    "track": "Track",
    "pass": "Pass",
    "category": "Category",
    "objective": "Objective",
    "defect": "Defect",
    "change": "Change",
    "acceptance": "Acceptance",
    "runtime_check": "Runtime check",
    "evidence_keys": "Evidence keys",
    "targets": "Targets",
    "previous_hash": "Previous hash",
    "chain_hash": "Chain hash",
}
# Kinds of values that must never be delivered, as patterns over whole texts.
SENSITIVE = {
    "cookie": r"(?i)\b(?:set-)?cookie\s*:\s*[^\s;=]+=[^\s;]+",
    "authorization": r"(?i)\bauthorization\s*:\s*\S+|\bbearer\s+[A-Za-z0-9._~+/-]{16,}",
    "account": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "signed-url": r"(?i)https?://[^\s\"'<>]+[?&](?:x-amz-signature|signature|sig|token|expires)=[^\s\"'<>]+",
    "credential": r"(?i)\b(?:password|passwd|secret|api[_-]?key|access[_-]?token|token)\s*[:=]\s*\S+|\bAKIA[0-9A-Z]{16}\b|\bghp_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{16,}",
}
REDACTED = "[redacted]"
# A cheap literal every match of the rule contains, so most texts never reach the pattern.
SENSITIVE_HINTS = {
    "cookie": ("cookie",),
    "authorization": ("authorization", "bearer"),
    "account": ("@",),
    "signed-url": ("://",),
    "credential": ("passw", "secret", "key", "token", "akia", "ghp_", "sk-"),
}


def front_matter(docs: DataFrame, text: str) -> DataFrame:
    """Leading ``---`` block as a map; later keys win, lines without a colon are ignored."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    has = F.col(text).rlike(r"(?s)\A---\n.*?\n---\n")
    rows = F.filter(lines(block), lambda l: l.contains(":"))

    def entry(line: Column, i: Column) -> Column:
        value = F.regexp_replace(strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)), r'^"+|"+$', "")
        return F.struct(
            strip(F.split_part(line, F.lit(":"), F.lit(1))).alias("key"), i.alias("at"), F.regexp_replace(value, r"^'+|'+$", "").alias("value")
        )

    # sorted by key and place, the last entry of each key is the one before another key
    parsed = docs.withColumn("_e", F.array_sort(F.transform(rows, entry)))
    last = F.filter("_e", lambda e, i: ~F.coalesce(F.get("_e", i + 1)["key"] == e["key"], F.lit(False)))
    in_order = F.transform(F.array_sort(F.transform(last, lambda e: F.struct(e["at"], e["key"], e["value"]))), lambda e: F.struct(e["key"], e["value"]))
    return parsed.withColumn("front", F.when(has, F.map_from_entries(in_order))).drop("_e")


def required_terms(docs: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    low = F.lower(text)
    absent = listed(*[F.when(~low.contains(t.lower()), F.lit(t)) for t in terms])
    return docs.withColumn("missing_terms", absent)


def word_budget(docs: DataFrame, text: str, description: str | None = None, budget: int = WORD_BUDGET) -> DataFrame:
    out = docs.withColumn("words", word_count(F.col(text)).cast("bigint"))
    out = out.withColumn("over_budget", F.col("words") > budget)
    if description:
        out = out.withColumn("vague", F.length(F.coalesce(description, F.lit(""))) < SHORTEST_DESCRIPTION)
    return out


def heading_levels(docs: DataFrame, text: str) -> DataFrame:
    """Ordered Markdown heading levels; fenced code is not excluded."""
    clean = F.regexp_replace(text, r"^\uFEFF", "")
    marks = F.transform(lines(clean), lambda l: F.length(F.regexp_extract(l, HEADING, 1)))
    return docs.withColumn("levels", F.filter(marks, lambda n: n > 0))


def html_heading_levels(docs: DataFrame, html: str) -> DataFrame:
    marks = F.regexp_extract_all(html, F.lit("(?i)<h([1-6])[\\s>]"), F.lit(1))
    return docs.withColumn("levels", F.transform(marks, lambda m: m.cast("int")))


def parallel_structure(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Two versions must share one non-empty heading sequence."""
    both = left.select(*on, F.col("levels").alias("_l")).join(right.select(*on, F.col("levels").alias("_r")), on=list(on))
    return both.select(*on, ((F.size("_l") > 0) & (F.col("_l") == F.col("_r"))).alias("parallel"))


def parse_records_md(docs: DataFrame, text: str) -> DataFrame:
    """Fields of bold-label bullets plus the iteration number of the title; absent labels are null."""
    def field(label: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?m)^- \*\*{label}(?: \d+)?:\*\* `?(.*?)`?$", 1), F.lit(""))

    def number(label: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?m)^- \*\*{label} (\d+):\*\*", 1), F.lit("")).cast("int")

    return docs.select(
        "*", F.nullif(F.regexp_extract(text, r"(?m)^# Iteration (\d+)", 1), F.lit("")).cast("int").alias("iteration"),
        number("Track").alias("track_id"), number("Pass").alias("pass_id"),
        *[field(label).alias(name) for name, label in RECORD_FIELDS.items()],
    )


def markup_safety(docs: DataFrame, html: str) -> DataFrame:
    """Active elements, event attributes, references that leave the file, and a missing viewBox."""
    refs = F.regexp_extract_all(html, F.lit(r"(?i)[\s:](?:href|src)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    outside = F.filter(refs, lambda r: ~r.startswith("#") & ~r.startswith("data:"))
    root = F.regexp_extract(html, r"(?is)<svg\b[^>]*>", 0)
    out = docs.select(
        "*", count_matches(F.col(html), r"<(?:[A-Za-z_][\w.-]*:)?(?:script|foreignObject)\b").alias("active_elements"),
        count_matches(F.col(html), r"(?i)<[A-Za-z][^<>]*\s(?:[\w.-]+:)?on\w+\s*=").alias("event_attributes"),
        F.size(outside).cast("bigint").alias("external_references"),
        ((root != "") & ~root.contains("viewBox")).alias("no_view_box"),
    )
    safe = (F.col("active_elements") + F.col("event_attributes") + F.col("external_references")) == 0
    return out.withColumn("self_contained", safe)


def signature_audit(files: DataFrame, path: str, content: str) -> DataFrame:
    """First bytes against the suffix, emptiness and the size limit."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    head = F.hex(F.substring(content, 1, 12))
    size = F.octet_length(content)
    matches = (
        F.when(suffix == ".png", head.startswith("89504E470D0A1A0A"))
        .when(suffix.isin(".jpg", ".jpeg"), head.startswith("FFD8"))
        .when(suffix == ".webp", head.rlike("^52494646.{8}57454250$"))
        .when(suffix == ".svg", F.lit(True)).otherwise(F.lit(False))
    )
    problem = (
        F.when(~suffix.isin(".svg", ".png", ".jpg", ".jpeg", ".webp"), "unsupported type").when(size == 0, "empty")
        .when(size > LONGEST_ASSET, "too large").when(~matches, "signature mismatch").otherwise("ok")
    )
    return files.withColumn("signature_status", problem)


def placeholder_audit(docs: DataFrame, text: str) -> DataFrame:
    """Unresolved placeholders make a prompt provisional: then one to three questions, otherwise none."""
    found = count_matches(F.col(text), PLACEHOLDER) - count_matches(F.col(text), LINKED)
    out = docs.withColumn("placeholders", found).withColumn("questions", count_matches(F.col(text), r"\?"))
    provisional = F.col("placeholders") > 0
    fits = F.when(provisional, F.col("questions").between(1, 3)).otherwise(F.col("questions") == 0)
    return out.withColumn("state", F.when(provisional, "provisional").otherwise("copy-ready")).withColumn("questions_fit", fits)


def provenance_labels(claims: DataFrame, doc: str, text: str, stale_before: str) -> DataFrame:
    """Per document: claims by label, claims without exactly one label, and verified claims gone stale."""
    counts = {name: count_matches(F.col(text), pattern) for name, pattern in PROVENANCE.items()}
    labelled = claims.select(doc, text, *[c.alias(f"_{n}") for n, c in counts.items()])
    labels = sum((F.col(f"_{n}") for n in PROVENANCE), F.lit(0))
    when = F.regexp_extract(text, r"\[Verified (\d{4}-\d{2}-\d{2} \d{2}:\d{2}) ", 1)
    one = labelled.withColumn("_one", labels == 1).withColumn("_when", when)
    return one.groupBy(doc).agg(
        F.count(F.lit(1)).alias("claims"),
        *[F.count_if(F.col("_one") & (F.col(f"_{n}") == 1)).alias(n) for n in PROVENANCE],
        F.count_if(~F.col("_one")).alias("badly_labelled"),
        F.count_if(F.col("_one") & (F.col("_verified") == 1) & (F.col("_when") < stale_before)).alias("stale"),
    )


def _hinted(rule: str) -> Column:
    """Whether the lower-cased text can match a rule at all; rules without hints always can."""
    hints = SENSITIVE_HINTS.get(rule)
    if hints is None:
        return F.lit(True)
    found = F.lit(False)
    for hint in hints:
        found = found | F.col("_low").contains(hint)
    return found


def sensitive_scan(df: DataFrame, text: str, rules: Mapping[str, str] = SENSITIVE) -> DataFrame:
    """Number of hits per kind of sensitive value, never the values themselves."""
    low = df.withColumn("_low", F.lower(text))
    out = low.select("*", *[
        F.when(_hinted(n), count_matches(F.col(text), p)).otherwise(F.lit(0).cast("bigint")).alias(f"hits_{n.replace('-', '_')}")
        for n, p in rules.items()
    ]).drop("_low")
    hits = sum((F.col(f"hits_{n.replace('-', '_')}") for n in rules), F.lit(0))
    return out.withColumn("hits", hits)


def redact(df: DataFrame, text: str, rules: Mapping[str, str] = SENSITIVE) -> DataFrame:
    out = df.withColumn("_low", F.lower(text)).withColumn("redacted", F.col(text))
    for name, pattern in rules.items():
        out = out.withColumn("redacted", F.when(
            _hinted(name), F.regexp_replace("redacted", pattern, REDACTED)).otherwise(F.col("redacted")))
    return out.drop("_low")


def inaudible_markers(docs: DataFrame, text: str) -> DataFrame:
    """Time-stamped uncertainty markers, counted and listed in order as seconds."""
    stamps = F.regexp_extract_all(text, F.lit(INAUDIBLE), F.lit(1))

    def seconds(stamp: Column) -> Column:
        part = F.split(stamp, ":")
        return part[0].cast("bigint") * 3600 + part[1].cast("bigint") * 60 + part[2].cast("bigint")

    return docs.withColumn("marker_seconds", F.transform(stamps, seconds)).withColumn("markers", F.size("marker_seconds").cast("bigint"))


def repeat_collapse_candidates(
    cues: DataFrame, keys: Sequence[str], order: str, text: str, duration_ms: str, max_rate: float
) -> DataFrame:
    """Runs of equal consecutive cues whose text cannot fit its time span at ``max_rate`` characters a second."""
    base = cues.select(*keys, order, F.sha2(F.col(text).cast("binary"), 256).alias("_sha"), F.length(text).cast("bigint").alias("_chars"), duration_ms)
    seq = scan(ordered(base, keys, [order]), prev={"_before": "_sha"})
    runs = islands(seq, ~F.coalesce(F.col("_sha") == F.col("_before"), F.lit(False)), "run").plain()
    grouped = runs.groupBy(*keys, "run").agg(
        F.min(order).alias("first_cue"), F.max(order).alias("last_cue"), F.count(F.lit(1)).alias("cues"),
        F.sum("_chars").alias("chars"), F.sum(duration_ms).alias("span_ms"),
    ).where("cues > 1")
    return grouped.withColumn("cannot_fit", F.col("chars") * 1000.0 > F.col("span_ms") * max_rate)
