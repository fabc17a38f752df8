"""Quality rules over text statistics, with robust multivariate outliers per language and source.

The base rules reject short and repetitive texts.  For the others, a vector of transformed statistics is compared to a
minimum-covariance-determinant (MCD) estimate of its group: concentration steps over all rows keep the half of the group
with the smallest Mahalanobis distances until it no longer changes; then the estimate is made consistent and, with the
rows inside its tolerance ellipsoid, re-weighted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.session import cut

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SLICE = 512
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that continue a UTF-8 character
_SPACE = b" \t\n\v\f\r"


def statistics_of(text: bytes) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of a UTF-8 text; words are runs of bytes other than space and \\t to \\r."""
    words = text.split()  # bytes split at exactly these
    n = len(words)
    chars = len(text.translate(None, _FOLLOWING + _SPACE))
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        names: dict[bytes, int] = {}
        codes = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=n)
        if len(names) < n:
            # a window by its word pair's number and its last word, so that no product leaves 64 bits
            pairs = np.unique(codes[:-1] * len(names) + codes[1:], return_inverse=True)[1].astype(np.int64)
            _, which, times = np.unique(pairs[:-1] * len(names) + codes[2:], return_inverse=True, return_counts=True)
            again = times[which] > 1
            if again.any():
                inside = np.zeros(n, dtype=bool)
                for k in range(3):
                    inside[k : n - 2 + k] |= again
                repeated = int(inside.sum())
    return n, chars, symbols, dup, repeated


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, lang, source and ``COUNTS`` (long) of whole texts; a null text has no words."""
    rows = docs.select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    kind = rows.schema["key"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                found = np.asarray([statistics_of(x) for x in some.column(3).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), some.column(2), *(pa.array(x) for x in found.T)], names=["key", "lang", "source", *COUNTS],
                )

    return rows.mapInArrow(count, f"key {kind}, lang string, source string, " + ", ".join(f"{x} long" for x in COUNTS))


# ---- robust outliers ----------------------------------------------------------------------------

#: Rows that pass the base rules a (language, source) group needs for an estimate of its own; smaller groups are judged together, first
#: within their language, then all together.
GROUP_ROWS = 100
#: Rows below which nothing is judged.
LEAST_ROWS = 20
#: The chance that a row of a normal group lies beyond the cut.
TAIL = 1e-6
#: Concentration steps at most; they stop before when no determinant gets smaller.
STEPS = 20
#: Features are whole multiples of 1 / UNIT, so that sums are exact and do not depend on the order of rows.
UNIT = 1024
#: Features: log(1 + words), mean word length, log(1 + symbols per 100 words), log(1 + repeated lines per 100 words), share of
#: repeated words; and for each the standard deviation that is added to every estimate, as most groups have no symbol or repeat at all.
FEATURES = {"f0": 0.5, "f1": 0.3, "f2": 0.3, "f3": 0.35, "f4": 0.1}
P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_cdf(x: float, k: int) -> float:
    """Chance of at most x under chi-square with k degrees of freedom (series of the incomplete gamma function)."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    a, y, n = k / 2, x / 2, 0
    term = total = 1 / a
    while term > total * 1e-16:
        n += 1
        term *= y / (a + n)
        total += term
    return total * exp(a * log(y) - y - lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return high


def _features(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    exact = (
        F.log1p("n_words"), F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n), F.col("n_repeat_words") / n,
    )
    return rows.withColumns({name: F.round(x * UNIT).cast("long") for name, x in zip(FEATURES, exact)})


def _grouped(rows: DataFrame) -> DataFrame:
    """``team``: the group a row is judged in."""
    name = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c)))
    named = rows.withColumns({"_l": name("lang"), "_s": name("source")})
    sizes = cut(named.where(~F.col("base_failed")).groupBy("_l", "_s").agg(F.count("*").alias("n")))
    small = sizes.where(F.col("n") < GROUP_ROWS).groupBy("_l").agg(F.sum("n").alias("m"))
    teams = sizes.join(small, "_l", "left").select(
        "_l", "_s",
        F.when(F.col("n") >= GROUP_ROWS, F.to_json(F.array("_l", "_s"))).when(F.col("m") >= GROUP_ROWS, F.to_json(F.array("_l"))).otherwise(F.lit("[]")).alias("team"),
    )
    return named.join(cut(teams), ["_l", "_s"], "left").drop("_l", "_s")


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group's ``centre`` and ``inverse`` (upper triangle, row by row)."""
    off = [F.col(name) / F.lit(float(UNIT)) - F.col("centre")[i] for i, name in enumerate(FEATURES)]
    total = F.lit(0.0)
    for at, (i, j) in enumerate(_PAIRS):
        total = total + F.col("inverse")[at] * off[i] * off[j] * (1.0 if i == j else 2.0)
    return F.greatest(F.lit(0.0), total)


def _estimate(n: int, sums, products, factor: float):
    """Centre, inverse of the scaled and floored covariance, and its log determinant."""
    mean = np.array([x / n for x in sums], dtype=np.float64) / UNIT
    cov = np.zeros((P, P))
    for (i, j), x in zip(_PAIRS, products):
        cov[i, j] = cov[j, i] = (n * x - sums[i] * sums[j]) / (n * n * UNIT * UNIT)  # whole numbers up to the division, so that nothing cancels
    cov = factor * cov + np.diag([x * x for x in FEATURES.values()])
    inverse = np.linalg.inv(cov)
    return mean.tolist(), [float(inverse[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])


_ESTIMATES = "team string, centre array<double>, inverse array<double>, logdet double, better boolean"


def _concentrate(rows: DataFrame, estimates: DataFrame, share: float | None, within: float, factor: float) -> DataFrame:
    """New estimates from the ``share`` of each group with the smallest distances (to the end of its bin), or from all with at most ``within``.

    With a ``share``, a group keeps its old estimate unless the new one's determinant is smaller; ``better`` tells which.  Counts, sums and products are added up per group and bin of distance, with map-side combine: a group gives a few hundred rows, whatever its size.
    """
    binned = rows.join(estimates.select("team", "centre", "inverse"), "team").withColumn("d", distance())
    fine = F.least(F.lit(2000), F.floor(F.log1p("d") * 100)).cast("int")
    if share is None:
        binned, fine = binned.where(F.col("d") <= within), F.lit(0)
    wide = {name: F.col(name).cast("decimal(19,0)") for name in FEATURES}  # squares of long words pass 64 bits
    added = binned.groupBy("team", fine.alias("bin")).agg(
        F.count("*").alias("n"), *(F.sum(x).alias(name) for name, x in wide.items()),
        *(F.sum(wide[f"f{i}"] * wide[f"f{j}"]).alias(f"p{i}{j}") for i, j in _PAIRS),
    )
    columns = ["n", *FEATURES, *(f"p{i}{j}" for i, j in _PAIRS)]

    def solve(group: pa.Table, old: pa.Table) -> pa.Table:
        if not group.num_rows:  # no row within the ellipsoid: nothing to estimate from
            return old.slice(0, 0).append_column("better", pa.array([], pa.bool_()))
        group = group.sort_by("bin")
        table = np.array([[int(v) for v in group[x].to_pylist()] for x in columns], dtype=object)  # whole numbers of any size
        n = np.cumsum(table[0]).astype(np.int64)
        upto = len(n) if share is None else int(np.searchsorted(n, share * n[-1], side="left")) + 1
        total = table[:, :upto].sum(axis=1)
        part = 1.0 if share is None else total[0] / n[-1]
        centre, inverse, logdet = _estimate(int(total[0]), total[1 : P + 1], total[P + 1 :], factor if share is None else _consistency(part))
        better = share is None or logdet < old["logdet"][0].as_py() - 1e-9
        if not better:
            return old.append_column("better", pa.array([False], pa.bool_()))
        return pa.table({
            "team": group["team"].slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())),
            "inverse": pa.array([inverse], pa.list_(pa.float64())), "logdet": pa.array([logdet], pa.float64()),
            "better": pa.array([True], pa.bool_()),
        })

    known = estimates.select("team", "centre", "inverse", "logdet").groupBy("team")
    return cut(added.groupBy("team").cogroup(known).applyInArrow(solve, _ESTIMATES))


def _consistency(part: float) -> float:
    """Factor that makes the covariance of the innermost part of a normal group consistent."""
    if part >= 1:
        return 1.0
    return part / chi2_cdf(chi2_quantile(part, P), P + 2)


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each feature; features are whole numbers of a small range, so exact percentiles stay small."""
    told = rows.groupBy("team").agg(*(F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(name) for name in FEATURES))
    centre = F.array(*(F.col(name)[1] / UNIT for name in FEATURES))
    variance = [F.pow((F.col(name)[2] - F.col(name)[0]) / (1.349 * UNIT), 2) + floor**2 for name, floor in FEATURES.items()]
    inverse = F.array(*(1 / variance[i] if i == j else F.lit(0.0) for i, j in _PAIRS))
    return cut(told.select("team", centre.alias("centre"), inverse.alias("inverse"), F.lit(float("inf")).alias("logdet")))


def judge(docs: DataFrame, tail: float = TAIL, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, ``COUNTS``, base_failed, distance (squared; null where nothing was judged) and kept of every row.

    Texts of fewer than 50 words or with over half their words in repeated three-word windows fail the base rules.  The other rows are kept unless their
    squared distance to the robust estimate of their group exceeds the chi-square quantile at ``1 - tail``.  Null languages and sources are values like any
    other; null and empty texts fail; equal rows get equal verdicts; groups that stay below ``LEAST_ROWS`` rows are kept; an empty table gives no rows;
    other columns stay out, whatever their names.  All statistics use all rows.
    """
    counted = statistics(docs, key, text, lang, source)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(_grouped(cut(_features(counted.withColumn("base_failed", failed)))))
    judged = rows.where(~F.col("base_failed"))
    estimates = _start(judged)
    for _ in range(STEPS):
        estimates = _concentrate(judged, estimates, 0.5, 0.0, 1.0)
        if estimates.where("better").isEmpty():
            break
    inner = chi2_quantile(0.975, P)
    estimates = _concentrate(judged, estimates, None, inner, 0.975 / chi2_cdf(inner, P + 2))
    sizes = judged.groupBy("team").agg(F.count("*").alias("team_rows"))
    final = cut(estimates.join(sizes, "team").where(F.col("team_rows") >= LEAST_ROWS).select("team", "centre", "inverse"))
    found = rows.join(final, "team", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > chi2_quantile(1 - tail, P), F.lit(False))
    return found.select(F.col("key").alias(key), *COUNTS, "base_failed", "distance", kept.alias("kept"))
