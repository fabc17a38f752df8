"""Ordered scans against plain windows, balance under a hot key, exact quantiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from proofline.operators.sequence import CHUNK, exact_quantiles, islands, numbered, ordered, scan


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 41)
    return spark.range(3000).select(hot.alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 5 == 0, F.col("id") * 7 % 101).alias("v")).cache()


def frame(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_scan_equals_windows(rows, parts):
    got = scan(
        ordered(rows, ["k"], ["o"], parts), prev={"p": "v"}, next={"n": "o"}, before_sum={"s": "o"}, before_max={"m": "v"},
        before_valid={"b": "v"}, after_valid={"a": "v"}, total={"t": "o"}, first={"f": "v"}, last={"l": "o"},
    ).plain()
    w = Window.partitionBy("k").orderBy("o")
    back, ahead, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("k")
    want = rows.select(
        "k", "o", "v", F.lag("v").over(w).alias("p"), F.lead("o").over(w).alias("n"), F.coalesce(F.sum("o").over(back), F.lit(0)).alias("s"),
        F.max("v").over(back).alias("m"), F.last("v", True).over(back).alias("b"), F.first("v", True).over(ahead).alias("a"),
        F.sum("o").over(whole).alias("t"), F.first("v").over(w).alias("f"), F.max("o").over(whole).alias("l"),
    )
    key = [c for c in want.columns]
    assert frame(got.select(*key).fillna(-1)) == frame(want.fillna(-1))


def test_hot_key_is_spread_over_chunks(rows):
    sizes = [r["count"] for r in ordered(rows, ["k"], ["o"], 8).df.groupBy(CHUNK).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 3000 / 8 * 2


def test_row_order_and_partitioning_do_not_matter(rows):
    shuffled = rows.repartition(5, "o").orderBy(F.desc("o"))
    a = islands(ordered(rows, ["k"], ["o"], 3), F.col("o") % 4 == 0).plain()
    b = islands(ordered(shuffled, ["k"], ["o"], 6), F.col("o") % 4 == 0).plain()
    assert frame(a.fillna(-1)) == frame(b.fillna(-1))


def test_numbering_without_keys(rows):
    got = numbered(ordered(rows, [], ["o"], 5), "rn", size="n").plain()
    assert got.where("rn <> o + 1 or n <> 3000").count() == 0


def test_a_large_key_switches_to_chunks(spark, rows):
    assert not ordered(rows, ["k"], ["o"]).chunked
    spark.conf.set("spark.proofline.maxRowsPerKey", "900")
    try:
        seq = ordered(rows, ["k"], ["o"])
        assert seq.chunked and seq.df.select(CHUNK).distinct().count() > 1
    finally:
        spark.conf.unset("spark.proofline.maxRowsPerKey")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    data = [(int(i % 3), float(v)) for i, v in enumerate(rng.integers(0, 40, 400) / 8)]
    out = exact_quantiles(spark.createDataFrame(data, "k int, v double"), ["k"], "v", {"m": 0.5, "p30": 0.3, "p95": 0.95}).collect()
    for row in out:
        values = [v for k, v in data if k == row["k"]]
        assert np.allclose([row["m"], row["p30"], row["p95"]], np.quantile(values, [0.5, 0.3, 0.95]))
