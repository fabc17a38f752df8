"""Queries that read whole inputs, beside those whose twins fix a part of them."""

from __future__ import annotations

import time

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from proofline import plans
from proofline.operators import scoring
from proofline.session import load

QUERIES = plans.queries()


def test_every_document_is_scanned(spark):
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)
    whole = load(spark, SMALL, "documents").agg(size).collect()[0][0]
    found = {name: QUERIES[name](spark, SMALL).agg(F.sum("bytes")).collect()[0][0] for name in ("s06_scan_files", "s06_scan_files_all")}
    assert found["s06_scan_files"] < found["s06_scan_files_all"] == whole


def test_orders_of_any_status_are_references(spark):
    found = {r.c_custkey for r in QUERIES["b06_orphan_audit_all"](spark, SMALL).collect()}
    orders = {r.o_custkey for r in load(spark, SMALL, "orders").collect()}
    given = {r.c_custkey for r in load(spark, SMALL, "customer").collect()}
    assert {x for x in found if x >= 0} == given - orders and min(found) < 0
    assert given - orders < {r.c_custkey for r in QUERIES["b06_orphan_audit"](spark, SMALL).collect()}


def test_failed_searches_count(spark):
    found = {r.event_type: r for r in QUERIES["d13_findability_all"](spark, SMALL).collect()}
    narrow = {r.event_type: r for r in QUERIES["d13_findability_summary"](spark, SMALL).collect()}
    for r in load(spark, SMALL, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 5).alias("bad")).collect():
        some = found[r.event_type]
        assert (some.sample, some.incorrect) == (r.n, r.bad) and some.failed == r.n - narrow[r.event_type].sample
    assert sum(r.failed for r in found.values()) > 0


def test_a_row_can_break_the_boundary_gate_only(spark):
    rows = [("block", [255] * 32 + [0] * 32, [255] * 32 + [0] * 32), ("full", [255] * 64, [255] * 64), ("dot", [0] * 63 + [255], [255] + [0] * 63)]
    planes = spark.createDataFrame(rows, "name string, alpha array<int>, truth array<int>")
    judged = scoring.threshold_gates(scoring.mask_scores(planes, "alpha", "truth", width=8), scoring.SYNTHETIC_GATES)
    found = {r.name: (r.boundary_error_px, [x.split()[0] for x in r.reasons]) for r in judged.collect()}
    assert found["block"] == (0.0, []) and found["full"] == (float("inf"), ["boundary_error_px"])
    assert found["dot"][0] == pytest.approx(98**0.5) and found["dot"][1][-1] == "boundary_error_px"


def plain_boundary(plane):
    inside = np.pad(plane >= 128, 1, constant_values=True)
    h, w = plane.shape
    beside = np.logical_or.reduce([~inside[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return np.argwhere((plane >= 128) & beside)


def plain_boundary_error(p, q):
    a, b = plain_boundary(p), plain_boundary(q)
    if not len(a) or not len(b):
        return float("inf")
    least = lambda u, v: np.mean([np.sqrt(((v - c) ** 2).sum(axis=1).min()) for c in u])
    return (least(a, b) + least(b, a)) / 2


def boundary_errors(spark, pairs):
    rows = [(i, p.ravel().tolist(), q.ravel().tolist()) for i, (p, q) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "n int, p array<int>, q array<int>")
    return {r.n: r.boundary_error_px for r in scoring.mask_scores(frame, "p", "q", width=pairs[0][0].shape[1]).collect()}


def test_boundary_error_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(np.where(rng.random((13, 17)) < share, 255, 0) for _ in range(2)) for share in (0.01, 0.05, 0.3, 0.7, 0.99, 1.0)]
    found = boundary_errors(spark, pairs)
    assert found == {i: pytest.approx(plain_boundary_error(p, q), abs=1e-9) for i, (p, q) in enumerate(pairs)}


def test_boundary_error_of_large_planes(spark):
    y, x = np.mgrid[:512, :512]
    disc = lambda cx, cy, r: np.where((x - cx) ** 2 + (y - cy) ** 2 < r * r, 255, 0)
    pairs = [(disc(250, 250, 200), disc(262, 244, 190)), (disc(40, 40, 30), disc(460, 470, 35))]
    begin = time.monotonic()
    found = boundary_errors(spark, pairs)
    assert time.monotonic() - begin < 60
    assert found == {i: pytest.approx(plain_boundary_error(p, q), abs=1e-9) for i, (p, q) in enumerate(pairs)}


def test_a_ledger_cut_after_its_first_record_has_a_wrong_final_hash(spark):
    turns = load(spark, SMALL, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("conv_id % 10 = 7 and n = 2")
    found = {r.ledger for r in QUERIES["b09_chain_audit_all"](spark, SMALL).where("code = 'final-hash' and ledger % 10 = 7").collect()}
    assert found == {r.conv_id for r in turns.collect()} and found
