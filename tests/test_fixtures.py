"""Hand-made cases: tracks, cues, manifests, ledgers, reviews, texts, sources."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from proofline.functions.hashing import canonical_json, canonical_json_text, sha256
from proofline.operators import contracts, geometry, integrity, ledger, positions, reviews, scoring, textaudit, tracks
from proofline.sources import files as io

FMT = "struct<ext:string,name:string,is_original:boolean,default:boolean>"
META = f"id string, language string, original_language string, default_subtitle_language string, subtitles map<string,array<{FMT}>>, automatic_captions map<string,array<{FMT}>>"


def fmt(ext="vtt", name="", original=False, default=False):
    return (ext, name, original, default)


def choose(spark, meta, coverage=()):
    rows = tracks.explode_tracks(spark.createDataFrame([meta], META)).withColumnRenamed("id", "video_id")
    measured = spark.createDataFrame([*coverage, ("-", 0, 0)], "key string, covered_ms bigint, cue_count bigint")
    videos = spark.createDataFrame([("v",)], "video_id string")
    return tracks.choose_track(videos, rows.join(measured, "key", "left")).collect()[0]


def test_original_language_wins(spark):
    meta = ("v", "zh-Hans", None, None, {"en": [fmt()], "zh": [fmt()]}, {"zh": [fmt()]})
    assert choose(spark, meta)["key"] == "manual:zh"


def test_original_marked_by_name(spark):
    row = choose(spark, ("v", None, None, None, {}, {"de": [fmt(name="German")], "en": [fmt(name="English (Original)")]}))
    assert (row["key"], row["rank"]) == ("automatic:en", 2)


def test_coverage_breaks_ties_and_measured_zero_beats_unmeasured(spark):
    meta = ("v", "ja", None, None, {"en": [fmt()], "fr": [fmt()]}, {})
    assert choose(spark, meta, [("manual:en", 5000, 2), ("manual:fr", 20000, 2)])["key"] == "manual:fr"
    assert choose(spark, meta, [("manual:fr", 0, 0)])["key"] == "manual:fr"


def test_no_tracks(spark):
    row = choose(spark, ("v", "en", None, None, {}, {}))
    assert row["key"] is None and row["selection_reason"] == "no downloadable caption tracks"


def test_cue_parsing_and_union(spark):
    text = "﻿1\n00:00:01,000 --> 00:00:03.000\na\n\n0:00:03.000  -->  0:00:04,500\nb\n00:00:09,000 --> 00:00:09,000\n00:05.000 --> 00:06.000\n00:00:02,000 --> 00:00:02,500"
    docs = spark.createDataFrame([("a", text), ("b", "")], "key string, text string")
    cues = tracks.parse_cues(docs, ["key"]).withColumn("tie", F.monotonically_increasing_id())
    assert cues.where("key = 'b'").count() == 0
    (row,) = tracks.interval_union(cues, ["key"], "start_ms", "end_ms", "tie").collect()
    assert (row["cue_count"], row["islands"], row["covered"]) == (3, 1, 3500)


def test_tree_digest_matches_a_plain_fold(spark):
    data = [("p", f"d/é{i}.txt", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)] + [("q", "x", "0" * 64)]
    fold = hashlib.sha256()
    for _, path, sha in sorted(data[:300], key=lambda r: r[1]):
        raw = path.encode()
        fold.update(len(raw).to_bytes(4, "big") + raw + bytes.fromhex(sha))
    got = {r["package"]: r for r in integrity.tree_digest(spark.createDataFrame(data, "package string, path string, sha256 string"), "package").collect()}
    assert got["p"]["tree_sha256"] == fold.hexdigest() and got["p"]["files"] == 300 and got["q"]["files"] == 1


def test_one_changed_file_is_one_mismatch(spark):
    declared = spark.createDataFrame([("p", str(i), str(i)) for i in range(20)], "package string, path string, sha256 string")
    actual = declared.withColumn("sha256", F.when(F.col("path") == "7", "changed").otherwise(F.col("sha256"))).where("path <> '9'")
    found = {r["path"]: r["status"] for r in integrity.manifest_diff(declared, actual, ["package", "path"], ["sha256"]).collect()}
    assert {p: s for p, s in found.items() if s != "match"} == {"7": "mismatch", "9": "missing"}


def chain(n, ledger_id="l"):
    rows, last = [], "0" * 64
    for i in range(1, n + 1):
        text = json.dumps({"iteration": i, "payload": f"p{i}", "previous_hash": last}, sort_keys=True, separators=(",", ":"))
        now = hashlib.sha256(text.encode()).hexdigest()
        rows.append((ledger_id, i, f"p{i}", last, now))
        last = now
    return rows


def chain_codes(spark, rows):
    df = spark.createDataFrame(rows, "ledger string, iteration bigint, payload string, previous_hash string, chain_hash string")
    again = sha256(canonical_json({c: F.col(c) for c in ("iteration", "payload", "previous_hash")}))
    return sorted((r["iteration"], r["code"]) for r in ledger.chain_audit(df, again).collect())


def test_chain_tampering_is_located(spark):
    rows = chain(12)
    assert chain_codes(spark, rows) == []
    changed = [(*r[:2], "other", *r[3:]) if r[1] == 5 else r for r in rows]
    assert chain_codes(spark, changed) == [(5, "chain-hash")]
    assert chain_codes(spark, [r for r in rows if r[1] != 6]) == [(7, "order")]
    assert (3, "repeated") in chain_codes(spark, rows + [rows[2]])


def test_canonical_json_of_floats_and_text(spark):
    value = {"b": 1e-06, "a": [1.5, 100000.0, "é\u0001\""], "c": {"z": None, "y": True}}
    df = spark.createDataFrame([(json.dumps(value),)], "raw string")
    want = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert df.select(canonical_json_text(F.col("raw"))).collect()[0][0] == want


def test_value_rules_tell_booleans_from_integers(spark):
    rule = contracts.ValueRule
    docs = spark.createDataFrame([('{"n": 3, "b": [0, 0, 4, 4]}',), ('{"n": true, "b": [0, 0, 4, 9]}',), ('{"n": 3.0}',), ('{"n": 3}}',)], "raw string")
    out = contracts.value_domain_audit(docs, "raw", [rule("n", "integer", minimum=1), rule("b", "box")], canvas=(4, 4)).collect()
    assert [r["breaches"] for r in out] == [[], ["n", "b"], ["n", "b"], ["n", "b"]]


def test_keyframes_precede_their_sequence(spark):
    good = [("p", 1, "canonical-approval", ["c"], 1), ("p", 2, "keyframe-set-approval", ["c", "k1", "k2"], 2), ("p", 3, "sequence-approval", ["c", "k1", "m", "k2"], 3)]
    schema = "package string, id bigint, gate string, subject_ids array<string>, declared_order bigint"

    def codes(rows):
        return sorted((r["id"], r["code"]) for r in reviews.gate_order_audit(spark.createDataFrame(rows, schema), "package").collect())

    assert codes(good) == []
    late = [good[0], (*good[1][:4], 3), (*good[2][:4], 2)]
    assert codes(late) == [(2, "rank-decreases"), (3, "keyframes-not-before-sequence")]
    many = [("big", i, "sequence-approval", ["c", "x"], i) for i in range(reviews.MAX_REVIEWS + 1)]
    # a package over the limit is a finding, and its approvals are audited all the same
    assert codes(many) == sorted([(-1, "too-many-reviews")] + [
        (i, code) for i in range(reviews.MAX_REVIEWS + 1) for code in ("before-canonical", "keyframes-not-before-sequence")])
    # a set without frames belongs to the sequence as well, so two sets match
    bare = [*good[:2], ("p", 9, "keyframe-set-approval", ["c"], 3), (*good[2][:4], 4)]
    assert codes(bare) == [(3, "keyframes-not-before-sequence")]
    # a sequence that lacks one frame of the set has none
    assert codes([*good[:2], ("p", 3, "sequence-approval", ["c", "k1", "m"], 3)]) == [(3, "keyframes-not-before-sequence")]


def test_a_review_binds_the_admission_of_its_canonicals(spark):
    schema = ("package string, id bigint, gate string, subject_ids array<string>, subject_sha256 map<string,string>, declared_order bigint, "
              "admission_sha256 map<string,string>")
    hashes = spark.createDataFrame([("p", s, f"h{s}") for s in "ck"], "package string, subject_id string, sha256 string")
    proofs = spark.createDataFrame([("p", "c", "proof")], "package string, subject_id string, sha256 string")

    def codes(admission):
        rows = spark.createDataFrame([("p", 1, "g", ["c", "k"], {"c": "hc", "k": "hk"}, 1, admission)], schema)
        return [r["code"] for r in reviews.review_scope_audit(rows, rows.select("package", "gate", "subject_ids"), hashes, "package", proofs).collect()]

    assert codes({"c": "proof"}) == []
    for wrong in ({"c": "other"}, {}, None, {"c": "proof", "k": "hk"}, {"c": "proof", "x": "y"}):
        assert codes(wrong) == ["admission"]


def test_every_subject_needs_one_acceptable_observation(spark):
    schema = ("subjects array<string>, evidence array<string>, status string, subject_sha256 string, "
              "reviews array<struct<evidence_ids:array<string>,observations:array<struct<classification:string,disposition:string,subject_id:string>>>>")

    def problems(*subjects):
        seen = [("reviewed", "acceptable", s) for s in subjects]
        row = (["s1", "s2"], ["e1"], "approved", hashlib.sha256(b"x").hexdigest(), [(["e1"], seen)])
        return reviews.review_decision(spark.createDataFrame([row], schema), F.lit("x")).first()["problems"]

    assert problems("s1", "s2") == [] and problems("s2", "s1") == []
    assert problems("s1") == ["subject coverage"] and problems("s1", "s1") == ["subject coverage"] and problems("s1", "s2", "s2") == ["subject coverage"]


def test_touching_rectangles_do_not_meet(spark):
    cands = spark.createDataFrame([("c", 1, 0, 0, 10, 10), ("c", 2, 10, 0, 5, 5), ("c", 3, 9, 9, 500, 500), ("d", 4, 0, 0, 10, 10)], "clip string, id int, left int, top int, width int, height int")
    regions = spark.createDataFrame([("c", 0, 0, 10, 10)], "clip string, left int, top int, width int, height int")
    out = {r["id"]: r["in_scope"] for r in geometry.region_overlap(cands, regions, "clip", ["id"], cell=8).collect()}
    assert out == {1: True, 2: False, 3: True, 4: False}


def test_brackets_wrap_only_in_loops(spark):
    rows = [(c, i, f"{c}{i}", r, c == "l") for c in "lo" for i, r in enumerate(["m", "k", "m", "k", "m"])]
    df = spark.createDataFrame(rows, "clip string, i int, id string, role string, loop boolean")
    out = {r["id"]: (r["previous_keyframe"], r["next_keyframe"]) for r in positions.bracket_lookup(df, "clip", ["i"], "id", F.col("role") == "k", "loop").collect()}
    assert out["l0"] == ("l3", "l1") and out["l4"] == ("l3", "l1") and out["l2"] == ("l1", "l3")
    assert out["o0"] == (None, "o1") and out["o4"] == ("o3", None)


def test_nearest_prefers_the_earlier_frame(spark):
    frames = spark.createDataFrame([("c", 0, 0), ("c", 1, 10), ("c", 2, 10), ("c", 3, 20)], "clip string, i int, t int")
    asks = spark.createDataFrame([("c", 5), ("c", 15), ("c", 16), ("c", 99), ("c", -3)], "clip string, ask int")
    out = {r["ask"]: r["i"] for r in positions.nearest_timestamp(frames, asks, ["clip"], "i", "t", "ask").collect()}
    assert out == {5: 0, 15: 1, 16: 3, 99: 3, -3: 0}


def test_nearest_center_over_several_blocks(spark):
    centers = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "center_id int, center array<double>")
    points = spark.createDataFrame([(i, [i / 4, 0.0]) for i in range(40)], "p int, f array<double>")
    out = {r["p"]: r["center_id"] for r in geometry.nearest_center(points, centers, "p", "f", block=3).collect()}
    assert out == {p: min(range(10), key=lambda c: (abs(c - p / 4), c)) for p in range(40)}


def test_empty_denominators(spark):
    df = spark.createDataFrame([("none", False, False), ("miss", False, True), ("extra", True, False)], "s string, p boolean, t boolean")
    out = {r["s"]: r for r in scoring.binary_scores(df, ["s"], F.col("p"), F.col("t")).collect()}
    assert (out["none"]["precision"], out["none"]["recall"], out["none"]["iou"], out["none"]["f1"]) == (1, 1, 1, 1)
    assert (out["miss"]["precision"], out["miss"]["recall"], out["miss"]["f1"]) == (1, 0, 0)
    assert (out["extra"]["precision"], out["extra"]["recall"], out["extra"]["f1"]) == (0, 1, 0)


def test_headings_follow_every_line_break(spark):
    text = "﻿# a\r\n##\tb\x0b### c #d\n####### e\n  ###### f\n#"
    out = textaudit.heading_levels(spark.createDataFrame([(text,)], "t string"), "t").collect()[0]["levels"]
    assert out == [1, 2, 3, 6]


def test_redaction_never_echoes(spark):
    text = "Authorization: Bearer abcdefghijklmnop cookie: sid=xyz a.b@c.example.org token = \"04db\" https://h/x?sig=zz"
    row = textaudit.redact(spark.createDataFrame([(text,)], "t string"), "t").collect()[0]["redacted"]
    for secret in ("Bearer", "xyz", "a.b@c", "04db", "zz"):
        assert secret not in row


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "t" / "__pycache__").mkdir(parents=True)
    (tmp_path / "t" / "a b+c.txt").write_bytes(b"one")
    (tmp_path / "t" / "n").mkdir()
    (tmp_path / "t" / "n" / "é.bin").write_bytes(b"\x00two")
    (tmp_path / "t" / "__pycache__" / "x.pyc").write_bytes(b"no")
    (tmp_path / "t" / "SHA256SUMS").write_text("no")
    files = io.scan_files(spark, f"file:{tmp_path}/t")
    assert {(r["path"], r["bytes"], r["sha256"]) for r in files.collect()} == {
        ("a b+c.txt", 3, hashlib.sha256(b"one").hexdigest()), ("n/é.bin", 4, hashlib.sha256(b"\x00two").hexdigest())}
    for limit in (3, 0):  # in blocks
        assert sorted(io.scan_files(spark, f"file:{tmp_path}/t", largest_row=limit).collect()) == sorted(files.collect())
    io.write_manifest(files, f"{tmp_path}/sums", single_file=True)
    lines = io.read_checksum_lines(spark, f"{tmp_path}/sums")
    assert [r["path"] for r in lines.collect()] == ["a b+c.txt", "n/é.bin"] and lines.where("error is not null").count() == 0
    (tmp_path / "sums2").write_text("abc one-space\n\n" + "0" * 64 + "  two  spaces\n")
    assert [(r["path"], r["error"] is None) for r in io.read_checksum_lines(spark, f"{tmp_path}/sums2").collect()] == [(None, False), ("two  spaces", True)]


def test_csv_and_json_cases(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,should_trigger,prompt,reason\nA,true,"say ""hi"", now",r\nB,false,"two\nlines",s\n')
    rows = io.read_triggers_csv(spark, f"{tmp_path}/t.csv").collect()
    assert [(r["should_trigger"], r["prompt"]) for r in rows] == [(True, 'say "hi", now'), (False, "two\nlines")]
    (tmp_path / "c.json").write_text('{"positive": [{"id": "A", "prompt": "p"}],\n "negative": [{"id": "B"}, {"id": "C"}]}')
    assert sorted((r["id"], r["should_trigger"]) for r in io.read_cases_json(spark, f"{tmp_path}/c.json").collect()) == [("A", True), ("B", False), ("C", False)]
