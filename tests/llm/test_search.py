"""URL verdicts and exact search against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import vectors
from proofline.llm.urls import RULES, judge_urls, page_links, resolve, url_node
from proofline.llm.vectors import top_k


def plain_split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:n], rest[n:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]


def plain_rule(url):
    host, path = plain_split(url)
    fits = [(len(r), r, v) for v, r in RULES for own, _, rest in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/19", "https://example.org", "ftp://xorg/", "http://a.com/de/", "http://com/fr/x://y",
    "http://b.net/p#f", "http://b.net/q", "http://b.net/r", "http://c.net/1", "http://c.net/2", "http://c.net/3", "http://d.net/" + "x" * 50_000, "http://org./", "http://a.b.c.example.org/es/",
]
HTML = {
    10: '<LINK href="/q" rel=canonical>', 11: '<meta http-equiv="refresh" content="0; url=http://a.com/de/9">', 12: '<link rel="stylesheet" href="http://a.com/de/1">',
    13: '<link rel="canonical" href="//c.net/2">', 14: '<meta http-equiv=\'refresh\' content="5;URL=http://a.com/fr/1">', 15: '<link rel=canonical href="http://a.com/de/1"><link rel=canonical href="http://c.net/2">',
}


def test_verdicts(spark):
    rows = [(i, u, HTML.get(i), "h", "v") for i, u in enumerate(URLS)] + [(5, URLS[5], None, "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    redirects = spark.createDataFrame([("http://d.net/start", "http://example.org/es/x"), ("http://b.net/r", "http://d.net/start"), (None, "http://b.net/")], "source string, target string")
    found = judge_urls(pages, redirects=redirects).collect()
    assert len(found) == len(rows)
    spread = {10: "block", 11: "block", 12: "block", 13: "allow", 14: "allow", 15: "allow"}
    for r in found:
        rule, verdict = plain_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (*plain_split(URLS[r.page_id]), rule)
        assert r.verdict == (verdict or spread.get(r.page_id, "allow")), URLS[r.page_id]
    assert {r.page_id: r.verdict for r in judge_urls(pages, rules=()).collect()} == dict.fromkeys(range(len(URLS)), "allow")
    assert judge_urls(pages.limit(0)).count() == 0


def test_empty_paths_are_judged_as_written(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://y.org", link.format("http://example.org/es/1")), (2, "http://example.org/es/1", None), (3, "http://w.org", link.format("http://w.org/a")), (4, "http://v.org/", None),
            (5, "http://u.net", link.format("http://v.org"))]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.path, r.rule, r.verdict) for r in found} == {
        1: ("", None, "block"), 2: ("/es/1", "example.org/es/", "block"), 3: ("", None, "allow"), 4: ("/", "org/", "allow"), 5: ("", None, "allow"),
    }


def test_links(spark):
    pages = spark.createDataFrame([("http://h.net/a/b?c", HTML[10]), ("nothing", HTML[13]), ("http://h.net/a/b", '<link rel="canonical" href="c&amp;d">')], "url string, html string")
    assert {tuple(r) for r in page_links(pages).where("v is not null and u is not null").collect()} == {("http://h.net/a/b?c", "http://h.net/q"), ("http://h.net/a/b", "http://h.net/a/c&d")}
    one = spark.range(1).select(url_node(F.lit("HTTP://H.net?Q#f")), resolve(F.lit("x"), F.lit("http://h.net")), resolve(F.lit("x"), F.lit(None).cast("string"))).collect()[0]
    assert tuple(one) == ("http://h.net/?Q", "http://h.net/x", None)


def plain_top(rows, k):
    clean = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean.setdefault(key, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q, vs in clean.items():
        for v in vs if q % 50 == 0 else []:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, ws in clean.items() for w in ws if c != q and len(w) == len(v))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(16_384, 2_048, 32), (60, 3, 2)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", sizes[0])
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", sizes[1])
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)]  # many copies: ties to smaller ids
    rows += [(550, None), (551, [1.0, None]), (552, [float("nan")] * 8), (553, [float("inf")] * 8), (554, []), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [3.0, -1.0]), (650, [1.0] * 3)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(5)
    found = sorted(tuple(r) for r in top_k(frame, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect())
    assert found == plain_top(rows, 5)
    assert top_k(frame.limit(0), F.lit(True)).count() == 0


def test_large_components_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * 10.0 ** (i % 7)).astype(np.float32).tolist()) for i in range(120)] + [(150, [3e5] * 8), (151, [-3e5] * 8), (152, [2e7] * 7 + [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 50 == 0
    assert sorted(tuple(r) for r in top_k(frame, asks).collect()) == plain_top(rows, 5)
    beyond = frame.unionByName(spark.createDataFrame([(200, [1e12] * 8), (201, [1e12] * 8)], frame.schema))
    with pytest.raises(ValueError, match="range of long"):
        top_k(beyond, asks)


def test_cells_bound_their_values():
    x = np.random.default_rng(1).integers(-50, 50, (300, 3))
    cells, low, high = vectors.approximate(x)
    columns = np.arange(3)
    assert (low[columns, cells] <= x).all() and (x <= high[columns, cells]).all()
