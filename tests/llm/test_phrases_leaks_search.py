"""Phrases, benchmark leaks and lexical search against plain Python on hand-made and random tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import leaks, lexical, phrases


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def normal_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


# ---- leaks

def plain_leaks(text, items, least):
    words, hit, found = normal_words(text), set(), set()
    for name, item in items:
        own = normal_words(item)
        size = min(least, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add("" if name is None else str(name))
    return len(words), hit, sorted(found)


@given(st.lists(st.text("ab ", max_size=24), max_size=5), st.text("ab ", max_size=60), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_every_window(items, text, least):
    named = [(str(i), x) for i, x in enumerate(items)]
    automaton = leaks.build_automaton([(n, leaks.words_of(x.encode())) for n, x in named], least)
    runs, found = leaks.leaked_runs(automaton, leaks.words_of(text.encode()))
    _, hit, expected = plain_leaks(text, named, least)
    assert {i for a, b in runs for i in range(a, b)} == hit and sorted(automaton.names[x] for x in found) == expected
    assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


ITEM = "One two three four, five SIX seven eight nine ten eleven; twelve!"
ITEMS = [(1, ITEM), (2, "é ü Ä"), (2, "seven eight nine ten eleven twelve a b c d e"), (10, None), (11, " .,;"), (None, "no id here"), (3, "two"), (4, ITEM)]
TEXTS = [
    None, "", "...", ITEM, "x " + ITEM.lower() + " y", "a one two three four five six seven eight nine ten", "É ü ä é ü Ä", "no id", "no id here two",
    "word " * 30_000 + ITEM, "one two three four five six seven eight nine one two three four five six seven eight nine ten eleven", "日本 " * 12,
]


@pytest.mark.parametrize("shard_words", [200_000, 14])
def test_leaks(spark, monkeypatch, shard_words):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 3 if shard_words == 14 else 4_096)
    rows = [(i, t, "n", "i") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "n", "i"), (None, TEXTS[4], "n", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, item_id string").repartition(3)
    items = spark.createDataFrame([(*x, "k") for x in ITEMS], "item_id long, text string, key string")
    found = leaks.find_leaks(docs, items).collect()
    assert len(found) == len(rows) and sum(r.doc_id == 4 for r in found) == 2
    for r in found:
        text = TEXTS[4 if r.doc_id is None else r.doc_id] or ""
        n, hit, names = plain_leaks(text, ITEMS, 10)
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), names), text[:50]
        assert {i for s in r.spans for i in range(s.first, s.beyond)} == hit
        for s in r.spans:
            assert normal_words(text[s.start : s.end]) == normal_words(text)[s.first : s.beyond]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in leaks.find_leaks(docs, items.limit(0)).collect()} == {0}


def test_removal(spark):
    docs = spark.createDataFrame(
        [(1, "keep this " * 10 + ITEM + " tail", 5), (2, ITEM, 5), (3, None, 5), (4, "clean", 5), (4, "clean", 5), (5, "two " + "w " * 20, 5)], "doc_id long, text string, _gone int",
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = sorted(map(tuple, leaks.remove_leaks(docs, items).collect()))
    assert leaks.remove_leaks(docs, items).columns == docs.columns
    assert kept == sorted([(1, "keep this " * 10 + "! tail", 5), (3, None, 5), (4, "clean", 5), (4, "clean", 5), (5, "two " + "w " * 20, 5)])
    assert sorted(r.doc_id for r in leaks.remove_leaks(docs, items, coverage=1.0).collect()) == [1, 2, 3, 4, 4, 5]
    assert leaks.remove_leaks(docs.limit(0), items).count() == 0


# ---- search

def plain_search(docs, items, k):
    terms = [(key, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)))) for key, t in docs]
    terms = [(key, c) for key, c in terms if c]
    n, length = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for name, item in items:
        scored = []
        for key, c in terms:
            m = 10 + (90 * c.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(normal_words(item)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(name, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("sizes", [(500_000, 256, 1024, 1 << 53), (9, 2, 7, 40_000_000_000)])
def test_search(spark, monkeypatch, sizes):
    for name, value in zip(("GROUP_TERMS", "TILE_ITEMS", "TILE_DOCS", "EXACT"), sizes):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical.runs_below, "__defaults__", (sizes[3],))
    rng = np.random.default_rng(3)
    words = ["the", "of", "Alpha", "beta", "γάμμα", "x1", "rare", "q"]
    rows = [(i, " ".join(rng.choice(words[:6], rng.integers(0, 40)))) for i in range(120)]
    rows += [(i, "alpha beta, rare") for i in range(200, 215)] + [(3, "alpha beta, rare"), (None, "alpha beta, rare"), (300, None), (301, ""), (302, "beta " * 30_000)]
    items = [(1, "Alpha RARE"), (2, "the of the"), (3, None), (4, "unknown words"), (None, "beta q"), (1, "Alpha RARE"), (5, "γάμμα x1 beta the of")]
    docs = spark.createDataFrame([(*r, "s", "i") for r in rows], "doc_id long, text string, score string, item_id string").repartition(5)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    found = sorted((tuple(r) for r in lexical.search(docs, asked, 10).collect()), key=str)
    assert found == sorted(plain_search(rows, items, 10), key=str)
    assert lexical.search(docs.limit(0), asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0


def test_products_stay_exact():
    weights, impacts = np.full((1, 40), 30_000.0), np.full((40, 1), 1e6)
    runs = lexical.runs_below(weights.astype(np.int64) * 10**6, 100_000_000_000)
    assert [r.stop - r.start for r in runs] == [3] * 13 + [1] and lexical.tile_scores(weights, impacts, runs)[0, 0] == 40 * 30_000 * 10**6


# ---- phrases

def plain_pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain_collocations(rows, least, covered, k):
    f, out = defaultdict(Counter), []
    for lang, text in rows:
        for words in plain_pieces(text):
            for m in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, found in f.items():
        n, best = sum(c for p, c in found.items() if len(p) == 1), {}
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, _, l, r = min((2_000_000 * a // (found[p[:i]] + found[p[i:]]), i, found[p[:i]], found[p[i:]]) for i in range(1, len(p)))
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= covered * a for b in longer):
                best[p] = (-score, -a, " ".join(p).encode(), l, r)
        for rank, (s, a, phrase, l, r) in enumerate(sorted(best.values())[:k], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -s))
    return out


@given(st.lists(st.sampled_from([b"a", b"b", b"cc", b"d"]), min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_chunks_hold_every_phrase_once(words):
    found = Counter()
    for chunk in phrases.chunks_of(words, phrases.Hashes()) if len(words) > phrases.OVERLAP + 1 else [b" ".join(words)]:
        own, last = chunk.split(), not chunk.endswith(b" ")
        for m in range(1, 5):
            found.update(tuple(own[i : i + m]) for i in range(min(len(own) - m + 1, len(own) if last else len(own) - phrases.OVERLAP)))
    assert found == Counter(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))


@pytest.mark.parametrize("bits, held", [(1 << 26, 400_000), (64, 5)])
def test_collocations(spark, monkeypatch, bits, held):
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "HELD_ROWS", held)
    monkeypatch.setattr(phrases, "HELD_WORDS", held)
    rng = np.random.default_rng(8)
    rows = [(None, None), ("en", ""), ("", " .;"), ("en", "New York city, New York. new york CITY\tof\x0bnew york"), ("und", "a b " * 5_000), (None, "a b a b")]
    for lang in ("en", "de", None):
        rows += [(lang, " ".join(rng.choice(["The", "of", "ab", "c.", "é", "zz"], 30, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]))) for _ in range(40)]
    rows += [("en", "united states of america")] * 9
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, phrase string").repartition(4)
    found = [tuple(r) for r in phrases.collocations(docs, least=6, k=40).collect()]
    assert sorted(found) == sorted(plain_collocations(rows, 6, 80, 40)) and len(found) > 60
    assert phrases.collocations(docs.limit(0)).count() == 0
