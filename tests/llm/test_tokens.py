"""Encoder, shards, packing and cached counts against the tokenizers library and plain Python."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofline.llm.counts import count_tokens, read_cache
import corpus_pipeline
from proofline.llm.packing import best_fit_decreasing, cut_pieces, pack, pack_documents, read_sequences, sequences
from proofline.llm.shards import build_mphf, key_hashes, keys_of, locate, read_payloads, slots_of, write_shards
from proofline.llm.tokens import encoder
from proofline.session import scratch_path

NAME = "byte_bpe_50k.json"
#: Null, empty, white space of many kinds, added tokens, repeats, and a very long text.
TEXTS = [
    None, "", " ", "  a  b ", "a\tb\n c\r\n\n d", "end<|endoftext|> x", "it's 's 12 34é ñ", "\u00a0x\u2003y z", "same text", "same text",
    "word " * 40_000, "\u0000 a", "0" * 5000, "日本語 テキスト 🙂 a",
]


def ids(text):
    return encoder(NAME).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "key", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "key", 1), (3, "again", "key", 1), (3, "again", "key", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, `key` string, `offset` int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@given(st.text(alphabet=st.sampled_from(" \n\t\u00a0\u2028ab.,'1é<|>"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    made = encoder(NAME)
    assert made.words(made.encode([text])[0]).tolist() == ids(text)


def test_other_tokenizers_are_encoded_whole():
    made = encoder("word_bpe_49k.json")
    texts = ["Some Text, here", "", "ÄÖ <|endoftext|> b"]
    assert [made.words(x).tolist() for x in made.encode(texts)] == [made.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        sizes, bits = build_mphf(a, b)
        assert sorted(slots_of(a, b, sizes, bits).tolist()) == list(range(n))


def test_shards_round_trip(spark, docs):
    path = scratch_path(spark, "test")
    write_shards(docs, path, NAME, end_id=0)
    got = read_payloads(locate(keys_of(docs), path), path, NAME).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, expected = 0, []
    for key, text in rows:
        own = [*ids(text), 0]
        expected.append((key, start, len(own), zlib.crc32(np.asarray(own, dtype="<u4").tobytes()), own))
        start += len(own)
    found = [(r.key, r.start, r.n_tokens, r.ids_crc32, encoder(NAME).words(bytes(r.ids)).tolist()) for r in got]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_key_hashes_are_independent(spark):
    a, b = key_hashes(F.lit("k"), F.col("id"))
    chained = F.xxhash64(F.lit("k"), F.col("id"), F.lit("mark"))
    rows = spark.range(2000).select(a.alias("a"), b.alias("b"), chained.alias("c")).collect()
    import xxhash

    of_first = lambda r: xxhash.xxh64_intdigest(b"mark", r.a % 2**64)
    assert all(of_first(r) == r.c % 2**64 for r in rows)  # a hash chained behind the first is a function of it
    assert not any(of_first(r) == r.b % 2**64 for r in rows)


def test_unknown_keys_are_not_found(spark, docs, empty):
    path = scratch_path(spark, "test")
    write_shards(docs, path, NAME)
    asked = spark.range(1000, 3000).selectExpr("id as key", "0L as copy")
    assert locate(asked, path).count() == 0
    path = scratch_path(spark, "test")
    write_shards(empty, path, NAME)
    assert read_payloads(locate(asked, path), path, NAME).count() == 0


def plain_best_fit(lengths, window):
    """Fill of each sequence by best-fit decreasing, piece by piece."""
    free, kept = [], []
    for length in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= length]
        if fits:
            at = min(fits)[1]
        else:
            at = len(free)
            free.append(window)
            kept.append([])
        free[at] -= length
        kept[at].append(length)
    return sorted(tuple(sorted(x)) for x in kept)


@given(st.lists(st.integers(1, 32), max_size=80))
@example([1, 2, 4, 27, 29])  # two sequences with equal room
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    plan, filled, taken = best_fit_decreasing(counts, 32), defaultdict(list), defaultdict(set)
    rows = sorted(plan.rows)
    for length, n in counts.items():
        own = [r for r in rows if r[0] == length]
        for rank in range(n):
            _, first, sequence, per, offset = [r for r in own if r[1] <= rank][-1]
            at, begin = sequence + (rank - first) // per, offset + (rank - first) % per * length
            filled[at].append(length)
            spots = set(range(begin, begin + length))
            assert not spots & taken[at] and max(spots) < 32
            taken[at] |= spots
    assert sorted(tuple(sorted(x)) for x in filled.values()) == plain_best_fit(lengths, 32)


def test_packing_holds_every_id_once(spark, docs, empty):
    placed = pack(cut_pieces(docs, NAME, end_id=0)).cache()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in placed.collect():
        words = encoder(NAME).words(bytes(r.ids))
        assert len(words) == r.length and r.ids_crc32 == zlib.crc32(words.astype("<u4").tobytes())
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.key].append((r.start, words.tolist()))
    for pieces in by_sequence.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 1024
    for i, text in enumerate(TEXTS):
        if i != 3:  # three rows share this id
            assert [x for _, words in sorted(by_doc[i]) for x in words] == [*ids(text), 0]
    assert sorted(len(w) for _, w in by_doc[3]) == sorted([len(ids(TEXTS[3])) + 1] + [len(ids("again")) + 1] * 2)
    for r in sequences(placed, NAME).collect():
        n = len(r.ids) // 2
        assert n == 1024 or n == r.n_tokens and n & (n - 1) == 0
    assert pack(cut_pieces(empty, NAME, end_id=0)).count() == 0


def test_sequences_hold_the_pieces(spark, docs, empty):
    placed = pack(cut_pieces(docs, NAME, end_id=0)).cache()
    packed = sequences(placed, NAME, pad_id=7).cache()
    columns = ["key", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    expected = sorted(map(str, placed.select(*columns).collect()))
    for found in (read_sequences(packed, NAME), pack_documents(docs, NAME, end_id=0)):
        assert found.columns == columns and sorted(map(str, found.collect())) == expected
    for r in packed.collect():
        words = encoder(NAME).words(bytes(r.ids)).tolist()
        assert len(words) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 1024) and set(words[r.n_tokens :]) <= {7}
    # what is read back is what the rows hold, not what was known before packing
    spoilt = packed.withColumn("ids", F.expr("cast(repeat('A', length(ids)) as binary)"))
    for r in read_sequences(spoilt, NAME).collect():
        assert bytes(r.ids) == b"A" * 2 * r.length and r.ids_crc32 == zlib.crc32(b"AA\0\0" * r.length)
    assert pack_documents(empty, NAME, end_id=0).count() == 0


def test_pipeline_returns_ids(spark, docs):
    found = defaultdict(list)
    for r in corpus_pipeline.packing(spark, docs, "").collect():
        found[r.doc_id].append((r.start, encoder(NAME).words(bytes(r.ids)).tolist()))
    for i in set(range(len(TEXTS))) - {3}:  # three rows share this id
        assert [x for _, words in sorted(found[i]) for x in words] == [*ids(TEXTS[i]), 0]


def test_counts_and_their_cache(spark, docs, empty):
    path = scratch_path(spark, "cache")
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 512) for r in docs.collect()), key=str)
    plain = lambda found, hits: sorted((tuple(r)[:4] for r in found.collect()), key=str) if {r.hit for r in found.collect()} == hits else None
    first = read_cache(spark, path).count()
    assert plain(count_tokens(docs, path, NAME), {False}) == expected
    stored = read_cache(spark, path).count()
    assert first == 0 and stored == len({r.text or "" for r in docs.collect()})
    assert plain(count_tokens(docs, path, NAME), {True}) == expected
    assert read_cache(spark, path).count() == stored  # nothing was encoded again
    twice = scratch_path(spark, "cache")  # as two writers at once leave it
    for _ in range(2):
        read_cache(spark, path).write.mode("append").parquet(twice)
    assert plain(count_tokens(docs, twice, NAME), {True}) == expected
    more = spark.createDataFrame([(1, "new"), (2, "same text")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(more, path, NAME).collect()) == sorted(len(ids(x)) for x in ("new", "same text"))
    assert read_cache(spark, path).count() == stored + 1
    count_tokens(more, path, "word_bpe_49k.json").collect()
    assert read_cache(spark, path).count() == stored + 3  # another tokenizer has its own counts
    assert count_tokens(more, path, "piece_bpe_32k.model").count() == 2
    assert count_tokens(empty, scratch_path(spark, "cache"), NAME).count() == 0
