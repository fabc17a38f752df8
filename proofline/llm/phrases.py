"""Collocations from a prefix-free parsing of all texts.

Every piece of text is cut into chunks wherever a window of ``OVERLAP`` words has a hash that is a multiple of ``TRIGGER``; the window
ends one chunk and begins the next.  Where to cut thus depends on the words alone, so equal passages give equal chunks wherever they
stand.  Distinct chunks and how often each was parsed form a dictionary table; phrases are counted inside distinct chunks,
weighted by these frequencies.  A phrase of up to ``OVERLAP`` + 1 words lies whole in the chunk in which it begins, and a chunk
owns the phrases that begin before its last window, so each occurrence is counted once.

Phrases are counted by length.  One of n words is only counted where its first and last n - 1 words may be frequent, as told by a Bloom
filter of fixed size over the frequent shorter ones: a false hit costs a row and changes nothing, as rare phrases go after counting.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut

#: Words of a triggering window, one less than those of the longest phrase.
OVERLAP = 3
#: One window in so many ends a chunk.
TRIGGER = 16
#: Bits of the filter (8 MB): the bound of what is broadcast, whatever the corpus holds.
FILTER_BITS = 1 << 26
#: Distinct chunks, or occurrences of phrases, that a Python task adds up before it passes them on; words that it remembers.
HELD_ROWS, HELD_WORDS, KEPT_WORDS = 800_000, 4_000_000, 1_000_000
#: Scale of a score.
SCALE = 2_000_000
NO_LANGUAGE = "und"
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in _ENDS else c for c in range(256))


def pieces_of(text: bytes | None) -> list[list[bytes]]:
    """Words ``[^\\x20\\x09]+`` of each piece of a text in UTF-8, A-Z lower-cased; pieces without words left out."""
    return [words for piece in text.translate(_FOLD).split(b"\n") if (words := piece.split())] if text else []


class Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = zlib.crc32(word)
        return code


def chunks_of(words: list[bytes], hashes: Hashes) -> list[bytes]:
    """Chunks of a piece as space-joined words; one that its piece goes on after ends in a space.  Neighbours share the triggering window."""
    codes, out, first = list(map(hashes.__getitem__, words)), [], 0
    for i, (a, b, c) in enumerate(zip(codes[1:-OVERLAP], codes[2:], codes[3:]), 1):
        if (a + 3 * b + 7 * c) % TRIGGER == 0:
            out.append(b" ".join(words[first : i + OVERLAP]) + b" ")
            first = i
    out.append(b" ".join(words[first:]))
    return out


def parse(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The dictionary: lang, the words of a distinct chunk, and its frequency n."""
    kind = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("n", pa.int64())])

    def told(found: dict[str, dict[bytes, int]]):
        for own, counts in found.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(own, pa.string()), len(counts)), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=kind)

    def cut_up(batches):
        hashes, found = Hashes(), {}
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts = found.setdefault(own, {})
                for words in pieces_of(text):
                    if len(words) <= OVERLAP + 1:  # too short for a window behind its first word
                        chunk = b" ".join(words)
                        counts[chunk] = counts.get(chunk, 0) + 1
                        continue
                    for chunk in chunks_of(words, hashes):
                        counts[chunk] = counts.get(chunk, 0) + 1
            if len(hashes) > KEPT_WORDS:
                hashes.clear()
            if sum(map(len, found.values())) > HELD_ROWS:
                yield from told(found)
                found = {}
        yield from told(found)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text"))
    chunks = rows.mapInArrow(cut_up, "lang string, words binary, n long")
    return cut(chunks.groupBy("lang", "words").agg(F.sum("n").alias("n")))


def bits_of(lang: str, codes: list[np.ndarray], bits: int) -> np.ndarray:
    """Where a filter of so many bits keeps phrases of a language, from the hashes of their first words, second words, ..."""
    with np.errstate(over="ignore"):
        at = np.uint64(zlib.crc32(lang.encode()) + 1)
        for code in codes:
            at = (at ^ code.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            at = at ^ (at >> np.uint64(29))
    return (at % np.uint64(bits)).astype(np.int64)


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """The bits of (lang, phrase) rows, gathered as bitmaps of 32,768 bits."""
    size = FILTER_BITS

    def spots(batches):
        for batch in batches:
            for own in batch.column(0).unique().to_pylist():
                phrases = batch.filter(pc.equal(batch.column(0), own)).column(1).to_pylist()
                codes = [np.fromiter(map(zlib.crc32, column), np.int64, len(phrases)) for column in zip(*(p.split(b" ") for p in phrases))]
                yield pa.RecordBatch.from_pydict({"bit": pa.array(bits_of(own, codes, size), pa.int64())})

    bits = frequent.select("lang", "phrase").mapInArrow(spots, "bit long")
    # bitmap_bucket_number counts from 1 for positions 0..32767 counted from 1
    maps = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("map"))
    out = np.zeros(FILTER_BITS, dtype=bool)
    for r in maps.collect():
        first = (r["bucket"] - 1) * 32_768
        own = np.unpackbits(np.frombuffer(bytes(r["map"]), np.uint8), bitorder="little").astype(bool)
        out[first : first + 32_768] |= own[: FILTER_BITS - first]
    return np.packbits(out)


class Words(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Counter:
    """Weighted phrases of one language in one task: words have numbers, so that phrases are counted as numbers."""

    def __init__(self, lang: str, sizes: tuple[int, ...], bits: np.ndarray | None):
        self.lang, self.sizes, self.bits = lang, sizes, bits
        self.words, self.codes = Words(), np.zeros(0, dtype=np.int64)
        self.rows: list[tuple[int, np.ndarray, np.ndarray]] = []  # size, numbers of the words, weights
        self.held, self.singles = 0, np.zeros(0, dtype=np.int64)

    def add(self, chunks: list[bytes], weights: np.ndarray) -> None:
        whole = b"\n".join(chunks) + b"\n"
        letters = np.frombuffer(whole, np.uint8)
        stops = np.flatnonzero(letters == 10)
        going = letters[stops - 1] == 32
        spaces = np.searchsorted(np.flatnonzero(letters == 32), stops)
        lengths = np.diff(spaces, prepend=0) + 1 - going
        words = whole.split()
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(ids))  # words from here to the end of the chunk
        owned = left > np.repeat(np.where(going, OVERLAP, 0), lengths)
        weight = np.repeat(weights, lengths)
        if self.bits is None:
            more = np.bincount(ids[owned], weights=weight[owned], minlength=len(self.words)).astype(np.int64)  # exact below 2^53
            more[: len(self.singles)] += self.singles
            self.singles = more
            return
        if len(self.words) > len(self.codes):
            new = list(self.words)[len(self.codes) :]
            self.codes = np.concatenate([self.codes, np.fromiter(map(zlib.crc32, new), np.int64, len(new))])
        parts = min(self.sizes) - 1  # words of the phrases in the filter
        n = len(ids) - parts + 1
        if n <= 0:
            return
        at = bits_of(self.lang, [self.codes[ids[i : i + n]] for i in range(parts)], 8 * len(self.bits))
        fits = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & (left[:n] >= parts)
        for size in self.sizes:
            m = len(ids) - size + 1
            if m <= 0:
                continue
            good = owned[:m] & (left[:m] >= size)
            for i in range(size - parts + 1):  # all parts in a row that a phrase of this size holds
                good &= fits[i : i + m]
            spots = np.flatnonzero(good)
            self.rows.append((size, np.stack([ids[spots + i] for i in range(size)], axis=1).astype(np.int32), weight[spots]))
            self.held += len(spots)

    def _batch(self, phrases: list[bytes], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(self.lang, pa.string()), len(phrases)), pa.array(phrases, pa.binary()), pa.array(total)], names=["lang", "phrase", "f"],
        )

    def told(self):
        """Batches of (lang, phrase, f) of distinct phrases; what was held is gone after that."""
        names = list(self.words)
        if len(self.singles):
            owned = np.flatnonzero(self.singles)
            yield self._batch([names[x] for x in owned.tolist()], self.singles[owned])
        for size in self.sizes:
            own = [(n, w) for s, n, w in self.rows if s == size and len(n)]
            if not own:
                continue
            numbers, weight = np.concatenate([n for n, _ in own]), np.concatenate([w for _, w in own])
            key = numbers[:, 0].astype(np.int64)
            for i in range(1, size):  # numbers of prefixes, so that the next word always fits into 64 bits
                key = np.unique(key << 32 | numbers[:, i], return_inverse=True)[1] if i < size - 1 else key << 32 | numbers[:, i]
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(group, weights=weight).astype(np.int64)
            columns = [[names[x] for x in numbers[first, i].tolist()] for i in range(size)]
            yield self._batch(list(map(b" ".join, zip(*columns))), total)
        self.__init__(self.lang, self.sizes, self.bits)


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _count(dictionary: DataFrame, sizes: tuple[int, ...], known: np.ndarray | None) -> DataFrame:
    """Phrases of some sizes inside distinct chunks, weighted; ``known`` is the filter of frequent phrases of the size before."""
    shared = dictionary.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        counters: dict[str, Counter] = {}
        for batch in batches:
            for own in batch.column(0).unique().to_pylist():
                rows = batch.filter(pc.equal(batch.column(0), own))
                counter = counters.setdefault(own, Counter(own, sizes, shared.value))
                counter.add(rows.column(1).to_pylist(), rows.column(2).to_numpy())
                if counter.held > HELD_WORDS or len(counter.words) > KEPT_WORDS:
                    yield from counter.told()
        for counter in counters.values():
            yield from counter.told()

    return dictionary.select("lang", "words", "n").mapInArrow(count, "lang string, phrase binary, f long")


def count_phrases(dictionary: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases with f of at least ``least``, and (lang, n) with the words of each language."""
    words = cut(_count(dictionary, (1,), None).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = words.where(F.col("f") >= least)
    pairs = cut(_frequent(_count(dictionary, (2,), _filter_of(single)), least))
    longer = cut(_frequent(_count(dictionary, (3, 4), _filter_of(pairs)), least))
    return single.unionByName(pairs).unionByName(longer), totals


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, covered: int = 80, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the k best phrases of 2 to 4 words of each language.

    a, l and r are occurrences of the phrase, of its first part and of its rest, at the cut of lowest score floor(2000000 * a / (l + r)),
    the first such; n counts the language's words.  A phrase that occurs fewer than ``least`` times is none, and one inside a longer
    phrase that has at least ``covered`` hundredths of its occurrences is dropped.  Ranks go by score and a, both descending, and the
    phrase's bytes.

    Null and empty texts have no words, a null language is ``und``, repeated rows count as often as they stand, empty tables give no
    rows, and other columns, whatever their names, stay out.
    """
    phrases, totals = count_phrases(parse(docs, lang, text), least)
    phrases = phrases.withColumn("phrase", F.col("phrase").cast("string"))
    phrases = phrases.withColumn("size", F.size(F.split("phrase", " ")))
    candidates = phrases.where("size > 1")
    split = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = candidates.withColumn("words", split).select(
        "lang", "size", "phrase", "f", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).select("lang", "size", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    of = lambda name, value: phrases.where("size < 4").select(F.col("lang").alias(f"lang_{name}"), F.col("phrase").alias(f"phrase_{name}"), F.col("f").alias(value))
    scored = (
        cuts.join(of("l", "l"), (F.col("lang") == F.col("lang_l")) & (F.col("head") == F.col("phrase_l")))
        .join(of("r", "r"), (F.col("lang") == F.col("lang_r")) & (F.col("tail") == F.col("phrase_r")))
        .withColumn("score", F.expr(f"cast(f as decimal(19, 0)) * {SCALE}BD div (l + r)"))
    )
    best = scored.groupBy("lang", "phrase", F.col("f").alias("a")).agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = (
        candidates.where("size > 2").withColumn("words", split)
        .select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
        .select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    )
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("above").isNull() | (F.col("above").cast("decimal(21,0)") * 100 < F.col("a").cast("decimal(21,0)") * covered))
    flat = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(totals, "lang").select(F.col("lang").alias(lang), "rank", "phrase", "a", "l", "r", "n", "score")
