"""Ranked lexical search as a blocked dense product of item weights and document impacts.

A score is a sum over an item's terms of weight times impact, both whole numbers.  Items are taken in tiles with a compact
vocabulary of their own; documents become tiles of impacts over it, and BLAS multiplies the two.  In float64 such a product is
exact while every partial sum stays below 2^53, so the terms of a tile are multiplied in runs whose greatest possible sums stay
below that, and the runs are added up as 64-bit integers.

Documents are read once and become thin rows: their length and the counts of item terms.  Scoring keeps the best rows of each item
per task, with all ties decided by the id, so that only these are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut

#: Fixed values of the score: scale of weights, of impacts, and the two parts of the length norm.
WEIGHT_SCALE, IMPACT_SCALE, NORM_BASE, NORM_LENGTH = 1000, 1_000_000_000, 10, 90
#: Distinct terms per item, added up, of items whose vocabulary is broadcast at once; a single longer item stands alone.
GROUP_TERMS = 500_000
#: Items and documents of a tile.
TILE_ITEMS, TILE_DOCS = 256, 1_024
#: Float64 sums are exact below this.
EXACT = 1 << 53
#: Bytes of terms with A-Z lower-cased: digits, letters, and all bytes of other than ASCII characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in a text in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def runs_below(greatest: np.ndarray, limit: int = EXACT) -> list[slice]:
    """Runs of columns so that the sum of each row of ``greatest`` over a run stays below the limit."""
    out, first, total = [], 0, np.zeros(len(greatest), dtype=np.int64)
    for j in range(greatest.shape[1]):
        if j > first and (total + greatest[:, j]).max(initial=0) >= limit:
            out.append(slice(first, j))
            first, total = j, np.zeros_like(total)
        total = total + greatest[:, j]
    return [*out, slice(first, greatest.shape[1])]


def tile_scores(weights: np.ndarray, impacts: np.ndarray, runs: list[slice]) -> np.ndarray:
    """Exact products of a weight tile (items x terms) and an impact tile (terms x documents)."""
    total = np.zeros((weights.shape[0], impacts.shape[1]), dtype=np.int64)
    for run in runs:
        total += (weights[:, run] @ impacts[run]).astype(np.int64)
    return total


class Best:
    """The k best (score, id) per item; equal scores go to the smaller id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)  # scores below it are of no use; scores of 0 never are

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        for i, row in enumerate(scores, first):
            hits = np.flatnonzero(row >= self.least[i])
            if len(hits) > self.k:  # all that tie with the k-th stay in
                hits = hits[row[hits] >= np.partition(row[hits], len(hits) - self.k)[len(hits) - self.k]]
            if not len(hits):
                continue
            s, d, z = (np.concatenate(x) for x in zip(self.rows[i], (row[hits], ids[hits], nulls[hits])))
            best = np.lexsort((d, z, -s))[: self.k]
            self.rows[i] = s[best], d[best], z[best]
            if len(best) == self.k:
                self.least[i] = s[best[-1]]


def _counted(rows: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of every document with a term; terms are those of the vocabulary, as packed 32-bit numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        known = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if terms := terms_of(text):
                    found = Counter(filter(None, map(known.get, terms)))
                    packed = (np.fromiter(x, dtype="<u4", count=len(found)).tobytes() for x in (found.keys(), found.values()))
                    out.append((key, len(terms), *packed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)

    return cut(rows.mapInArrow(count, "id long, n long, terms binary, counts binary"))


def _holders(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary (numbers from 1)."""
    def add_up(batches):
        total = np.zeros(n_terms + 1, dtype=np.int64)
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(packed, "<u4"), minlength=n_terms + 1)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(here, pa.int64()), "df": pa.array(total[here], pa.int64())})

    out = np.zeros(n_terms + 1, dtype=np.int64)
    for r in counted.select("terms").mapInArrow(add_up, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _scored(counted: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """(item, id, score): the k best documents of each item in each task."""
    tiles = []
    for first in range(0, len(items), TILE_ITEMS):
        some = items[first : first + TILE_ITEMS]
        terms = np.array(sorted({t for item in some for t in item if weights[t]}), dtype=np.int64)
        spot = {t: i for i, t in enumerate(terms.tolist())}
        tile = np.zeros((len(some), len(terms)))
        for i, item in enumerate(some):
            tile[i, [spot[t] for t in item if t in spot]] = weights[[t for t in item if t in spot]]
        tiles.append((first, terms, tile))
    shared = counted.sparkSession.sparkContext.broadcast((tiles, len(weights), len(items)))
    kind = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    most = IMPACT_SCALE // WEIGHT_SCALE  # no impact is greater

    def score(batches):
        tiles, n_terms, n_items = shared.value
        best = Best(n_items, k)
        ready = [(first, terms, tile, runs_below(tile.astype(np.int64) * most)) for first, terms, tile in tiles]
        spots = []
        for _, terms, _, _ in ready:
            spot = np.full(n_terms, -1, dtype=np.int64)
            spot[terms] = np.arange(len(terms))
            spots.append(spot)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                packed = part.column(2).to_pylist()
                held = np.array([len(x) // 4 for x in packed])
                terms, counts = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (packed, part.column(3).to_pylist()))
                norm = np.array([NORM_BASE + NORM_LENGTH * n * n_docs // length for n in part.column(1).to_pylist()], dtype=np.int64)
                doc = np.repeat(np.arange(part.num_rows), held)
                impact = (IMPACT_SCALE * counts) // (WEIGHT_SCALE * counts + 8 * norm[doc])
                ids = part.column(0)
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for (first, own, tile, runs), spot in zip(ready, spots):
                    here = spot[terms]
                    use = here >= 0
                    dense = np.zeros((len(own), part.num_rows))
                    dense[here[use], doc[use]] = impact[use]
                    best.add(first, tile_scores(tile, dense, runs), ids, nulls)
        for i, (s, d, z) in enumerate(best.rows):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i), pa.int64()), pa.array(d, pa.int64(), mask=z), pa.array(s, pa.int64())], schema=kind)

    return counted.mapInArrow(score, "item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_key, rank (from 1), key, score: the k documents of highest score above 0 of each item, equal scores by ascending key.

    Every row of ``docs`` is a document and every row of ``items`` a search, so repeated rows rank one after another and repeated
    items repeat their answer.  Null texts have no terms; documents without terms count nowhere; a null key ranks behind all
    others of its score.  Keys of documents are whole numbers.  Empty tables give no rows; other columns stay out.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def distinct_terms(batches):
        for batch in batches:
            terms = [sorted(set(terms_of(x))) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["name", "terms"])

    asked = items.select(F.col(item_key).alias("name"), F.col(item_text).cast("string").alias("text"))
    asked = asked.mapInArrow(distinct_terms, f"name {kind.simpleString()}, terms array<binary>").where(F.size("terms") > 0)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    # groups of items of about equal numbers of terms; each is one broadcast of bounded size
    groups = max(1, -(-total // GROUP_TERMS))
    asked = cut(asked.withColumn("part", F.pmod(F.xxhash64("name", "terms"), F.lit(groups))))
    answers, length, n_docs = [], 0, 0
    for part in range(groups):
        own = asked.where(F.col("part") == part).select("name", "terms").collect()
        if not own and total:
            continue
        words = {w: i for i, w in enumerate(sorted({bytes(t) for r in own for t in r["terms"]}), 1)}
        counted = _counted(rows, words)
        if not n_docs:
            n_docs, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        held = _holders(counted, len(words))
        weights = np.array([weight(n_docs, df) if df else 0 for df in held.tolist()], dtype=np.int64)
        numbered = [[words[bytes(t)] for t in r["terms"]] for r in own]
        named = spark.createDataFrame([(i, r["name"]) for i, r in enumerate(own)], f"item long, name {kind.simpleString()}")
        answers.append(_scored(counted, numbered, weights, n_docs, length or 1, k).join(F.broadcast(named), "item").withColumn("part", F.lit(part)))
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("name").alias(item_key), "rank", F.col("id").alias(key), "score")
