"""Near-duplicates by SimHash fingerprints that differ in few bits, found by meeting in the middle.

Two fingerprints at most 2 r bits apart have a common variant within r bits of each.  Every distinct fingerprint emits its
variants (2,081 for r = 2), variants are dealt by a linear hash, and equal variants meet.  Since that hash is linear,
the hash of a variant is the hash of the fingerprint xor one of the flipped bits: a fingerprint is sent once to each part in which
variants of it fall, and the part lists those variants itself.  Inside a part, variants are sorted in blocks; fingerprints that share one
are at most 2 r bits apart, so each is linked to the least of them (no pairs within the group), deduplicated and verified.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.graph import components
from proofline.session import cut

SEED = 42
RADIUS = 4
#: Fingerprints that one part may hold; up to so many all parts get all of them, beyond it there are more parts.
PART_FINGERPRINTS = 8_000_000
#: Parts at least, a power of two.
PARTS = 128
#: Variants that a part sorts at once.
BLOCK = 4_000_000
SLICE = 512


# ---- fingerprints -------------------------------------------------------------------------------

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: bytes, words: int) -> int:
    """64-bit SimHash over shingles of so many words of a UTF-8 text; 0 without words."""
    import xxhash

    found = text.translate(_LOWER).split()  # bytes split at space and \t \n \v \f \r only
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(found)) - 1 :]
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), last.tolist())), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, n, 65_536):
        bits = np.unpackbits(hashes[low : low + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print): the fingerprint as a signed long; null texts have no words."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def stamp(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                found = np.asarray([fingerprint_of(x, words) for x in some.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found.view(np.int64))], names=["key", "print"])

    return rows.mapInArrow(stamp, f"key {kind}, print long")


# ---- links --------------------------------------------------------------------------------------

def flips(radius: int) -> np.ndarray:
    """All masks of at most so many bits."""
    masks = [0]
    for k in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in itertools.combinations(range(64), k)]
    return np.asarray(masks, dtype=np.uint64)


def linear_hash(values: np.ndarray, bits: int) -> np.ndarray:
    """A hash with h(a ^ b) = h(a) ^ h(b): bit k is the parity of the value under a fixed mask."""
    out = np.zeros(values.shape, dtype=np.int64)
    seeds = np.random.default_rng(20_240_601).integers(0, 2**64, size=64, dtype=np.uint64)
    for k in range(bits):
        out |= (np.bitwise_count(values & seeds[k]).astype(np.int64) & 1) << k
    return out


def star_links(prints: np.ndarray, masks: np.ndarray, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(greater, least) fingerprints of the part that share a variant in it; sorted distinct ``prints``.

    Variants are listed block by block, dealt by further bits of the same linear hash, so that equal ones share a block.
    """
    todo = len(prints) * len(masks) >> bits
    finer = max(0, (todo // BLOCK).bit_length())
    own = linear_hash(prints, bits + finer)
    mask_hash = linear_hash(masks, bits + finer)
    order, by_hash = np.argsort(own, kind="stable"), np.argsort(mask_hash, kind="stable")
    groups, begins = np.unique(own[order], return_index=True)
    begins, sorted_hash = np.append(begins, len(own)), mask_hash[by_hash]
    upper, lower = [], []
    for fine in range(1 << finer):
        # the masks that lead from the hash of a group of fingerprints to this block
        wanted = groups ^ (part | fine << bits)
        low, high = np.searchsorted(sorted_hash, wanted, "left"), np.searchsorted(sorted_hash, wanted, "right")
        variants, owners = [], []
        for g in np.flatnonzero(high > low).tolist():
            rows, some = order[begins[g] : begins[g + 1]], masks[by_hash[low[g] : high[g]]]
            variants.append((prints[rows][:, None] ^ some[None, :]).ravel())
            owners.append(np.repeat(rows, len(some)))
        if not variants:
            continue
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        at = np.argsort(variants)
        variants, owners = variants[at], owners[at]
        head = np.concatenate([[True], variants[1:] != variants[:-1]])
        if head.all():
            continue
        least = np.minimum.reduceat(owners, np.flatnonzero(head))[np.cumsum(head) - 1]
        linked = owners != least
        pairs = np.unique(owners[linked].astype(np.int64) * len(prints) + least[linked])
        upper.append(prints[pairs // len(prints)])
        lower.append(prints[pairs % len(prints)])
    if not upper:
        return prints[:0], prints[:0]
    return np.concatenate(upper), np.concatenate(lower)


def links(prints: DataFrame, radius: int = RADIUS, count: int | None = None) -> DataFrame:
    """(u, v) links between distinct fingerprints ``print`` at most ``radius`` (even) bits apart; their components are those of all such pairs."""
    count = prints.count() if count is None else count
    masks = flips(radius // 2)
    parts = PARTS
    while count > PART_FINGERPRINTS and parts * PART_FINGERPRINTS < count * len(masks):
        parts *= 2
    bits = parts.bit_length() - 1
    steps = np.unique(linear_hash(masks, bits))

    def emit(batches):
        for batch in batches:
            found = batch.column(0).to_numpy()
            own = linear_hash(found.view(np.uint64), bits)
            for low in range(0, len(found), 4096):
                to = (own[low : low + 4096, None] ^ steps[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                sent = found[low + order // len(steps)]
                to, begins = np.unique(to[order], return_index=True)
                packed = [x.tobytes() for x in np.split(sent, begins[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(packed, pa.binary())], names=["part", "prints"])

    def meet(group: pa.Table) -> pa.Table:
        found = np.unique(np.frombuffer(b"".join(group["prints"].to_pylist()), dtype=np.uint64))
        u, v = star_links(found, masks, group["part"][0].as_py(), bits)
        near = np.bitwise_count(u ^ v) <= radius
        return pa.table({"u": u[near].view(np.int64), "v": v[near].view(np.int64)})

    sent = prints.select("print").mapInArrow(emit, "part long, prints binary")
    return sent.groupBy("part").applyInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id: the least key reachable over fingerprints at most ``radius`` bits apart.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows and copies share their fingerprint, so they
    never grow the search; rows with a null key are kept but give no id.  An empty table gives no rows; other columns stay out.
    """
    stamped = cut(fingerprints(docs, words, key, text))  # texts are hashed once
    distinct = cut(stamped.groupBy("print").agg(F.min("key").alias("least")))
    found = components(links(distinct, radius))
    named = distinct.join(found, distinct["print"] == found["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("component"),
    )
    named = cut(named)
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))  # a plain table: Spark can split the join
    ids = named.select("print", "component").join(least, "component").select("print", "component_id")
    return stamped.join(ids, "print").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id",
    )
