"""Token ids as raw shard files with a minimal perfect hash index from document keys to shard offsets.

``ids/*.ids``     payloads: the ids of a run of documents, back to back, as raw little-endian integers
``entries``       one row per document: where the payload lies; also the list of files that count
``shards``        one row per shard: its file and the ids before it
``index``         one row per bucket of keys: a minimal perfect hash function and its slot records

A task that runs again writes a new file under another name; only files that the committed ``entries``
name are ever read, so retries and speculation cannot mix payloads.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.tokens import crc32_of, encoder

#: Keys of one bucket, on average; a bucket is built and read by one task at a time.
BUCKET_KEYS = 16_384
#: Bits a key gets on each level of the hash function.
BITS_PER_KEY = 2
#: Texts encoded at once.
SLICE = 512
RECORD = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


# ---- minimal perfect hashing --------------------------------------------------------------------

def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes and a level (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(2 * level + 1)) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mphf(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and all levels' bits: on each level the keys that fall alone on a bit own it, the others go on."""
    sizes, parts, level = [], [], 0
    while len(a):
        if level > 200:
            raise ValueError("two keys share both hashes")
        size = max(8, BITS_PER_KEY * len(a))
        spot = (_mix(a, b, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        rest = ~alone[spot]
        a, b, level = a[rest], b[rest], level + 1
    return sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def slots_of(a: np.ndarray, b: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key (0 to n - 1 for the keys built from), -1 for keys that certainly are not in."""
    before = np.concatenate([[0], np.cumsum(bits)])
    slots, todo, base = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        spot = base + (_mix(a[todo], b[todo], level) % np.uint64(size)).astype(np.int64)
        hit = bits[spot]
        slots[todo[hit]] = before[spot[hit]]
        todo, base = todo[~hit], base + size
    return slots


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


# ---- writing ------------------------------------------------------------------------------------

def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def key_hashes(*key: str | Column) -> tuple[Column, Column]:
    """Two hashes of a key.  Spark seeds each column's hash with that before it, so the literal stands first: keys equal in one differ in the other."""
    return F.xxhash64(*key), F.xxhash64(F.lit("mark"), *key)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write shards, entries and index below ``path``, a folder all executors share.

    Documents lie in ascending key order (null first), repeated keys side by side in text order and told apart
    by ``copy`` (0, 1, ...).  Null texts are empty; ``end_id`` is appended to each document.  Repeated
    keys lie in the same shard.  Other columns stay out, whatever their names; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    schema = f"key {ordered.schema['key'].dataType.simpleString()}, copy long, shard long, file string, offset long, n_tokens long"
    folder = f"{path}/ids"

    def write(batches):
        made = encoder(tokenizer)
        end = b"" if end_id is None else np.asarray([end_id], dtype=made.kind).tobytes()
        shard, file, out = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids", None
        offset, last, copy = 0, object(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                if out is None:
                    store, place = _store(folder)
                    store.create_dir(place, recursive=True)
                    out = store.open_output_stream(f"{place}/{file}")
                ids = made.encode(some.column(1).to_pylist())
                copies, offsets, lengths = [], [], []
                for k, x in zip(some.column(0).to_pylist(), ids):
                    copy, last = (copy + 1 if k == last else 0), k
                    out.write(x + end)
                    copies.append(copy)
                    offsets.append(offset)
                    lengths.append((len(x) + len(end)) // made.width)
                    offset += lengths[-1]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(copies, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([file] * n, pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["key", "copy", "shard", "file", "offset", "n_tokens"],
                )
        if out is not None:
            out.close()

    ordered.mapInArrow(write, schema).write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    shards = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard file
    shards.select("shard", "file", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/shards")
    write_index(entries, f"{path}/index")


def write_index(entries: DataFrame, path: str) -> None:
    """One minimal perfect hash function per bucket of (key, copy); each slot holds a fingerprint and the payload's place."""
    count = entries.count()
    a, b = key_hashes("key", "copy")
    buckets = max(1, -(-count // BUCKET_KEYS))
    keyed = entries.select(F.pmod(a, F.lit(buckets)).alias("bucket"), a.alias("a"), b.alias("b"), "shard", "offset", "n_tokens")

    def build(group: pa.Table) -> pa.Table:
        a, b = _unsigned(group["a"]), _unsigned(group["b"])
        sizes, bits = build_mphf(a, b)
        records = np.zeros(len(a), dtype=RECORD)
        at = slots_of(a, b, sizes, bits)
        records["mark"][at] = (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for name, column in (("shard", "shard"), ("offset", "offset"), ("n", "n_tokens")):
            records[name][at] = group[column].to_numpy()
        return pa.table({
            "bucket": group["bucket"].slice(0, 1), "buckets": pa.array([buckets], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "records": pa.array([records.tobytes()], pa.binary()),
        })

    schema = "bucket long, buckets long, sizes array<long>, bits binary, records binary"
    keyed.groupBy("bucket").applyInArrow(build, schema).write.parquet(path)


# ---- reading ------------------------------------------------------------------------------------

def locate(keys: DataFrame, path: str) -> DataFrame:
    """Shard, offset and length for each distinct (key, copy), by its slot; keys whose fingerprint differs are left out."""
    index = keys.sparkSession.read.parquet(f"{path}/index")
    a, b = key_hashes("key", "copy")
    head = index.select("buckets").limit(1).collect()
    buckets = head[0][0] if head else 1
    asked = keys.select("key", "copy", F.pmod(a, F.lit(buckets)).alias("bucket"), a.alias("a"), b.alias("b"))
    kind = keys.schema["key"].dataType.simpleString()

    def find(asked: pa.Table, index: pa.Table) -> pa.Table:
        out = asked.select(["key", "copy"])
        if not index.num_rows or not asked.num_rows:
            out, at = out.slice(0, 0), np.zeros(0, dtype=RECORD)
        else:
            sizes, records = index["sizes"][0].as_py(), np.frombuffer(index["records"][0].as_py(), dtype=RECORD)
            bits = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), dtype=np.uint8), count=sum(sizes)).astype(bool)
            a, b = _unsigned(asked["a"]), _unsigned(asked["b"])
            slots = slots_of(a, b, sizes, bits)
            right = (slots >= 0) & (records["mark"][slots] == (b & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            out, at = out.filter(pa.array(right)), records[slots[right]]
        for name in ("shard", "offset", "n"):
            out = out.append_column(name, pa.array(at[name].astype(np.int64)))
        return out

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, f"key {kind}, copy long, shard long, offset long, n long")


def read_payloads(located: DataFrame, path: str, tokenizer: str, digest_only: bool = False) -> DataFrame:
    """The ids behind located keys: key, copy, start (ids of all documents before), n_tokens, ids and their crc32.

    ``ids`` is the raw payload, or null with ``digest_only``.  Each task opens the shard it reads once and reads ranges.
    """
    shards = located.sparkSession.read.parquet(f"{path}/shards").select("shard", "file", "base")
    placed = located.join(shards, "shard").repartition("shard").sortWithinPartitions("shard", "offset")
    kind = located.schema["key"].dataType.simpleString()
    folder = f"{path}/ids"

    def read(batches):
        store, place = _store(folder)
        made, name, file = encoder(tokenizer), None, None
        for batch in batches:
            row = {x: batch.column(x) for x in ("key", "copy", "file", "offset", "n", "base")}
            ids, crcs = [], []
            for f, offset, n in zip(row["file"].to_pylist(), row["offset"].to_pylist(), row["n"].to_pylist()):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, store.open_input_file(f"{place}/{f}")
                raw = file.read_at(n * made.width, offset * made.width)
                crcs.append(crc32_of(made.words(raw)))
                ids.append(None if digest_only else raw)
            start = pa.array(np.asarray(row["base"]) + np.asarray(row["offset"]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [row["key"], row["copy"], start, row["n"], pa.array(ids, pa.binary()), pa.array(crcs, pa.int64())],
                names=["key", "copy", "start", "n_tokens", "ids", "ids_crc32"],
            )
        if file is not None:
            file.close()

    return placed.mapInArrow(read, f"key {kind}, copy long, start long, n_tokens long, ids binary, ids_crc32 long")


def keys_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every (key, copy) of a table of documents."""
    counted = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
