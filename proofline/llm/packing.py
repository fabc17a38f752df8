"""Best-fit decreasing packing of token pieces into sequences of a fixed window.

Overlong documents are cut into full windows first; what remains is shorter than a window.  Pieces differ only in
their length, so best-fit decreasing runs over the counts per length (at most one number per length, whatever the
corpus holds): from the longest length down, a segment tree over remaining capacities finds the tightest open
sequences, and runs of equal sequences are filled together.  Of equally tight sequences the one with the lowest number
is filled first.  Spark numbers the pieces of each length and reads off their places, so the result is the one that
best-fit decreasing gives piece by piece.

Ids are written once with their pieces, and once as sequences.  A full window is a sequence as it is; only shorter pieces are
shuffled, once, to their sequences.  The numbering reads no ids: a task numbers its own pieces of each length while it writes
them, and a small table tells how many pieces of a length the tasks before it have.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.tokens import crc32_of, encoder
from proofline.session import drop_table, scratch_path

WINDOW = 1024
SLICE = 512
#: Rows (writing task, length) whose places are broadcast, about 100 bytes each; more are joined by a shuffle, with the same result.
BROADCAST_ROWS = 500_000
_SEGMENT = "struct<rank:bigint,sequence:bigint,per:bigint,offset:bigint>"


class CapacityTree:
    """Segment tree over capacities 0..window; a node tells whether any capacity below it has open sequences."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, filled: bool) -> None:
        at = capacity + self.leaves
        self.any[at] = filled
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with open sequences."""
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass
class Plan:
    """Places by length: pieces numbered from ``rank`` on go ``per`` to a sequence, from ``sequence`` and ``offset`` on."""

    window: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        table = np.asarray(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        return dict(zip(("length", "rank", "sequence", "per", "offset"), table.T.copy()))


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Plan from the number of pieces of each length (1 to ``window``); of sequences with equal room the lowest number goes first."""
    plan, tree, open_at = Plan(window), CapacityTree(window), {c: [] for c in range(window + 1)}
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, new = window, -(-(n - rank) // (window // length))
                heapq.heappush(open_at[window], (plan.sequences, new))
                plan.sequences += new
            first, run = heapq.heappop(open_at[capacity])
            # a sequence that takes a piece is the tightest for the next one until it is too full
            per = min(capacity // length, n - rank)
            used = min(run, (n - rank) // per)
            plan.rows.append((length, rank, first, per, window - capacity))
            rank += used * per
            if run > used:
                heapq.heappush(open_at[capacity], (first + used, run - used))
            tree.set(capacity, bool(open_at[capacity]))
            if left := capacity - per * length:
                heapq.heappush(open_at[left], (first, used))
                tree.set(left, True)
    return plan


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Token pieces of whole texts: full windows from the start, then the rest.

    Returns key, start, length, ids (raw little-endian ids), ids_crc32, doc_tokens, the task that cut the piece, and how many
    pieces of its length that task had cut before.
    Null texts are empty; a document without any id gives no piece; repeated rows give repeated pieces;
    other columns stay out, whatever their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def pieces(batches):
        made = encoder(tokenizer)
        end = b"" if end_id is None else np.asarray([end_id], dtype=made.kind).tobytes()
        task, had = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                owner, start, length, ids, crc, total, before = [], [], [], [], [], [], []
                for i, packed in enumerate(made.encode(some.column(1).to_pylist())):
                    words = made.words(packed + end)
                    for begin in range(0, len(words), window):
                        piece = words[begin : begin + window]
                        owner.append(i)
                        start.append(begin)
                        length.append(len(piece))
                        ids.append(piece.tobytes())
                        crc.append(crc32_of(piece))
                        total.append(len(words))
                        before.append(had[len(piece)])
                        had[len(piece)] += 1
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()),
                     pa.array([task] * len(owner), pa.int64()), pa.array(before, pa.int64())],
                    names=["key", "start", "length", "ids", "ids_crc32", "doc_tokens", "task", "before"],
                )

    return rows.mapInArrow(pieces, f"key {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, task long, before long")


def write_ids(table: DataFrame, path: str) -> DataFrame:
    """Writes rows with ids, which only an entropy coder makes smaller, and reads them back."""
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def pack(pieces: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces as ``cut_pieces`` gives them, with sequence_id and offset in place of task and before; all other columns are carried along.

    The pieces are written to ``path`` (a scratch path if there is none), so that all that follows sees the same rows.  Pieces of
    a length are numbered by task and, within it, as they were cut.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    kept = write_ids(pieces, path or scratch_path(spark, "pieces"))
    sizes = kept.groupBy("task", "length").agg((F.max("before") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    if any(not 1 <= x <= window for x in counts):
        raise ValueError("a piece is empty or longer than the window")
    plan = best_fit_decreasing(counts, window).arrays()
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.select("task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    segment = pa.struct([(x, pa.int64()) for x in ("rank", "sequence", "per", "offset")])

    def segments(batches):
        """The rows of the plan that hold a task's pieces of a length, with ranks counted from the task's first one."""
        for batch in batches:
            found = []
            for length, n, base in zip(*(batch.column(x).to_pylist() for x in ("length", "n", "base"))):
                low, high = np.searchsorted(plan["length"], [length, length + 1])
                ranks = plan["rank"][low:high]
                first, beyond = low + np.searchsorted(ranks, base, side="right") - 1, low + np.searchsorted(ranks, base + n)
                found.append([
                    {"rank": r - base, "sequence": s, "per": p, "offset": o}
                    for r, s, p, o in zip(*(plan[x][first:beyond].tolist() for x in ("rank", "sequence", "per", "offset")))
                ])
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("length"), pa.array(found, pa.list_(segment))], names=["task", "length", "segments"])

    places = based.mapInArrow(segments, f"task long, length long, segments array<{_SEGMENT}>")
    if sizes.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    joined = kept.join(places, ["task", "length"]).withColumn("segment", F.element_at(F.filter("segments", lambda s: s["rank"] <= F.col("before")), -1))
    inside, per = F.col("before") - F.col("segment.rank"), F.col("segment.per")
    return joined.select(
        *(c for c in pieces.columns if c not in ("task", "before")),
        (F.col("segment.sequence") + F.floor(inside / per)).alias("sequence_id"), (F.col("segment.offset") + inside % per * F.col("length")).alias("offset"),
    )


def sequences(placed: DataFrame, tokenizer: str, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """The packed rows: sequence_id, ids (raw), n_tokens and piece borders; padded to the window unless the length is a power of two.

    ``keys``, ``starts`` and ``totals`` tell whose the pieces are.  A piece as long as the window is a sequence where it lies; the others
    are shuffled.  Rows of a sequence meet sorted, so a task holds one sequence at a time besides its batch.
    """
    columns = ["sequence_id", "length", "ids", "offset", "key", "start", "doc_tokens"]
    full = placed.where(F.col("length") == window).select(
        "sequence_id", "ids", F.col("length").alias("n_tokens"), F.array("offset").alias("borders"), F.array("key").alias("keys"),
        F.array("start").alias("starts"), F.array("doc_tokens").alias("totals"),
    )
    rows = placed.where(F.col("length") < window).select(*columns).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    kind = rows.schema["key"].dataType.simpleString()
    long_list = pa.list_(pa.int64())

    def join(batches):
        width = encoder(tokenizer).width
        pad = int(pad_id).to_bytes(width, "little")

        def whole(some: pa.Table) -> pa.RecordBatch:
            """Rows of whole sequences."""
            sequence = some["sequence_id"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            ends = np.append(begins[1:], len(sequence))
            n_tokens = np.add.reduceat(some["length"].to_numpy(), begins)
            pieces, packed = some["ids"].to_pylist(), []
            for a, b, n in zip(begins.tolist(), ends.tolist(), n_tokens.tolist()):
                packed.append(b"".join(pieces[a:b]) + (pad * (window - n) if n & (n - 1) else b""))
            spots = pa.array(np.append(begins, len(sequence)), pa.int32())
            lists = [pa.ListArray.from_arrays(spots, some[x].combine_chunks()) for x in ("offset", "key", "start", "doc_tokens")]
            return pa.RecordBatch.from_arrays(
                [pa.array(sequence[begins]), pa.array(packed, pa.binary()), pa.array(n_tokens), *lists],
                names=["sequence_id", "ids", "n_tokens", "borders", "keys", "starts", "totals"],
            )

        left = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            some = some if left is None else pa.concat_tables([left, some])
            if not some.num_rows:
                continue
            sequence = some["sequence_id"].to_numpy()
            last = int(np.searchsorted(sequence, sequence[-1]))  # the last sequence may go on in the next batch
            if last:
                yield whole(some.slice(0, last))
            left = some.slice(last)
        if left is not None:
            yield whole(left)

    schema = f"sequence_id long, ids binary, n_tokens long, borders array<long>, keys array<{kind}>, starts array<long>, totals array<long>"
    return full.unionByName(rows.mapInArrow(join, schema))


def read_sequences(packed: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces that lie in packed rows, as ``pack`` places them: ids, length, offset and checksum are read off the rows' ids and borders."""
    kind = packed.schema["keys"].dataType.elementType.simpleString()

    def split(batches):
        made = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                length, ids, crc = [], [], []
                for packed_ids, n, borders in zip(*(some.column(x).to_pylist() for x in ("ids", "n_tokens", "borders"))):
                    words = made.words(packed_ids)
                    for begin, end in zip(borders, [*borders[1:], n]):
                        piece = words[begin:end]
                        length.append(len(piece))
                        ids.append(piece.tobytes())
                        crc.append(crc32_of(piece))
                counts = np.diff(np.asarray(some.column("borders").offsets))
                yield pa.RecordBatch.from_arrays(
                    [some.column("keys").flatten(), some.column("starts").flatten(), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(crc, pa.int64()), some.column("totals").flatten(), pa.array(np.repeat(some.column("sequence_id").to_numpy(), counts)),
                     some.column("borders").flatten()],
                    names=["key", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    columns = packed.select("sequence_id", "ids", "n_tokens", "borders", "keys", "starts", "totals")
    return columns.mapInArrow(split, (
        f"key {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Packs the pieces of all documents, writes the padded sequences to the shared folder and reads the pieces back from them.

    The table of pieces goes once the sequences stand.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    packed = write_ids(sequences(pack(cut_pieces(docs, tokenizer, end_id), path=path), tokenizer), scratch_path(spark, "sequences"))
    drop_table(spark, path)
    return read_sequences(packed, tokenizer)
