"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items go into one automaton, so that every run of words inside any item is a path from its root.  A document's
words are streamed through it; after each word the state tells the longest run ending there that some item holds.  A run of at
least ``least_words`` words is leaked, and the state also names the items that hold its last window.  Items shorter than a window
leak as a whole and are found through the suffix links.

Documents are never shuffled.  An automaton holds at most ``SHARD_WORDS`` item words, the proven bound of what is broadcast;
larger item tables are cut into several automata, used one after another, and only the thin rows of what they found are merged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window; a leak is at least one window of an item, or a whole item that is shorter.
LEAST_WORDS = 10
#: Item words of one automaton (about 100 MB in each Python worker), and of one piece of a long item.
SHARD_WORDS, PIECE_WORDS = 200_000, 4_096
#: Bytes that belong to words once A-Z are lower-cased: digits, a-z, and all bytes of other than ASCII characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RUN = "struct<first:bigint,beyond:bigint,start:bigint,end:bigint>"


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of a text in UTF-8: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Automaton:
    """Generalised suffix automaton over words; ``go`` is keyed by state * number of words + word."""

    least: int
    words: dict[bytes, int]
    names: list[str]
    go: dict[int, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: By state: the state that stands for the window ending there, or -1.
    window: list[int] = field(default_factory=list)
    #: By window state: the items that hold it.
    holders: dict[int, set[int]] = field(default_factory=dict)
    #: By state at which a short item ends: its length and the items with these words.
    short: dict[int, tuple[int, set[int]]] = field(default_factory=dict)
    #: By state: the nearest state below it on the suffix links (itself included) at which a short item ends, or -1.
    ending: list[int] = field(default_factory=list)


def build_automaton(items: list[tuple[str, list[bytes]]], least: int = LEAST_WORDS) -> Automaton:
    """The automaton of (name, words) rows; rows of one name are one item."""
    names = sorted({name for name, _ in items})
    spot = {name: i for i, name in enumerate(names)}
    vocabulary: dict[bytes, int] = {}
    coded = [(spot[name], [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in items if words]
    size = max(1, len(vocabulary))
    made = Automaton(least, vocabulary, names)
    follow: list[dict[int, int]] = [{}]
    link, length = made.link, made.length

    def state(n: int, edges: dict[int, int], to: int) -> int:
        follow.append(edges)
        length.append(n)
        link.append(to)
        return len(length) - 1

    def split(p: int, word: int, q: int) -> int:
        """The state of the run that ``p`` spells before ``word``, taken out of ``q`` if that also holds longer ones."""
        if length[q] == length[p] + 1:
            return q
        clone = state(length[p] + 1, dict(follow[q]), link[q])
        link[q] = clone
        while p >= 0 and follow[p].get(word) == q:
            follow[p][word] = clone
            p = link[p]
        return clone

    for _, words in coded:
        last = 0
        for word in words:
            if word in follow[last]:  # an earlier item holds this run already
                last = split(last, word, follow[last][word])
                continue
            new, p = state(length[last] + 1, {}, 0), last
            while p >= 0 and word not in follow[p]:
                follow[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = split(p, word, follow[p][word])
            last = new

    made.go = {v * size + w: t for v, edges in enumerate(follow) for w, t in edges.items()}
    made.window, made.ending = [-1] * len(length), [-1] * len(length)
    by_length = sorted(range(1, len(length)), key=length.__getitem__)
    for v in by_length:
        if length[v] >= least:
            made.window[v] = v if length[link[v]] < least else made.window[link[v]]
    for item, words in coded:
        v = 0
        for n, word in enumerate(words, 1):
            v = follow[v][word]
            if n >= least:
                made.holders.setdefault(made.window[v], set()).add(item)
        if len(words) < least:
            made.short.setdefault(v, (len(words), set()))[1].add(item)
    for v in by_length:
        made.ending[v] = v if v in made.short else made.ending[link[v]]
    return made


def leaked_runs(automaton: Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged runs [first, beyond) of leaked words, and the items that hold them."""
    known, go, link, length, size = automaton.words.get, automaton.go.get, automaton.link, automaton.length, max(1, len(automaton.words))
    least, window, ending = automaton.least, automaton.window, automaton.ending
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    seen: set[int] = set()
    v = n = 0  # the longest run ending here that an item holds: its state and its length

    def keep(first: int, beyond: int) -> None:
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append((first, beyond))

    for i, word in enumerate(map(known, words)):
        if word is None:
            v = n = 0
            continue
        t = go(v * size + word)
        while t is None and v:
            v = link[v]
            n = length[v]
            t = go(v * size + word)
        if t is None:
            continue
        v, n = t, n + 1
        if n >= least:
            keep(i + 1 - n, i + 1)
            seen.add(window[v])
        e = ending[v]
        if e == v and n < length[v]:
            e = ending[link[v]]
        while e > 0:
            m, found = automaton.short[e]
            keep(i + 1 - m, i + 1)
            items |= found
            e = ending[link[e]]
    return runs, items.union(*(automaton.holders[u] for u in seen))


def _shards(items: DataFrame, item_key: str, item_text: str, least: int) -> list[DataFrame]:
    """Item pieces (name, words) in groups of at most ``SHARD_WORDS`` words; pieces of a long item overlap by a window less a word."""
    schema = pa.schema([("name", pa.string()), ("words", pa.list_(pa.binary())), ("n", pa.int64())])

    def pieces(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                parts = [words[i : i + PIECE_WORDS + least - 1] for i in range(0, max(1, len(words) - least + 1), PIECE_WORDS)]
                yield pa.RecordBatch.from_pydict({"name": [name] * len(parts), "words": parts, "n": [*map(len, parts)]}, schema)

    rows = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("string").alias("text"))
    cut_up = rows.mapInArrow(pieces, "name string, words array<binary>, n long").distinct()
    total = cut_up.agg(F.sum("n")).first()[0] or 0
    number = max(1, -(-total // SHARD_WORDS))
    while True:
        dealt = cut_up.withColumn("shard", F.pmod(F.xxhash64("name", "words"), F.lit(number)))
        largest = dealt.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= max(SHARD_WORDS, PIECE_WORDS + least - 1):
            return [dealt.where(F.col("shard") == i) for i in range(number)]
        number *= 2


def _stream(rows: DataFrame, shard: DataFrame, least: int) -> DataFrame:
    """Rows of (key, digest, text) become (key, digest, n_words, runs, items, longest)."""
    automaton = build_automaton([(r["name"], [bytes(w) for w in r["words"]]) for r in shard.select("name", "words").collect()], least)
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    run = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "beyond", "start", "end")]))

    def stream(batches):
        automaton = shared.value
        for batch in batches:
            numbers, runs, items = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text)
                leaked, found = leaked_runs(automaton, words)
                places = [m.span() for m in _WORD.finditer(text.decode())] if leaked else []
                numbers.append(len(words))
                runs.append([{"first": a, "beyond": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in leaked])
                items.append(sorted(automaton.names[x] for x in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), pa.array(runs, run), pa.array(items, pa.list_(pa.string()))],
                names=["key", "digest", "n_words", "runs", "items"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(stream, f"key {kind}, digest string, n_words long, runs array<{_RUN}>, items array<string>")


def _merged(runs: Column) -> Column:
    """Runs that meet or overlap joined, in order."""
    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["beyond"], run["beyond"]).alias("beyond"),
            last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"),
        )
        fits = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["beyond"] >= run["first"])
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast(f"array<{_RUN}>"), add)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """key, n_words, n_hit, item_ids (strings, sorted) and spans of every document, row by row.

    A span has its words [first, beyond) and its code points [start, end) in the text; spans neither meet nor overlap.

    Null texts have no words; items without words never occur; rows of one item id are one item, and a null id counts as an empty one.
    Repeated documents repeat; empty tables give no rows, or rows without hits; other columns, whatever their names, stay out.
    """
    return _found(docs.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("digest"), F.col(text).cast("string").alias("text")), items, item_key, item_text, least_words).select(
        F.col("key").alias(key), "n_words", "n_hit", "item_ids", "spans"
    )


def _found(rows: DataFrame, items: DataFrame, item_key: str, item_text: str, least: int) -> DataFrame:
    shards = _shards(items, item_key, item_text, least)
    if len(shards) == 1:
        found = _stream(rows, shards[0], least).withColumnsRenamed({"runs": "spans", "items": "item_ids"})
    else:
        named = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        # every row comes from the first automaton, and from later ones only where these found something
        parts = [_stream(named, shard, least).withColumn("rows", F.lit(int(i == 0))).where((F.lit(i) == 0) | (F.size("runs") > 0)) for i, shard in enumerate(shards)]
        whole = reduce(DataFrame.unionByName, parts).groupBy("key", "digest", "n_words").agg(
            F.sum("rows").alias("rows"), F.flatten(F.collect_set("runs")).alias("runs"), F.flatten(F.collect_set("items")).alias("items"),
        )
        found = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
            "key", "digest", "n_words", _merged(F.col("runs")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("item_ids"),
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["beyond"] - s["first"])
    return found.withColumn("n_hit", hit)


def remove_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    least_words: int = LEAST_WORDS, span_words: int = LEAST_WORDS, coverage: float = 0.5,
) -> DataFrame:
    """The documents without their leaks, with the columns they have.

    A document of which more than the share ``coverage`` of words is leaked goes; from the others spans of at least ``span_words``
    words are cut out.  Where such a span of words ends, the characters up to the next word stay.  Documents without leaks, null
    texts and all other columns are returned as they are; repeated rows repeat; column names may be any.
    """
    same = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), same.alias("digest"), F.col(text).cast("string").alias("text"))
    found = _found(rows.select("key", "digest", "text"), items, item_key, item_text, least_words).where("n_hit > 0")
    thin = found.select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), (F.col("n_hit") > F.col("n_words") * F.lit(coverage)).alias("_gone"), F.col("spans").alias("_spans"))
    joined = rows.join(thin.dropDuplicates(["_key", "_digest"]), F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    long_ones = F.filter("_spans", lambda s: s["beyond"] - s["first"] >= span_words)
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    kept = F.aggregate(
        long_ones, start, lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], piece(a["at"], s["start"])).alias("out")),
        lambda a: F.concat(a["out"], piece(a["at"], F.char_length("text").cast("long"))),
    )
    changed = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept)
    return joined.where(~F.coalesce("_gone", F.lit(False))).select(*[(changed if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
