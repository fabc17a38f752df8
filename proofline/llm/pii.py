"""Personal data: base patterns, high-recall candidates, and boosted trees that pick redactions, in DataFrame functions only.

Base spans are found by fixed patterns and always stay.  Generators propose further, overlapping spans (obfuscated
addresses, numbers with other separators, long addresses); boosted trees score them by format and context, and a
threshold per kind, calibrated on held-out rows, selects the ones to add.  The trees are read into plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.session import cut

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<start:int,end:int,kind:int,match:string>"

#: Base patterns.  Possessive repeats keep the matcher from recursing and retrying; an address starts where a run of its characters does,
#: or where the match before ended, as it would by trying every position.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that is true wherever the base pattern matches.
_MAY = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": "+"}

#: Candidate generators per kind.
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?)[\p{L}\p{N}-]{1,63}+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[\p{L}\p{N}-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9A-Za-z._-])[0-9](?:[\x20._-]{0,2}+[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}+\)?[\x20./-]{1,2}+[0-9]{3,4}+[\x20./-][0-9]{3,4}+(?![0-9A-Za-z]|[.-][0-9])",
}
_LOOSE_MAY = {
    "email": r"[\[(]\x20?at\x20?[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "card": r"[0-9](?:[\x20._-]{0,2}[0-9]){11}",
    "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3}",
}
#: Words before a candidate that speak for its kind, and such that speak against any.
HINTS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b", "ip": r"(?i)\b(?:ip|ipv6|host|address|server|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|pay|payment)\b", "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|contact)\b",
}
AGAINST = r"(?i)\b(?:order|ref|part|isbn|serial|version|no|id|invoice|item|mac|at)\b"
DOMAIN = r"(?:\.|dot\x20?[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
CONTEXT = 24
#: Prefix sums of match positions go by blocks, so that their cost stays in proportion to the number of matches.
_BLOCK = 64


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn test."""
    padded = F.lpad(digits, 20, "0")
    at = [F.substring(padded, i, 1).cast("int") for i in range(1, 21)]
    total = reduce(lambda a, b: a + b, [d if i % 2 else 2 * d - F.when(d > 4, 9).otherwise(0) for i, d in enumerate(at)])
    return total % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(F.when(F.length(digits) <= 19, digits))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def find_spans(text: Column, pattern: str, may: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as an array of (start, end, kind, match), in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    inside = f"struct<at:int,out:array<{SPAN}>>"

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out")).cast(inside)

    def by_blocks(pairs: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")).cast(inside)
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)), empty, step),
        )
        bases = F.aggregate(
            F.transform(blocks, lambda b: b["at"]), F.array(F.lit(0)),
            lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
        )
        shifted = F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda block, base: F.transform(
            block["out"], lambda s: F.struct(
                (s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["kind"].alias("kind"), s["match"].alias("match"),
            ),
        ))
        return F.flatten(shifted)

    maybe = F.contains(text, F.lit(may)) if len(may) == 1 else text.rlike(may)
    # the pairs are the element of an array of one, so that they are found once
    found = F.flatten(F.transform(F.filter(F.array(pairs), lambda p: F.size(p) > 0), by_blocks))
    return F.when(maybe, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(find_spans(text, BASE[kind], _MAY[kind], KINDS.index(kind)), lambda s: _valid(kind, s["match"]))


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: the spans of the base patterns by start, then kind."""
    return rows.withColumn("base", F.array_sort(F.concat(*(base_spans(F.col(text), k) for k in KINDS)), _by_place))


def _by_place(a: Column, b: Column) -> Column:
    place = lambda s: s["start"].cast("long") * 8 + s["kind"]
    return F.signum(place(a) - place(b)).cast("int")


def candidates(text: Column) -> Column:
    """Spans of all generators, overlaps included."""
    return F.concat(*(find_spans(text, LOOSE[k], _LOOSE_MAY[k], KINDS.index(k)) for k in KINDS))


#: Names of the features the trees see, in order.
FEATURES = (
    "kind", "length", "digits", "letters", "separators", "distinct", "luhn", "bracket", "pairs", "groups", "domain", "hint", "against", "open_left",
)


def features(kind: Column, match: Column, left: Column) -> dict[str, Column]:
    """Numeric features of a candidate by its format and the text to its left."""
    digits = _digits(match)
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    hint = reduce(lambda a, b: a | b, [(kind == i) & left.rlike(HINTS[k]) for i, k in enumerate(KINDS)])
    values = (
        kind.cast("double"), F.length(match), F.length(digits), F.length(F.regexp_replace(match, r"[^\p{L}]", "")),
        F.length(F.regexp_replace(match, r"[\p{L}\p{N}]", "")), F.size(F.array_distinct(F.split(digits, ""))),
        number(luhn(F.when(F.length(digits) <= 20, digits))), number(match.rlike(r"[\[(]")), number(match.rlike("^(?:[0-9A-Fa-f]{1,2}:)+[0-9A-Fa-f]{1,2}$")),
        F.size(F.split(match, r"[^\p{L}\p{N}]+", -1)), number(F.lower(match).rlike(DOMAIN)), number(hint), number(left.rlike(AGAINST)),
        number(left.rlike(r"(?:^|[\s,;(])$")),
    )
    return {name: F.coalesce(v.cast("double"), F.lit(0.0)) for name, v in zip(FEATURES, values)}


# ---- training -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, their weights, and a threshold per kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: tuple[float | None, ...] = (None,) * len(KINDS)

    def score(self, found: dict[str, Column]) -> Column:
        def tree(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(found[name] <= threshold, tree(left)).otherwise(tree(right))

        return reduce(lambda a, b: a + b, [tree(t) * w for t, w in zip(self.trees, self.weights)], F.lit(0.0))

    def accepts(self, kind: Column, found: dict[str, Column]) -> Column:
        if not self.trees or all(t is None for t in self.thresholds):
            return F.lit(False)
        least = F.element_at(F.array(*(F.lit(float("inf") if t is None else t) for t in self.thresholds)), kind + 1)
        return self.score(found) >= least


#: Documents, by smallest hash, whose words surround the training entities; a bound of the training set at every corpus size.
TRAIN_DOCUMENTS = 400
#: Share of held-out candidates above a threshold that must be right.
PRECISION = 0.99
ROUNDS, DEPTH = 12, 4


def _entities() -> Column:
    """Planted examples (kind, right, hint, entity) from a random number ``h`` and two card numbers; the wrong ones look alike."""
    d = lambda n, salt: F.lpad(F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    x = lambda n, salt: F.substring(F.lower(F.hex(F.xxhash64("h", F.lit(salt)))), 1, n)
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    card, wrong = F.col("card"), F.col("wrong")
    fours = lambda c, sep: F.regexp_replace(c, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    name, host = F.concat(F.lit("n"), x(6, "name")), F.concat(F.lit("m"), x(5, "host"))
    zone = pick(("com", "org", "net", "de", "fr"), "zone")
    at, dot = pick((" (at) ", "(at)", " [at] ", "[at]"), "at"), pick((".", " (dot) ", " [dot] "), "dot")
    ip6 = F.concat_ws(":", *(x(4, f"g{i}") for i in range(8)))
    one = lambda kind, right, hint, entity: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(right).alias("right"), hint.alias("hint"), entity.alias("entity"))
    plain = F.lit("")
    doubt = pick(("order ", "ref ", "part ", "serial ", ""), "doubt")
    return F.array(
        one("email", True, pick(("mail ", "contact ", ""), "h1"), F.concat(name, at, host, dot, zone)),
        one("email", False, plain, F.concat(name, F.lit(" (at) "), host, F.lit("."), x(7, "word"))),
        one("email", False, plain, F.concat(F.lit("x"), d(1, "e"), F.lit(" [at] "), d(2, "f"), F.lit("."), d(2, "g"))),
        one("ip", True, pick(("host ", "ip ", ""), "h2"), ip6),
        one("ip", False, pick(("mac ", ""), "h3"), F.concat_ws(":", *(x(2, f"m{i}") for i in range(6)))),
        one("ip", False, plain, F.concat_ws(":", *(d(2, f"t{i}") for i in range(4)))),
        one("card", True, pick(("card ", "visa ", ""), "h4"), fours(card, ".")),
        one("card", True, pick(("card ", "pay ", ""), "h5"), fours(card, "_")),
        one("card", True, pick(("card ", ""), "h6"), fours(card, "  ")),
        one("card", False, doubt, fours(wrong, ".")),
        one("card", False, doubt, fours(wrong, "  ")),
        one("card", False, doubt, F.concat_ws(".", d(5, "a"), d(5, "b"), d(4, "c"))),
        one("phone", True, pick(("phone ", "call ", "tel "), "h7"), F.concat(F.lit("("), d(3, "p"), F.lit(") "), d(3, "q"), F.lit("-"), d(4, "r"))),
        one("phone", True, pick(("phone ", "call ", "mobile "), "h8"), F.concat_ws("-", d(3, "p"), d(3, "q"), d(4, "r"))),
        one("phone", False, doubt, F.concat_ws("-", d(3, "p"), d(3, "q"), d(4, "r"))),
        one("phone", False, doubt, F.concat_ws("/", d(2, "p"), d(4, "q"), d(4, "r"))),
        one("phone", False, plain, F.concat_ws(" ", d(4, "p"), d(4, "q"), d(4, "r"))),
    )


def training_rows(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled candidates (features, right, part: 0 and 2 to fit, 1 to set thresholds, 3 to test): planted entities between words of a bounded sample of documents."""
    sample = (
        docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string"), F.lit("train")).alias("h"), F.substring(text, 1, 400).alias("words"))
        .orderBy("h", "words").limit(documents)
    )
    words = F.regexp_extract_all(F.col("words"), F.lit(r"\p{L}+"), F.lit(0))
    body = F.concat(F.lit("4"), F.lpad(F.pmod(F.xxhash64("h", F.lit("card")), F.lit(10**14)).cast("string"), 14, "0"))
    last = [F.col("body")[i] for i in range(15)]
    total = reduce(lambda a, b: a + b, [2 * c - F.when(c > 4, 9).otherwise(0) if i % 2 == 0 else c for i, c in enumerate(last)])
    numbers = cut(sample.select("h", words.alias("words"), F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr(body, i, F.lit(1)).cast("int")).alias("body")))
    numbers = cut(numbers.select("h", "words", "body", F.pmod(10 - total % 10, F.lit(10)).alias("check")))
    number = lambda check: F.concat(F.array_join(F.col("body").cast("array<string>"), ""), check.cast("string"))
    numbers = numbers.withColumns({"card": number(F.col("check")), "wrong": number(F.pmod(F.col("check") + 3, F.lit(10)))})
    each = cut(numbers.select("h", "words", F.explode(_entities()).alias("e")))
    left = F.concat(F.array_join(F.slice("words", 1, 6), " "), F.lit(" "), F.col("e.hint"))
    whole = F.concat(left, F.col("e.entity"), F.lit(" "), F.array_join(F.slice("words", 7, 6), " "))
    rows = each.select("h", "e", F.length(left).alias("start"), whole.alias("whole"))
    spans = rows.select("h", "e", "start", "whole", F.explode(candidates(F.col("whole"))).alias("s"))
    near = spans.where((F.col("s.start") < F.col("start") + F.length("e.entity")) & (F.col("s.end") > F.col("start")))
    right = F.col("e.right") & (F.col("s.kind") == F.col("e.kind")) & (F.col("s.start") == F.col("start")) & (F.col("s.end") == F.col("start") + F.length("e.entity"))
    return near.select(
        right.cast("double").alias("right"), F.pmod(F.col("h"), F.lit(4)).cast("int").alias("part"),
        *(v.alias(n) for n, v in features(F.col("s.kind"), F.col("s.match"), context(F.col("whole"), F.col("s.start"))).items()),
    )


def context(text: Column, start: Column) -> Column:
    return F.substr(text, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(F.lit(CONTEXT), start))


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, key: str = "doc_id", text: str = "text") -> Model:
    """Boosted trees on one half of the labelled candidates, thresholds for ``PRECISION`` on a quarter; the last quarter is for tests.  No rows give no model."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut(training_rows(docs, documents, key, text).coalesce(1))  # a few thousand rows by the bound above
    told = rows.where("part % 2 = 0").agg(F.min("right"), F.max("right")).collect()[0]
    if told[0] == told[1]:
        return Model()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
    fitted = GBTClassifier(featuresCol="vector", labelCol="right", maxIter=ROUNDS, maxDepth=DEPTH, seed=7, stepSize=0.3).fit(vectors.where("part % 2 = 0"))

    def read(node):
        if node.numDescendants() == 0:
            return node.prediction()
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild())

    model = Model(tuple(read(t._call_java("rootNode")) for t in fitted.trees), tuple(fitted.treeWeights))
    score = F.round(model.score({name: F.col(name) for name in FEATURES}), 3)
    counts = rows.where("part = 1").groupBy("kind", score.alias("score")).agg(F.sum("right").alias("right"), F.count("*").alias("n")).collect()
    thresholds = []
    for i in range(len(KINDS)):
        chosen, right, n = None, 0.0, 0
        for r in sorted((r for r in counts if r["kind"] == i), key=lambda r: -r["score"]):
            right, n = right + r["right"], n + r["n"]
            if right >= PRECISION * n and r["score"] > 0:
                chosen = r["score"]
        thresholds.append(None if chosen is None else chosen - 0.0005)
    return Model(model.trees, model.weights, tuple(thresholds))


# ---- results ------------------------------------------------------------------------------------

def with_spans(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """Adds ``base`` and ``spans``: base spans, and added ones that overlap no base span, by start, then kind."""
    rows = with_base(rows, text)
    if not model.trees:
        return rows.withColumn("spans", F.col("base"))
    rows = rows.withColumn("_loose", candidates(F.col(text)))

    def good(s: Column) -> Column:
        left = context(F.col(text), s["start"])
        # format and context go through an array of one, so that the features are built from names, not from copies of their expressions
        found = F.transform(F.array(F.struct(s["kind"].alias("k"), s["match"].alias("m"), left.alias("l"))), lambda x: F.struct(*(v.alias(n) for n, v in features(x["k"], x["m"], x["l"]).items())))
        right = F.exists(found, lambda f: model.accepts(s["kind"], {n: f[n] for n in FEATURES}))
        return right & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    more = F.when(F.size("_loose") > 0, F.filter("_loose", good)).otherwise(F.col("_loose"))
    return rows.withColumn("spans", F.array_sort(F.concat("base", more), _by_place)).drop("_loose")


def told(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans (arrays of start, end, kind number, match) of every row.

    Null texts are empty and have no spans; repeated rows repeat; an empty table gives no rows (and trains no model); other columns
    stay out, whatever their names.  ``model`` is trained on the table if not given.
    """
    model = train(docs, key=key, text=text) if model is None else model
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return with_spans(rows, "_text", model).select(F.col("_key").alias(key), "base", "spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    merged = F.aggregate(
        spans, F.array().cast(f"array<{SPAN}>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"),
                F.try_element_at(done, F.lit(-1))["kind"].alias("kind"), F.lit("").alias("match"),
            ))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("").alias("match"))))),
    )
    name = lambda s: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1)
    whole = lambda m: F.concat(
        F.array_join(F.transform(F.sequence(F.lit(1), F.size(m)), lambda i: F.concat(
            F.substr(text, F.when(i > 1, F.try_element_at(m, i - 1)["end"]).otherwise(0) + 1,
                     F.element_at(m, i)["start"] - F.when(i > 1, F.try_element_at(m, i - 1)["end"]).otherwise(0)),
            name(F.element_at(m, i)),
        )), ""),
        F.substr(text, F.element_at(m, -1)["end"] + 1),
    )
    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(merged), whole), 1)).otherwise(text)
