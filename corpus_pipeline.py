"""From raw documents to packed token sequences: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.mixing import mix, word_count
from proofline.llm.packing import pack_documents
from proofline.llm.pii import redact, train, with_spans
from proofline.llm.quality import judge
from proofline.llm.queries import VOCABULARY
from proofline.llm.simhash import near_duplicates
from proofline.session import cut

#: Names of helper columns, unlikely in any input.
_ROW, _TEXT = "__row_mark__", "__whole_text__"


def _marked(docs: DataFrame) -> DataFrame:
    """Adds a mark that only equal rows share: the document's id and 128 hashed bits of all columns that have an order."""
    kinds = {name: kind for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind}
    columns = [F.col(f"`{name}`") for name in kinds]
    mark = F.struct(F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("mark"), *columns).alias("b"))
    return docs.withColumn(_ROW, mark)


def _without(marked: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose mark is not listed.  The list grows with the corpus, so it is merged at every size and never broadcast."""
    return marked.join(marks.hint("merge"), _ROW, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    marked = _marked(docs)
    rejected = cut(judge(marked, key=_ROW).where("not kept").select(_ROW).distinct())
    return _without(marked, rejected).drop(_ROW)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    marked = _marked(docs)
    found = cut(near_duplicates(marked, key=_ROW).select(_ROW, (F.col(_ROW) == F.col("component_id")).alias("stays")))
    dropped = cut(found.where("not stays").select(_ROW).distinct())
    kept = _without(marked, dropped)
    # rows equal in all columns share their mark, so one of them is left only by leaving the others out here
    if not found.where("stays").groupBy(_ROW).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates([_ROW])
    return kept.drop(_ROW)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets; null texts stay null."""
    # only the whole row and its text, so that no column of the input meets a helper column of the operator
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias(_ROW), F.coalesce(F.col("text"), F.lit("")).alias(_TEXT))
    found = with_spans(rows, _TEXT, train(docs))
    clean = F.when(F.col(_ROW)["text"].isNotNull() & (F.size("spans") > 0), redact(F.col(_TEXT), F.col("spans"))).otherwise(F.col(_ROW)["text"])
    return _with_text(found.select(f"{_ROW}.*", clean.alias(_TEXT)), F.col(_TEXT), docs)


def _with_text(rows: DataFrame, text: Column, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with another text and its length."""
    changed = rows.withColumn("text", text)
    length = F.length("text").cast(like.schema["n_chars"].dataType) if "n_chars" in like.columns else None
    return (changed if length is None else changed.withColumn("n_chars", length)).select(*(f"`{c}`" for c in like.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document appears once per whole epoch, and the last one of each source is cut after the word that fills its budget."""
    whole = docs.select("doc_id", "source", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias(_ROW))
    taken = mix(whole, word_count(F.col("text")), carry=(_ROW,))
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - full * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    each = taken.select(F.col(_ROW), F.explode(copies).alias(_TEXT)).select(f"{_ROW}.*", _TEXT)
    space = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
    part = F.regexp_substr(F.col("text"), F.concat(F.lit(f"^(?:{space}){{"), F.col(_TEXT).cast("string"), F.lit("}+")))
    return _with_text(each, F.when(F.col(_TEXT) > 0, part).otherwise(F.col("text")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids (raw, little-endian) and places, as read back from the written sequences of 1024 tokens."""
    placed = pack_documents(docs, VOCABULARY, end_id=0)
    return placed.select(F.col("key").alias("doc_id"), "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality), ("near_duplicate", near_duplicate), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packing),
]
#: SQL cannot express the robust estimates, the trees or the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
