"""Token counts with a cache keyed by content digest and tokenizer version.

Texts are normalised only in ways that cannot change the count (null becomes empty; the tokenizer itself normalises
the rest).  Digests of the distinct texts are joined to the cache, only the misses are encoded, and
their counts are appended to it.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.tokens import encoder, vocabulary_path

CACHE = "version string, digest binary, n_tokens long, batch string"
SLICE = 512


def tokenizer_version(tokenizer: str) -> str:
    """Digest of the vocabulary file and of the library's release."""
    import sentencepiece
    import tokenizers

    with open(vocabulary_path(tokenizer), "rb") as file:
        told = hashlib.sha256(file.read())
    library = sentencepiece if tokenizer.endswith(".model") else tokenizers
    told.update(f"{tokenizer} {library.__version__}".encode())
    return told.hexdigest()


def _lengths(tokenizer: str):
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(tokenizer))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    made = encoder(tokenizer)
    return lambda texts: [len(x) // made.width for x in made.encode(texts)]


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; a path without a cache is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE).parquet(path)
    return spark.range(0).selectExpr("'' as version", "cast(null as binary) as digest", "id as n_tokens", "'' as batch")


def digest_of(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def add_missing(docs: DataFrame, path: str, tokenizer: str, text: str = "text") -> str:
    """Encode each distinct text that the cache lacks for this tokenizer version once, and append its count; returns the name of the batch.

    A writer that fails leaves the cache as it was; writers that run at once may both append a digest, which does no harm.
    """
    spark, version, name = docs.sparkSession, tokenizer_version(tokenizer), uuid.uuid4().hex
    known = read_cache(spark, path).where(F.col("version") == version).select("digest")
    rows = docs.select(digest_of(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    misses = rows.dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def count(batches):
        lengths = _lengths(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                counts = lengths(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(counts), pa.string()), some.column("digest"), pa.array(counts, pa.int64()),
                     pa.array([name] * len(counts), pa.string())],
                    names=["version", "digest", "n_tokens", "batch"],
                )

    misses.mapInArrow(count, CACHE).write.mode("append").parquet(path)
    return name


def count_tokens(
    docs: DataFrame, path: str, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit and hit of every row, through the cache at ``path`` on a shared folder.

    ``hit`` tells whether the cache had the count before this call.  A digest that the cache holds twice counts once.  Null texts are empty; repeated rows and texts are kept, each encoded once; an empty table gives no rows; columns
    other than the two named stay out, so their names do not matter.
    """
    batch = add_missing(docs, path, tokenizer, text)
    stored = read_cache(docs.sparkSession, path).where(F.col("version") == tokenizer_version(tokenizer))
    stored = stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"), F.max(F.col("batch") != batch).alias("hit"))
    rows = docs.select(F.col(key), digest_of(text).alias("digest"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    return rows.join(stored, "digest").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "hit")
