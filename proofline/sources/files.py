"""Readers and writers for the file shapes the audits start from and end in."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions.documents import kind_at, with_document

# The largest JSON document, and files a manifest never lists.
LARGEST_DOCUMENT = 8 * 1024 * 1024
SKIPPED_FILES = r"(^|/)__pycache__/|\.pyc$|(^|/)\.DS_Store$|(^|/)SHA256SUMS$"
# A row holds a whole file up to this size; larger ones are read and hashed in blocks.
LARGEST_ROW = 1 << 26
BLOCK = 1 << 20

TRIGGER_SCHEMA = "id string, should_trigger boolean, prompt string, reason string"
CASE = "struct<id:string,prompt:string,reason:string>"
SUITE_SCHEMA = f"positive array<{CASE}>, negative array<{CASE}>"
BEHAVIOUR_SCHEMA = (
    "id string, track_id int, track string, prompt string, mode string, must array<string>, must_not array<string>, observable string"
)


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType, limit: int = LARGEST_DOCUMENT) -> DataFrame:
    """One JSON object per file: raw text, parsed struct and the reason it was refused.

    A file above ``limit`` bytes is refused by its length alone: it is not read, and its raw text is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = [F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes")]
    # the source tests the length before it opens a file, and leaves content out where it is not asked for
    raw = files.where(F.col("length") <= limit).select(*named, F.col("content").cast("string").alias("raw")).unionByName(
        files.where(F.col("length") > limit).select(*named, F.lit(None).cast("string").alias("raw")))
    read = with_document(raw, "raw")
    error = F.when(F.col("bytes") > limit, "too large").when(F.col("_v").isNull(), "not JSON").when(
        ~kind_at(F.col("_v")).startswith("OBJECT<"), "not an object")
    parsed = F.from_json("raw", schema)
    return read.withColumn("error", error).withColumn("document", F.when(F.col("error").isNull(), parsed)).drop("_v")


def read_cases_json(spark: SparkSession, path: str) -> DataFrame:
    """Trigger suites with ``positive`` and ``negative`` arrays, one row per case."""
    suites = spark.read.schema(SUITE_SCHEMA).json(path, multiLine=True)
    sides = [
        suites.select(F.lit(flag).alias("should_trigger"), F.inline(F.col(name))) for name, flag in (("positive", True), ("negative", False))
    ]
    return sides[0].unionByName(sides[1])


def read_cases_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BEHAVIOUR_SCHEMA).json(path)


def read_triggers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted commas, quotes and line breaks."""
    return spark.read.csv(path, schema=TRIGGER_SCHEMA, header=True, multiLine=True, quote='"', escape='"')


def read_checksum_lines(spark: SparkSession, path: str) -> DataFrame:
    """``digest  path`` lines; a line without the two-space separator carries an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    part = F.split("value", "  ", 2)
    good = F.size(part) == 2
    return lines.select(
        F.when(good, part[0]).alias("sha256"), F.when(good, F.get(part, F.lit(1))).alias("path"),
        F.when(~good, F.concat(F.lit("invalid checksum line: "), F.col("value"))).alias("error"),
    )


def scan_files(spark: SparkSession, root: str, glob: str | None = None, largest_row: int = LARGEST_ROW) -> DataFrame:
    """Regular files below ``root``: relative path, byte length and SHA-256, whatever their size.

    Files above ``largest_row`` bytes are read through the Arrow file system of their URI scheme, which executors must be able to reach.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    relative = F.element_at(F.split("path", F.lit("\\Q" + base + "\\E"), 2), -1)
    files = reader.load(root).withColumn("uri", F.regexp_replace("path", "^file:/+", "file:///")).withColumn("path", F.url_decode(F.regexp_replace(relative, r"\+", "%2B"))).where(~F.col("path").rlike(SKIPPED_FILES))
    small = files.where(F.col("length") <= largest_row).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > largest_row).select("path", F.col("length").alias("bytes"), "uri")
    return small.unionByName(large.mapInArrow(_hashed_in_blocks, "path string, bytes bigint, sha256 string"))


def _hashed_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files of any size, one block in memory at a time; a file's digest is sequential by definition."""
    ascii_marks = "!#$%&'()*+,/:;=?@[]~"
    for batch in batches:
        digests = []
        for uri in batch.column("uri").to_pylist():
            digest = hashlib.sha256()
            system, path = FileSystem.from_uri(quote(uri, safe=ascii_marks))  # letters beyond ASCII come unescaped
            with system.open_input_stream(path) as stream:
                while data := stream.read(BLOCK):
                    digest.update(data)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def write_manifest(files: DataFrame, path: str, single_file: bool = False) -> None:
    """Listing sorted by path; one file only when the caller knows it is small."""
    ordered_lines = files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))
    (ordered_lines.coalesce(1) if single_file else ordered_lines).write.mode("errorifexists").text(path)


POINTER = "CURRENT"


def write_report(df: DataFrame, path: str, format: str = "json") -> str:
    """Replace the report at ``path`` by the rows of a frame, atomically; ``read_report`` reads it.  Returns the name of the new version.

    The rows are written as a version of their own.  Only when all of them stand, a pointer file is replaced by one rename, which
    the file system does at once or not at all; versions the pointer has left are deleted after that.  A job that dies on the
    way leaves the former report as it was, and the next one clears away what it wrote.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").format(format).save(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    root = system.makeQualified(root)
    drafted = jvm.org.apache.hadoop.fs.Path(root, f"_{version}.pointer")
    out = system.create(drafted, True)
    out.write(bytearray(f"{format} {version}".encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf).rename(drafted, jvm.org.apache.hadoop.fs.Path(root, POINTER), options)
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name not in (version, POINTER) and (name.startswith("version-") or name.endswith(".pointer")):
            system.delete(status.getPath(), True)
    return version


def read_report(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The report that ``write_report`` published last at ``path``."""
    format, _, version = spark.read.text(f"{path}/{POINTER}", wholetext=True).collect()[0][0].partition(" ")
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(f"{path}/{version}")
