"""Readers and writers exercised on files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions.hashing import sha256
from proofline.plans.integrity import FILES, document_files
from proofline.plans.registry import Registry
from proofline.session import load, scratch_path
from proofline.sources import files as io

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add("s01_read_documents", """
    with g as (select source, count(*) as n, max(doc_id) as last_id from documents group by 1)
    select source, case when last_id % 5 = 0 then 'not an object' when last_id % 5 = 1 then 'not JSON' else '' end as error,
           case when last_id % 5 > 1 then n else -1 end as files from g""")
def s01(spark, d):
    summary = load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.max("doc_id").alias("last_id"))
    good = F.to_json(F.struct(F.lit("package/v1").alias("schema_version"), "source", "files"))
    raw = F.when(F.col("last_id") % 5 == 0, F.concat(F.lit("["), good, F.lit("]"))).when(
        F.col("last_id") % 5 == 1, F.concat(good, F.lit("}"))).otherwise(good)
    path = scratch_path(spark, "documents-json")
    summary.select(F.col("source").alias("package"), raw.alias("value")).repartition("package").write.partitionBy("package").text(path)
    out = io.read_documents(spark, path, "schema_version string, source string, files bigint")
    return out.select(F.regexp_extract("path", "package=([^/]+)/", 1).alias("source"), F.coalesce("error", F.lit("")).alias("error"),
                      F.coalesce("document.files", F.lit(-1)).alias("files"))


@R.add("s02_read_cases_json", """
    select 'c' || doc_id as id, n_chars > 400 as should_trigger, source as prompt, lang as reason from documents""")
def s02(spark, d):
    docs = load(spark, d, "documents").select(
        (F.col("n_chars") > 400).alias("hit"), F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("prompt"), F.col("lang").alias("reason")).alias("c"),
        F.expr("div(doc_id, 64)").alias("suite"))
    # one suite document per 64 cases, so its arrays are bounded
    suites = docs.groupBy("suite").agg(F.collect_list(F.when(F.col("hit"), F.col("c"))).alias("positive"), F.collect_list(F.when(~F.col("hit"), F.col("c"))).alias("negative"))
    path = scratch_path(spark, "suites")
    suites.select("suite", F.to_json(F.struct("positive", "negative"), {"pretty": "true"}).alias("value")).write.partitionBy("suite").text(path)
    return io.read_cases_json(spark, f"{path}/*/")


@R.add("s03_read_cases_jsonl", """
    select conv_id || '-' || turn as id, cast(turn as integer) as track_id, text as prompt, role || ';is "quoted"' as must, '' as must_not from conversations""")
def s03(spark, d):
    path = scratch_path(spark, "cases-jsonl")
    load(spark, d, "conversations").select(
        F.expr("concat(conv_id, '-', turn)").alias("id"), F.col("turn").alias("track_id"), F.lit("t").alias("track"), F.col("text").alias("prompt"), F.lit("fast").alias("mode"),
        F.array(F.col("role"), F.lit('is "quoted"')).alias("must"), F.array().cast("array<string>").alias("must_not"), F.lit(None).cast("string").alias("observable"),
    ).write.json(path)
    return io.read_cases_jsonl(spark, path).select("id", "track_id", "prompt", F.array_join("must", ";").alias("must"), F.array_join("must_not", ";").alias("must_not"))


@R.add("s04_read_triggers_csv", """
    select 'TR-' || doc_id as id, doc_id % 3 <> 0 as should_trigger, sha256(trim('a ' || text || ', "b"')) as prompt_sha256, 'because, ' || lang as reason from documents""")
def s04(spark, d):
    path = scratch_path(spark, "triggers-csv")
    load(spark, d, "documents").select(
        F.concat(F.lit("TR-"), F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") % 3 != 0).alias("should_trigger"),
        F.concat(F.lit("a "), F.col("text"), F.lit(', "b"')).alias("prompt"), F.concat(F.lit("because, "), F.col("lang")).alias("reason"),
    ).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    out = io.read_triggers_csv(spark, path)
    return out.select("id", "should_trigger", sha256(F.col("prompt")).alias("prompt_sha256"), "reason")


@R.add("s05_read_checksum_lines", FILES + """
    select case when doc_id % 10 = 0 then '' else sha256 end as sha256, case when doc_id % 10 = 0 then '' else source || '/' || path end as path,
           case when doc_id % 10 = 0 then 'invalid checksum line: ' || sha256 || ' ' || path else '' end as error from f""")
def s05(spark, d):
    path = scratch_path(spark, "sums")
    good = F.concat_ws("  ", "sha256", F.concat_ws("/", "source", "path"))
    document_files(spark, d).select(F.when(F.col("doc_id") % 10 == 0, F.concat_ws(" ", "sha256", "path")).otherwise(good).alias("value")).write.text(path)
    return io.read_checksum_lines(spark, path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("sha256", "path", "error")])


@R.add("s06_scan_files", """
    with g as (select lang, cast(doc_id % 20 as varchar) as part, min(text) as text from documents group by 1, 2)
    select 'lang=' || lang || '/part=' || part as folder, octet_length(encode(text)) + 1 as bytes, sha256(text || chr(10)) as sha256 from g""")
def s06(spark, d):
    path = scratch_path(spark, "tree")
    rows = load(spark, d, "documents").groupBy("lang", (F.col("doc_id") % 20).alias("part")).agg(F.min("text").alias("value"))
    rows.repartition("lang", "part").write.partitionBy("lang", "part").text(path)
    out = io.scan_files(spark, path, "*.txt")
    return out.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), "bytes", "sha256")


@R.add("s06_scan_files_all", """
    with t as (select doc_id, doc_id // 64 as part, coalesce(text, '') || chr(10) as line from documents),
    g as (select part, cast(sum(octet_length(encode(line))) as bigint) as bytes, sha256(string_agg(line, '' order by doc_id, line)) as sha256 from t group by 1)
    select 'part=' || part as folder, bytes, sha256 from g""")
def s06_all(spark, d):
    path = scratch_path(spark, "tree")
    rows = load(spark, d, "documents").select(F.expr("doc_id div 64").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    lines = rows.repartition("part").sortWithinPartitions("part", "doc_id", "value").select("part", "value")  # a part is one file, in this order
    lines.write.partitionBy("part").text(path)
    out = io.scan_files(spark, path, "*.txt")
    return out.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), "bytes", "sha256")


@R.add("s07_write_manifest", FILES + "select sha256, source || '/' || path as path from f")
def s07(spark, d):
    path = scratch_path(spark, "manifest")
    io.write_manifest(document_files(spark, d).select("sha256", F.concat_ws("/", "source", "path").alias("path")), path)
    return io.read_checksum_lines(spark, path).where("error is null").select("sha256", "path")


@R.add("s08_write_report", """
    select lang, count(*) as files, cast(sum(n_chars) as bigint) as chars from documents group by 1""")
def s08(spark, d):
    path = scratch_path(spark, "report")
    report = load(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))
    io.write_report(report, path)
    io.write_report(report, path)
    return io.read_report(spark, path, "lang string, files bigint, chars bigint")
