"""Text and markup audits over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import textaudit as ops
from proofline.plans.registry import Registry
from proofline.session import load, spread

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add("e01_front_matter", """
    select doc_id, doc_id % 3 <> 0 as has_front, case when doc_id % 3 = 0 then '' when doc_id % 4 = 0 then 'second' else 'doc-' || doc_id end as name,
           case when doc_id % 3 = 0 then '' else lang || ': x' end as lang, case when doc_id % 3 = 0 then 0 else 2 end as keys from documents""")
def e01(spark, d):
    front = F.concat(F.lit('---\nname: "doc-'), F.col("doc_id").cast("string"), F.lit('"\nplain line\n lang : '), F.col("lang"), F.lit(": x\n"),
                     F.expr("if(doc_id % 4 = 0, \"name: 'second'\\n\", '')"), F.lit("---\n"))
    docs = spread(load(spark, d, "documents")).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 != 0, front).otherwise(""), F.col("text")).alias("text"))
    out = ops.front_matter(docs, "text")

    def value(key):
        return F.coalesce(F.try_element_at("front", F.lit(key)), F.lit(""))

    return out.select("doc_id", F.col("front").isNotNull().alias("has_front"), value("name").alias("name"), value("lang").alias("lang"),
                      F.coalesce(F.cardinality("front"), F.lit(0)).alias("keys"))


@R.add("e02_required_terms", """
    select doc_id, array_to_string(list_filter(['The', 'de', 'UND', 'été', 'con', 'license'], lambda t: not contains(lower(text), lower(t))), ',') as missing_terms
    from documents""")
def e02(spark, d):
    out = ops.required_terms(spread(load(spark, d, "documents")), "text", ["The", "de", "UND", "été", "con", "license"])
    return out.select("doc_id", F.array_join("missing_terms", ",").alias("missing_terms"))


@R.add("e03_word_budget", r"""
    select doc_id, len(regexp_extract_all(text, '[–—''-]*[\p{L}\p{N}_][\p{L}\p{N}_–—''-]*')) as words,
           len(regexp_extract_all(text, '[–—''-]*[\p{L}\p{N}_][\p{L}\p{N}_–—''-]*')) > 300 as over_budget, length(text) < 120 as vague from documents""")
def e03(spark, d):
    out = ops.word_budget(spread(load(spark, d, "documents")), "text", "text", 300)
    return out.select("doc_id", "words", "over_budget", "vague")


@R.add("e04_heading_levels", """
    select doc_id, '1' || repeat(',2', doc_id % 4) || ',3' || case when doc_id % 5 = 0 then ',6' else '' end as levels from documents""")
def e04(spark, d):
    text = F.concat(F.lit("\ufeff# T\r\n\n"), F.expr("repeat('## S\\n', cast(doc_id % 4 as int))"), F.lit("####### no\n#tag\n \t### x\n#\n"),
                    F.expr("if(doc_id % 5 = 0, '######\\tlast\\n', '')"), F.regexp_replace("text", "(?m)^\\s*#", "="))
    out = ops.heading_levels(spread(load(spark, d, "documents")).select("doc_id", text.alias("text")), "text")
    return out.select("doc_id", F.array_join("levels", ",").alias("levels"))


@R.add("e04_html_heading_levels", r"""
    select page_id, array_to_string(regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1), ',') as levels from pages""")
def e04_html(spark, d):
    return ops.html_heading_levels(spread(load(spark, d, "pages")), "html").select("page_id", F.array_join("levels", ",").alias("levels"))


@R.add("e05_parallel_structure", r"""
    with h as (select page_id, array_to_string(regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1), ',') as l from pages)
    select a.page_id // 2 as pair, a.l <> '' and a.l = b.l as parallel from h a join h b on b.page_id = a.page_id + 1 where a.page_id % 2 = 0""")
def e05(spark, d):
    levels = ops.html_heading_levels(spread(load(spark, d, "pages")), "html").withColumn("pair", F.expr("div(page_id, 2)"))
    return ops.parallel_structure(levels.where("page_id % 2 = 0"), levels.where("page_id % 2 = 1"), ["pair"])


@R.add("e06_parse_records_md", """
    select o_orderkey, cast(o_orderkey % 10000 as integer) as iteration, coalesce(cast(case when o_orderkey % 3 <> 0 then o_custkey % 100 end as integer), -1) as track_id,
           case when o_orderkey % 3 <> 0 then o_orderpriority else '' end as track, case when o_orderkey % 3 = 0 then o_orderstatus else '' end as category,
           'A ' || o_custkey || ': b' as defect, sha256(cast(o_orderkey as varchar)) as chain_hash, 'K1, K' || o_custkey as evidence_keys from orders""")
def e06(spark, d):
    orders = spread(load(spark, d, "orders"))
    head = F.format_string("# Iteration %04d — New\n\n", F.col("o_orderkey") % 10000)
    track = F.format_string("- **Track %02d:** %s\n- **Pass 01:** p\n", F.col("o_custkey") % 100, "o_orderpriority")
    text = F.concat(head, F.when(F.col("o_orderkey") % 3 != 0, track).otherwise(F.concat(F.lit("- **Category:** "), F.col("o_orderstatus"), F.lit("\n"))),
                    F.format_string("- **Defect:** A %d: b\n- **Evidence keys:** K1, K%d\n", "o_custkey", "o_custkey"),
                    F.format_string("- **Chain hash:** `%s`\n\nThis is one cell.\n", F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)))
    out = ops.parse_records_md(orders.select("o_orderkey", text.alias("text")), "text")
    return out.select("o_orderkey", "iteration", F.coalesce("track_id", F.lit(-1)).alias("track_id"),
                      *[F.coalesce(c, F.lit("")).alias(c) for c in ("track", "category", "defect", "chain_hash", "evidence_keys")])


MARKUP = """case when page_id % 4 = 0 then '<svg width="9" onLoad="x()"><a xlink:href="#in"/><image href="http://e.x/a.png"/></svg>'
                 when page_id % 4 = 1 then '<svg viewBox="0 0 9 9"><svg:foreignObject/><image src="data:image/png;base64,AA"/></svg>' else '' end"""


@R.add("e07_markup_safety", r"""
    with m as (select page_id, html || """ + MARKUP + r""" as h from pages),
    r as (select *, regexp_extract_all(h, '(?i)[\s:](?:href|src)\s*=\s*["'']([^"'']+)["'']', 1) as refs from m)
    select page_id, len(regexp_extract_all(h, '<(?:[A-Za-z_][\w.-]*:)?(?:script|foreignObject)\b')) as active_elements,
           len(regexp_extract_all(h, '(?i)<[A-Za-z][^<>]*\s(?:[\w.-]+:)?on\w+\s*=')) as event_attributes,
           len(list_filter(refs, lambda u: not starts_with(u, '#') and not starts_with(u, 'data:'))) as external_references,
           page_id % 4 = 0 as no_view_box,
           len(regexp_extract_all(h, '<(?:[A-Za-z_][\w.-]*:)?(?:script|foreignObject)\b')) = 0
             and len(regexp_extract_all(h, '(?i)<[A-Za-z][^<>]*\s(?:[\w.-]+:)?on\w+\s*=')) = 0
             and len(list_filter(refs, lambda u: not starts_with(u, '#') and not starts_with(u, 'data:'))) = 0 as self_contained from r""")
def e07(spark, d):
    pages = spread(load(spark, d, "pages")).select("page_id", F.concat("html", F.expr(MARKUP)).alias("html"))
    return ops.markup_safety(pages, "html").drop("html")


@R.add("e08_signature_audit", """
    select doc_id, case doc_id % 7 when 0 then 'ok' when 1 then 'ok' when 2 then 'ok' when 3 then 'signature mismatch' when 4 then 'unsupported type'
                                   when 5 then 'empty' else 'ok' end as signature_status from documents""")
def e08(spark, d):
    suffix = F.expr("element_at(array('.png', '.JPG', '.webp', '.png', '.gif', '.svg', '.jpeg'), cast(doc_id % 7 as int) + 1)")
    head = F.expr("""unhex(element_at(array('89504E470D0A1A0A', 'FFD8FF', '524946460011223357454250', 'FFD8', '47494638', '', 'FFD8'), cast(doc_id % 7 as int) + 1))""")
    content = F.when(F.col("doc_id") % 7 == 5, F.expr("x''")).otherwise(F.concat(head, F.encode("text", "utf-8")))
    files = spread(load(spark, d, "documents")).select("doc_id", F.concat(F.lit("icons/i"), F.col("doc_id").cast("string"), suffix).alias("path"), content.alias("content"))
    return ops.signature_audit(files, "path", "content").select("doc_id", "signature_status")


PROMPT = """text || case when {id} % 5 = 0 then ' For [Target audience] and [Budget range]. See [site](http://x).' else '' end
                 || case when {id} % 3 = 0 then ' Who? When?' else '' end"""


@R.add("e09_placeholder_audit", r"""
    with p as (select doc_id as id, 'documents' as place, """ + PROMPT.format(id="doc_id") + r""" as t from documents
               union all select conv_id * 1000 + turn, 'conversations', """ + PROMPT.format(id="conv_id") + r""" from conversations),
    c as (select place, id, len(regexp_extract_all(t, '\[[A-Za-z][^\[\]\n]*\]')) - len(regexp_extract_all(t, '\[[A-Za-z][^\[\]\n]*\]\(')) as placeholders,
                 len(regexp_extract_all(t, '\?')) as questions from p)
    select *, case when placeholders > 0 then 'provisional' else 'copy-ready' end as state,
           case when placeholders > 0 then questions between 1 and 3 else questions = 0 end as questions_fit from c""")
def e09(spark, d):
    docs = spread(load(spark, d, "documents")).select(F.lit("documents").alias("place"), F.col("doc_id").alias("id"), F.expr(PROMPT.format(id="doc_id")).alias("t"))
    turns = spread(load(spark, d, "conversations")).select(
        F.lit("conversations").alias("place"), F.expr("conv_id * 1000 + turn").alias("id"), F.expr(PROMPT.format(id="conv_id")).alias("t"))
    return ops.placeholder_audit(docs.union(turns), "t").drop("t")


LABELS = """case (conv_id + turn) % 6 when 0 then '[Verified 2024-0' || (turn % 9 + 1) || '-05 10:30 UTC] ' when 1 then '[Existing evidence, not reverified this turn] '
            when 2 then '[Inference] ' when 3 then '[Unknown] ' when 4 then '[Unknown] [Inference] ' else '' end || text"""


@R.add("e10_provenance_labels", """
    select conv_id, count(*) as claims, count(*) filter (k = 0) as verified, count(*) filter (k = 1) as existing, count(*) filter (k = 2) as inference,
           count(*) filter (k = 3) as unknown, count(*) filter (k > 3) as badly_labelled, count(*) filter (k = 0 and turn < 3) as stale
    from (select conv_id, turn, (conv_id + turn) % 6 as k from conversations) group by 1""")
def e10(spark, d):
    claims = spread(load(spark, d, "conversations")).select("conv_id", F.expr(LABELS).alias("claim"))
    return ops.provenance_labels(claims, "conv_id", "claim", "2024-04-01 00:00")


def sensitive_sql(expression: str) -> str:
    counts = []
    for name, pattern in ops.SENSITIVE.items():
        escaped = pattern.replace("'", "''")
        counts.append(f"len(regexp_extract_all({expression}, '{escaped}')) as hits_{name.replace('-', '_')}")
    return ", ".join(counts)


PLANTED = """text || case when doc_id % 50 = 1 then ' Cookie: sid=abc; Authorization: Basic Zm9v https://e.x/v.mp4?sig=1&x=2 ghp_abcdefghij0123456789' else '' end"""


@R.add("e11_sensitive_scan", f"""
    with p as (select doc_id, {PLANTED} as t from documents), c as (select doc_id, {sensitive_sql('t')} from p)
    select *, hits_cookie + hits_authorization + hits_account + hits_signed_url + hits_credential as hits from c""")
def e11(spark, d):
    docs = spread(load(spark, d, "documents")).select("doc_id", F.expr(PLANTED).alias("t"))
    return ops.sensitive_scan(docs, "t").drop("t")


def redacted_sql(expression: str) -> str:
    for pattern in ops.SENSITIVE.values():
        escaped = pattern.replace("'", "''")
        expression = f"regexp_replace({expression}, '{escaped}', '[redacted]', 'g')"
    return expression


@R.add("e11_redact", f"select doc_id, sha256({redacted_sql('(' + PLANTED + ')')}) as redacted_sha256 from documents")
def e11_redact(spark, d):
    docs = spread(load(spark, d, "documents")).select("doc_id", F.expr(PLANTED).alias("t"))
    return ops.redact(docs, "t").select("doc_id", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


@R.add("e12_inaudible_markers", """
    select doc_id, case when doc_id % 4 = 0 then cast(doc_id % 60 as varchar) || ',' || (3600 + doc_id % 60) else '' end as marker_seconds,
           cast(case when doc_id % 4 = 0 then 2 else 0 end as bigint) as markers from documents""")
def e12(spark, d):
    mark = F.when(F.col("doc_id") % 4 == 0, F.format_string("[inaudible 00:00:%02d] ", F.col("doc_id") % 60)).otherwise("")
    later = F.when(F.col("doc_id") % 4 == 0, F.format_string(" [inaudible 01:00:%02d]", F.col("doc_id") % 60)).otherwise(" [inaudible 1:00]")
    out = ops.inaudible_markers(spread(load(spark, d, "documents")).select("doc_id", F.concat(mark, "text", later).alias("text")), "text")
    return out.select("doc_id", F.array_join("marker_seconds", ",").alias("marker_seconds"), "markers")


@R.add("e13_repeat_collapse_candidates", """
    with l as (select doc_id, string_split(text, chr(10)) as p from documents),
    c as (select doc_id, unnest(range(len(p))) as line, unnest(p) as t from l),
    n as (select *, lag(sha256(t)) over (partition by doc_id order by line) as b from c),
    r as (select *, sum(case when b = sha256(t) then 0 else 1 end) over (partition by doc_id order by line) as run from n)
    select doc_id, cast(run as bigint) as run, min(line) as first_cue, max(line) as last_cue, count(*) as cues, cast(sum(length(t)) as bigint) as chars,
           cast(sum(400 + line % 5 * 300) as bigint) as span_ms, sum(length(t)) * 1000.0 > sum(400 + line % 5 * 300) * 30 as cannot_fit
    from r group by 1, 2 having count(*) > 1""")
def e13(spark, d):
    rows = spread(load(spark, d, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    cues = rows.select("doc_id", F.col("line").cast("bigint").alias("line"), "t", (F.lit(400) + F.col("line") % 5 * 300).cast("bigint").alias("ms"))
    return ops.repeat_collapse_candidates(cues, ["doc_id"], "line", "t", "ms", 30.0)
