"""Integrity, ledger and contract audits over the given tables with planted deviations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.hashing import (
    ZERO_HASH, canonical_json, canonical_json_floats, canonical_sha256, sha256,
)
from proofline.operators import contracts, integrity as ops, ledger
from proofline.plans.registry import Registry
from proofline.session import load, spread

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add("b01_canonical_sha256", """
    select c_custkey, j as canonical, sha256(j) as sha256 from (
      select c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
             || '","c_nationkey":' || c_nationkey || ',"note":null}' as j from customer)""")
def b01(spark, d):
    cols = {c: F.col(c) for c in ("c_name", "c_custkey", "c_nationkey", "c_mktsegment")}
    cols["note"] = F.lit(None).cast("string")
    return load(spark, d, "customer").select(
        "c_custkey", canonical_json(cols).alias("canonical"), canonical_sha256(cols).alias("sha256")
    )


@R.add("b01_canonical_floats", """
    select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_totalprice":' || o_totalprice || '}' as canonical
    from orders""")
def b01_floats(spark, d):
    cols = {c: F.col(c) for c in ("o_totalprice", "o_orderkey")}
    return spread(load(spark, d, "orders")).select(
        "o_orderkey", canonical_json_floats(cols, {"o_totalprice"}).alias("canonical")
    )


def document_files(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select(
        "source", "lang", "doc_id", F.format_string("%s/doc-%09d.txt", "lang", "doc_id").alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"), sha256(F.col("text")).alias("sha256"),
    )


FILES = """
    with f as (select source, lang, doc_id, lang || '/doc-' || lpad(cast(doc_id as varchar), 9, '0') || '.txt' as path,
                      octet_length(encode(text)) as bytes, sha256(text) as sha256 from documents)"""


@R.add("b02_tree_digest", FILES + """
    select source, count(*) as files,
           sha256(from_hex(string_agg(lpad(hex(octet_length(encode(path))), 8, '0') || hex(encode(path)) || upper(sha256),
                                      '' order by path))) as tree_sha256
    from f group by source""")
def b02(spark, d):
    return ops.tree_digest(document_files(spark, d), "source")


@R.add("b03_manifest_diff", FILES + """
    select source, path, case when doc_id % 97 = 0 then 'missing' when doc_id % 101 = 0 then 'unexpected'
                              when doc_id % 103 = 0 then 'mismatch' else 'match' end as status from f""")
def b03(spark, d):
    files = document_files(spark, d)
    declared = files.where("doc_id % 101 <> 0 or doc_id % 97 = 0").withColumn(
        "sha256", F.when(F.col("doc_id") % 103 == 0, F.lit(ZERO_HASH)).otherwise(F.col("sha256"))
    )
    return ops.manifest_diff(declared, files.where("doc_id % 97 <> 0"), ["source", "path"], ["sha256", "bytes"])


@R.add("b04_unique_key_audit", """
    select 'documents' as place, sha256(text) as key, count(*) as copies from documents group by 2 having count(*) > 1
    union all
    select 'lineitem', l_orderkey || '/' || l_linenumber, count(*) from lineitem group by 2 having count(*) > 1""")
def b04(spark, d):
    docs = ops.unique_key_audit(load(spark, d, "documents").select(sha256(F.col("text")).alias("key")), ["key"])
    lines = ops.unique_key_audit(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return docs.select(F.lit("documents").alias("place"), "key", "copies").union(
        lines.select(F.lit("lineitem"), F.concat_ws("/", "l_orderkey", "l_linenumber"), "copies")
    )


@R.add("b05_reference_audit", """
    select 'labels' as place, doc_id as reference, count(*) as n from labels
    where doc_id not in (select doc_id from documents where lang <> 'fr') group by all
    union all
    select 'lineitem', l_orderkey, count(*) from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderpriority <> '1-URGENT') group by all""")
def b05(spark, d):
    labels = ops.reference_audit(load(spark, d, "labels"), load(spark, d, "documents").where("lang <> 'fr'"), ["doc_id"])
    orders = load(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").withColumnRenamed("o_orderkey", "l_orderkey")
    lines = ops.reference_audit(load(spark, d, "lineitem"), orders, ["l_orderkey"])
    both = labels.select(F.lit("labels").alias("place"), F.col("doc_id").alias("reference")).union(
        lines.select(F.lit("lineitem"), "l_orderkey"))
    return both.groupBy("place", "reference").agg(F.count(F.lit(1)).alias("n"))


@R.add("b06_orphan_audit", """
    select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def b06(spark, d):
    refs = load(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return ops.orphan_audit(load(spark, d, "customer"), refs, ["c_custkey"]).select("c_custkey")


@R.add("b06_orphan_audit_all", """
    select c_custkey from (select c_custkey from customer union all select -1 - n_nationkey from nation)
    where c_custkey not in (select o_custkey from orders where o_custkey is not null)""")
def b06_all(spark, d):
    # every given customer of the small tables has orders, so a few without are added
    more = load(spark, d, "nation").select((-1 - F.col("n_nationkey")).alias("c_custkey"))
    customers = load(spark, d, "customer").select("c_custkey").union(more)
    return ops.orphan_audit(customers, load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@R.add("b07_exact_coverage", """
    with e as (select source, doc_id from documents where doc_id % 10 <> 9 or source = 'src3'),
    a as (select source, doc_id from documents where source in ('src3', 'src4') or doc_id in (select doc_id from labels)),
    g as (select coalesce(e.source, a.source) as source, count(e.doc_id) as expected,
                 count(*) filter (a.doc_id is null) as missing, count(*) filter (e.doc_id is null) as unexpected
          from e full join a on e.source = a.source and e.doc_id = a.doc_id group by 1)
    select *, cast(0 as bigint) as duplicated, missing + unexpected = 0 as exact from g""")
def b07(spark, d):
    docs = load(spark, d, "documents").select("source", "doc_id")
    labels = load(spark, d, "labels").select("doc_id")
    whole = docs.where("source in ('src3', 'src4')")
    actual = whole.union(docs.where("source not in ('src3', 'src4')").join(labels, "doc_id", "left_semi").select("source", "doc_id"))
    return ops.exact_coverage(docs.where("doc_id % 10 <> 9 or source = 'src3'"), actual, ["source"], "doc_id")


ORDER_FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@R.add("b08_binding_audit", """
    select o_orderkey, case when o_orderkey % 19 = 0 then 'missing' when o_orderkey % 17 = 0 and o_orderstatus <> 'X'
                            then 'stale' else 'current' end as status from orders""")
def b08(spark, d):
    orders = load(spark, d, "orders")
    old = F.when(F.col("o_orderkey") % 17 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    fields = {c: F.col(c) for c in ORDER_FIELDS}
    bindings = orders.select("o_orderkey", canonical_sha256({**fields, "o_orderstatus": old}).alias("bound"))
    targets = orders.where("o_orderkey % 19 <> 0").select("o_orderkey", canonical_sha256(fields).alias("now"))
    return ops.binding_audit(bindings, targets, ["o_orderkey"], "bound", "now").select("o_orderkey", "status")


def record_text(iteration, payload, previous):
    """Canonical record text: iteration, payload hash and previous hash."""
    return canonical_json({"iteration": iteration, "payload_sha256": payload, "previous_hash": previous})


def conversation_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A hash chain over every conversation, written by a streamed fold in turn order."""
    turns = load(spark, d, "conversations").select(
        F.col("conv_id").alias("ledger"), (F.col("turn") + 1).alias("iteration"), "role",
        sha256(F.col("text")).alias("payload_sha256"),
    )
    rows = turns.repartition("ledger").sortWithinPartitions("ledger", "iteration")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, ZERO_HASH
        for batch in batches:
            previous, chain = [], []
            for name, i, payload in zip(*(batch.column(c).to_pylist() for c in ("ledger", "iteration", "payload_sha256"))):
                if name != current:
                    current, last = name, ZERO_HASH
                previous.append(last)
                text = f'{{"iteration":{i},"payload_sha256":"{payload}","previous_hash":"{last}"}}'
                last = hashlib.sha256(text.encode()).hexdigest()
                chain.append(last)
            table = batch.append_column("previous_hash", pa.array(previous, pa.string()))
            yield table.append_column("chain_hash", pa.array(chain, pa.string()))

    schema = "ledger bigint, iteration bigint, role string, payload_sha256 string, previous_hash string, chain_hash string"
    return rows.mapInArrow(fold, schema)


CHAIN = """
    with recursive t as (select conv_id as ledger, turn + 1 as iteration, role, sha256(text) as payload from conversations),
    c as (
      select ledger, iteration, role, payload, repeat('0', 64) as previous,
             sha256('{"iteration":1,"payload_sha256":"' || payload || '","previous_hash":"' || repeat('0', 64) || '"}') as chain
      from t where iteration = 1
      union all
      select t.ledger, t.iteration, t.role, t.payload, c.chain,
             sha256('{"iteration":' || t.iteration || ',"payload_sha256":"' || t.payload || '","previous_hash":"' || c.chain || '"}')
      from t join c on t.ledger = c.ledger and t.iteration = c.iteration + 1)"""


@R.add("b09_chain_audit", CHAIN + """,
    p as (select ledger, iteration, chain,
                 case when ledger % 10 = 3 and iteration = 2 then 'changed' else payload end as payload,
                 case when ledger % 10 = 5 and iteration = 3 then 'lost' else previous end as previous
          from c where not (ledger % 10 = 7 and iteration = 2)),
    e as (select ledger, max(iteration) as iteration, max_by(chain, iteration) as final from p group by 1)
    select ledger, iteration, 'order' as code from p where ledger % 10 = 7 and iteration = 3
    union all select ledger, iteration, 'previous-hash' from p where previous = 'lost'
    union all select ledger, iteration, 'chain-hash' from p where previous = 'lost' or payload = 'changed'
    union all select ledger, iteration, 'final-hash' from e where ledger % 10 = 1""")
def b09(spark, d):
    # the twin leaves out the final hashes of ledgers that may be cut after their first record
    bad, again, finals = planted_ledger(spark, d)
    return ledger.chain_audit(bad, again, finals.where("ledger % 10 <> 7")).select("ledger", "iteration", "code")


@R.add("b09_chain_audit_all", CHAIN + """,
    p as (select ledger, iteration, chain,
                 case when ledger % 10 = 3 and iteration = 2 then 'changed' else payload end as payload,
                 case when ledger % 10 = 5 and iteration = 3 then 'lost' else previous end as previous
          from c where not (ledger % 10 = 7 and iteration = 2)),
    e as (select ledger, max(iteration) as iteration, max_by(chain, iteration) as final from p group by 1),
    f as (select ledger, case when ledger % 10 = 1 then repeat('0', 64) else max_by(chain, iteration) end as final from c group by 1)
    select ledger, iteration, 'order' as code from p where ledger % 10 = 7 and iteration = 3
    union all select ledger, iteration, 'previous-hash' from p where previous = 'lost'
    union all select ledger, iteration, 'chain-hash' from p where previous = 'lost' or payload = 'changed'
    union all select e.ledger, e.iteration, 'final-hash' from e join f on e.ledger = f.ledger where e.final <> f.final""")
def b09_all(spark, d):
    return ledger.chain_audit(*planted_ledger(spark, d)).select("ledger", "iteration", "code")


def planted_ledger(spark: SparkSession, d: str) -> tuple[DataFrame, Column, DataFrame]:
    """Records with planted faults, their hashes computed again, and the final hashes before the faults; one in ten of these is wrong."""
    clean = conversation_ledger(spark, d)
    finals = clean.groupBy("ledger").agg(F.max_by("chain_hash", "iteration").alias("final_chain_hash")).withColumn(
        "final_chain_hash", F.when(F.col("ledger") % 10 == 1, F.lit(ZERO_HASH)).otherwise(F.col("final_chain_hash")))
    bad = clean.where("not (ledger % 10 = 7 and iteration = 2)")
    bad = bad.withColumn("payload_sha256", F.expr("if(ledger % 10 = 3 and iteration = 2, 'changed', payload_sha256)"))
    bad = bad.withColumn("previous_hash", F.expr("if(ledger % 10 = 5 and iteration = 3, 'lost', previous_hash)"))
    again = sha256(record_text(F.col("iteration"), F.col("payload_sha256"), F.col("previous_hash")))
    return bad, again, finals


@R.add("b10_preserved_prefix", """
    with n as (select conv_id as ledger, count(*) as n from conversations group by 1)
    select ledger, least(n, 2) as base_count, ledger % 6 <> 2 as prefix_equal,
           case when n <= 2 then 'no-next-record' when ledger % 8 = 4 then 'broken' else 'continues' end as continuation
    from n""")
def b10(spark, d):
    clean = conversation_ledger(spark, d)
    base = clean.where("iteration <= 2").withColumn("role", F.expr("if(ledger % 6 = 2 and iteration = 1, 'x', role)"))
    now = clean.withColumn("previous_hash", F.expr("if(ledger % 8 = 4 and iteration = 3, 'lost', previous_hash)"))
    return ledger.preserved_prefix(now, base)


@R.add("b11_grid_coverage", """
    with c as (select cast(replace(p_brand, 'Brand#', '') as bigint) as brand_id, cast(p_size as bigint) as size_id, count(*) as n
               from part group by all),
    g as (select a.i as brand_id, b.i as size_id from range(1, 21) a(i), range(1, 51) b(i))
    select coalesce(g.brand_id, c.brand_id) as brand_id, coalesce(g.size_id, c.size_id) as size_id, coalesce(n, 0) as copies,
           case when n is null then 'missing' when g.brand_id is null then 'outside' when n > 1 then 'repeated' else 'once' end as status
    from g full join c on g.brand_id = c.brand_id and g.size_id = c.size_id""")
def b11(spark, d):
    cells = load(spark, d, "part").select(
        F.expr("cast(replace(p_brand, 'Brand#', '') as bigint)").alias("brand_id"), F.col("p_size").alias("size_id"))
    return ledger.grid_coverage(cells, "brand_id", "size_id", 20, 50)


@R.add("b11_coordinate_audit", """
    select o_orderkey, o_orderkey // 32 + 1 as expected_a, o_orderkey % 32 + 1 as expected_b from orders
    where o_orderkey % 29 = 0""")
def b11_coordinates(spark, d):
    cells = load(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") + 1).alias("n"), F.expr("div(o_orderkey, 32) + 1").alias("track_id"),
        F.expr("o_orderkey % 32 + if(o_orderkey % 29 = 0, 2, 1)").alias("pass_id"))
    return ledger.coordinate_audit(cells, "n", "track_id", "pass_id", 32).select("o_orderkey", "expected_a", "expected_b")


@R.add("b12_dimension_agreement", """
    select l_orderkey, l_linenumber, l_partkey,
           concat_ws(',', case when l_orderkey % 50 = 0 then 'claimed_brand' end,
                          case when l_suppkey % 40 = 0 then 'claimed_type' end) as disagreeing
    from lineitem where l_orderkey % 50 = 0 or l_suppkey % 40 = 0""")
def b12(spark, d):
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    fact = load(spark, d, "lineitem").join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.expr("if(l_orderkey % 50 = 0, 'none', p_brand)").alias("claimed_brand"),
        F.expr("if(l_suppkey % 40 = 0, null, p_type)").alias("claimed_type"))
    found = ops.dimension_agreement(fact, parts, ["l_partkey"], {"claimed_brand": "p_brand", "claimed_type": "p_type"})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("disagreeing", ",").alias("disagreeing"))


@R.add("b13_contiguous_sequence", """
    with t as (select conv_id as key, 'turn' as kind, turn as i, 0 as base from conversations
                 where not (conv_id % 9 = 4 and turn = 1)
               union all select l_orderkey, 'line', l_linenumber, 1 from lineitem),
    g as (select kind, key, base, count(*) as "rows", count(distinct i) as u, min(i) as lo, max(i) as hi from t group by all)
    select kind, key, "rows", "rows" - u as repeated, greatest(hi + 1 - base, 0) - u as holes,
           lo = base and hi = base + u - 1 and u = "rows" as contiguous from g""")
def b13(spark, d):
    turns = ops.contiguous_sequence(
        load(spark, d, "conversations").where("not (conv_id % 9 = 4 and turn = 1)"), ["conv_id"], "turn", 0)
    lines = ops.contiguous_sequence(load(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 1)
    return turns.withColumnRenamed("conv_id", "key").withColumn("kind", F.lit("turn")).unionByName(
        lines.withColumnRenamed("l_orderkey", "key").withColumn("kind", F.lit("line")))


EVENT_JSON = """case when event_id % 7 = 0 then '{"k": 1, "z": 2, "a": null}' when event_id % 11 = 0 then '[1, 2]'
                     when event_id % 13 = 0 then '{"v": 3}' else props end"""


@R.add("b14_closed_keys", """
    select event_id, (event_id % 7 = 0 or event_id % 11 <> 0) and event_id % 17 <> 0 as is_object,
           case when event_id % 17 <> 0 and event_id % 7 = 0 then 'a,z' else '' end as unknown_keys,
           case when event_id % 17 = 0 then 'k,v' when event_id % 7 = 0 then 'v' when event_id % 11 = 0 then 'k,v' when event_id % 13 = 0 then 'k' else 'v' end as missing_keys
    from events""")
def b14(spark, d):
    raw = F.concat(F.expr(EVENT_JSON), F.expr("if(event_id % 17 = 0, ' junk', '')"))
    docs = load(spark, d, "events").select("event_id", raw.alias("raw"))
    out = contracts.closed_keys(docs, "raw", ["k", "v"], ["k", "v"])
    return out.select("event_id", "is_object", *[
        F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("unknown_keys", "missing_keys")])


@R.add("b15_required_paths", """
    select event_id, concat_ws(',', case when event_id % 7 <> 0 and (event_id % 11 = 0 or event_id % 13 = 0) then 'k' end,
        case when event_id % 7 = 0 or event_id % 11 = 0 or event_id % 13 <> 0 then 'v' end, 'a') as missing from events""")
def b15_paths(spark, d):
    docs = load(spark, d, "events").select("event_id", F.expr(EVENT_JSON).alias("raw"))
    return contracts.required_paths(docs, "raw", ["k", "v", "a"]).select(
        "event_id", F.array_join("missing", ",").alias("missing"))


@R.add("b15_manifest_gaps", """
    select doc_id, concat_ws(',',
      case when doc_id % 5 = 0 then 'decision_mode' end,
      case when doc_id % 7 = 0 then 'transitions' end,
      case when doc_id % 11 = 0 then 'access.probe_attempts' end,
      case when doc_id % 13 = 0 or doc_id % 17 = 0 then 'source.duration_seconds' end,
      case when (doc_id % 3 = 0) = (doc_id % 4 = 0) then 'source_branch' end,
      case when doc_id % 2 = 0 then 'source.title' end,
      case when doc_id % 17 = 0 then 'source.duration_seconds' end,
      case when doc_id % 11 = 0 and doc_id % 2 = 0 then 'access.probe_attempts' end,
      'lineage.english_from') as missing
    from documents""")
def b15_manifest(spark, d):
    raw = F.concat(
        F.lit('{"decision_mode":'), F.expr("if(doc_id % 5 = 0, '\"manual\"', '\"unattended\"')"),
        F.lit(',"source":{"url":"u","platform":"p","video_id":"'), F.col("doc_id").cast("string"),
        F.lit('","title":'), F.expr("if(doc_id % 2 = 0, '\"\"', '\"t\"')"),
        F.lit(',"duration_seconds":'),
        F.expr("case when doc_id % 17 = 0 then 'null' when doc_id % 13 = 0 then 'true' else concat(n_chars, '.5') end"),
        F.lit('},"access":{"probe_attempts":'),
        F.expr("case when doc_id % 11 = 0 then if(doc_id % 2 = 0, 'null', '[]') else '[{\"outcome\":\"ok\"}]' end"),
        F.lit(',"paywall_outcome":"none","drm_outcome":"none"},"captions":{"tracks":[],"selected":'),
        F.expr("""case when doc_id % 6 = 0 then '"0"' when doc_id % 3 = 0 then concat('"manual:', lang, '"') when doc_id % 5 = 0 then '""' else 'null' end"""),
        F.lit('},"transcription":{"used":'), F.expr("""case when doc_id % 12 = 0 then '"whisper"' when doc_id % 8 = 0 then '2' when doc_id % 4 = 0 then 'true' when doc_id % 5 = 0 then '0' else 'false' end"""),
        F.lit('},"lineage":{"source_authority":"captions","source_corrected":"a","chinese_from":"b","english_from":null},"transitions":'),
        F.expr("if(doc_id % 7 = 0, '[]', '[{\"state\":\"initialized\"}]')"), F.lit("}"),
    )
    docs = load(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return contracts.manifest_gaps(docs, "raw").select("doc_id", F.array_join("missing", ",").alias("missing"))


@R.add("b16_suite_gates", """
    with c as (select lang as suite, quality = 1 as pos, doc_id % 32 + 1 as track, doc_id,
                      (doc_id % 97 + 4 < 5 or doc_id % 89 + 2 < 3) as weak from documents join labels using (doc_id)),
    g as (select suite, count(*) filter (pos) as positive, count(*) filter (not pos) as negative, count(*) as cases,
                 count(distinct doc_id) as ids, count(distinct track) as tracks_covered, count(*) filter (weak) as weak_rubrics
          from c group by 1)
    select *, concat_ws(',', case when positive < 40 then 'too few positive' end,
        case when negative < 16 then 'too few negative' end, case when ids <> cases then 'repeated ids' end,
        case when tracks_covered <> 32 then 'tracks not covered' end, case when weak_rubrics > 0 then 'weak rubrics' end) as failed_gates
    from g""")
def b16(spark, d):
    cases = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(
        F.col("lang").alias("suite"), (F.col("quality") == 1).alias("should_trigger"), F.col("doc_id").alias("case_id"),
        (F.col("doc_id") % 32 + 1).alias("track_id"),
        F.expr("array_repeat('m', cast(doc_id % 97 + 4 as int))").alias("must"),
        F.expr("array_repeat('n', cast(doc_id % 89 + 2 as int))").alias("must_not"))
    return contracts.suite_gates(cases, "suite", 32)


@R.add("b17_exclusive_branch", """
    select doc_id, (quality = 1) <> (toxic = 1) as branch_ok from labels""")
def b17(spark, d):
    labels = load(spark, d, "labels")
    return contracts.exclusive_branch(labels, F.col("quality") == 1, F.col("toxic") == 1).select("doc_id", "branch_ok")


def package_tables(spark: SparkSession, d: str):
    docs = load(spark, d, "documents")
    number = F.expr("cast(substring(source, 4) as int)")
    packages = docs.select("source").distinct().select(
        "source", (number % 2 == 0).alias("captions"),
        F.when(number % 3 == 0, "zh").when(number % 3 == 1, "en").otherwise("fr").alias("source_language"))
    files = docs.select("source", F.format_string("%s/%d.txt", "lang", F.col("doc_id") % 12).alias("path"),
                        F.expr("if(doc_id % 9 = 0, 0, n_chars)").alias("bytes"))
    foreign = ~F.col("source_language").isin("zh", "en")
    rules = [
        ("en/0.txt", F.lit(True)), ("en/1.txt", F.lit(True)), ("fr/0.txt", F.lit(True)), ("fr/1.txt", F.lit(True)),
        ("de/2.txt", F.col("captions")), ("es/2.txt", ~F.col("captions")), ("de/3.txt", foreign), ("absent.md", foreign),
    ]
    return packages, files, rules


REQUIRED = """
    with p as (select distinct source, cast(substr(source, 4) as int) % 2 = 0 as captions,
                      cast(substr(source, 4) as int) % 3 = 2 as fremd from documents),
    r(rule, path, needs) as (values (0, 'en/0.txt', 'all'), (1, 'en/1.txt', 'all'), (2, 'fr/0.txt', 'all'), (3, 'fr/1.txt', 'all'),
        (4, 'de/2.txt', 'captions'), (5, 'es/2.txt', 'whisper'), (6, 'de/3.txt', 'foreign'), (7, 'absent.md', 'foreign')),
    m as (select p.source, r.rule, r.path from p join r on needs = 'all' or (needs = 'captions' and captions)
                 or (needs = 'whisper' and not captions) or (needs = 'foreign' and fremd)
          where not exists (select 1 from documents f where f.source = p.source and f.doc_id % 9 <> 0 and n_chars > 0
                              and f.lang || '/' || (f.doc_id % 12) || '.txt' = r.path))"""


@R.add("b18_required_artifacts", REQUIRED + "select source, rule, path from m")
def b18(spark, d):
    packages, files, rules = package_tables(spark, d)
    return contracts.required_artifacts(packages, files, "source", rules)


@R.add("b19_package_status", REQUIRED + """
    select p.source, coalesce(path, '') as path, coalesce(row_number() over (partition by p.source order by rule), 0) as position,
           count(path) over (partition by p.source) as missing_count,
           case when path is null then 'complete' else 'incomplete' end as status
    from p left join m using (source)
    where path is not null
    union all select source, '', 0, 0, 'complete' from p where source not in (select source from m)""")
def b19(spark, d):
    packages, files, rules = package_tables(spark, d)
    missing = contracts.required_artifacts(packages, files, "source", rules)
    return contracts.package_status(packages, missing, "source", ["rule"]).select(
        "source", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("position", F.lit(0)).cast("bigint").alias("position"),
        "missing_count", "status")


@R.add("b20_content_address_audit", """
    select page_id, case when page_id % 5 = 0 or page_id % 7 = 0 then 'not-portable'
                         when page_id % 11 = 0 and page_id % 3 <> 0 then 'wrong-address'
                         when page_id % 3 = 0 and page_id % 11 <> 0 then 'wrong-address' else 'ok' end as address_status from pages""")
def b20(spark, d):
    rows = load(spark, d, "pages").select("page_id", sha256(F.col("html")).alias("sha256"),
                                          F.expr("if(page_id % 3 = 0, 'spritesheet', 'frame')").alias("type"))
    address = F.concat(F.lit("artifacts/"), F.col("sha256"), F.lit(".png"))
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), address)).when(
        F.col("page_id") % 7 == 0, F.concat(F.lit("../"), address)).when(
        F.col("page_id") % 11 == 0, F.lit("spritesheet.png")).otherwise(address)
    return ops.content_address_audit(rows.withColumn("path", path), "path", "sha256", "type").select("page_id", "address_status")


@R.add("b21_duplicate_content", """
    with h as (select doc_id, lang, sha256(text) as sha from documents)
    select doc_id, lang, sha, count(*) over w as copies, min(doc_id) over w as first_holder from h
    window w as (partition by lang, sha) qualify count(*) over w > 1""")
def b21(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", sha256(F.col("text")).alias("sha"))
    return ops.duplicate_content(docs, "sha", ["lang"], "doc_id")


@R.add("b22_budget_audit", FILES + """,
    r as (select *, sum(bytes) over w as running, row_number() over w as n from f window w as (partition by source order by path))
    select source, cast(sum(bytes) as bigint) as total_bytes, count(*) as files, count(*) filter (bytes > 9000) as oversized_items,
           coalesce(min(path) filter (running > 60000 or n > 45), '') as first_overflow from r group by 1""")
def b22(spark, d):
    out = ops.budget_audit(document_files(spark, d), "source", "path", "bytes", 60_000, 45, 9_000)
    return out.withColumn("first_overflow", F.coalesce("first_overflow", F.lit("")))


@R.add("b27_reference_closure", r"""
    with l as (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as path,
                      unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as ref from pages),
    r as (select host, case when ref like '/%' then ref else path || '/' || ref end as path, count(*) as n
          from l where not regexp_matches(ref, '^[a-z]+:') group by 1, 2),
    f as (select distinct host, path from l
          union select host, path from r where length(path) % 3 <> 0)
    select coalesce(r.host, f.host) as host, coalesce(r.path, f.path) as path, coalesce(n, 0) as "references",
           case when f.host is null then 'missing' when n is null then 'unreferenced' else 'ok' end as status
    from r full join f on r.host = f.host and r.path = f.path""")
def b27(spark, d):
    pages = load(spark, d, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"),
        F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("hrefs"))
    links = pages.select("host", "path", F.explode("hrefs").alias("ref"))
    inside = links.where(~F.col("ref").rlike("^[a-z]+:"))
    refs = inside.select("host", F.when(F.col("ref").startswith("/"), F.col("ref")).otherwise(
        F.concat_ws("/", "path", "ref")).alias("path"))
    files = links.select("host", "path").union(refs.where("length(path) % 3 <> 0"))
    return ops.reference_closure(refs, files, ["host", "path"])


def document_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return ops.findings(rows, "source", "lang", {
        ("MACHINE-VERIFIED", "length"): F.length("text") == F.col("n_chars"),
        ("REVIEWED", "quality"): F.coalesce(F.col("quality") == 1, F.lit(True)),
        ("DECLARED", "language"): F.col("lang") != "es",
        ("SUPPLIED", "text"): F.col("n_chars") > 60,
    })


@R.add("b28_claim_rollup", """
    with c as (
      select source, lang, 'MACHINE-VERIFIED' as class, length(text) = n_chars as ok from documents
      union all select source, lang, 'REVIEWED', coalesce(quality = 1, true) from documents left join labels using (doc_id)
      union all select source, lang, 'DECLARED', lang <> 'es' from documents
      union all select source, lang, 'SUPPLIED', n_chars > 60 from documents)
    select source as package_id, coalesce(lang, '*') as subject, coalesce(class, 'OVERALL') as class, count(*) as checks,
           count(*) filter (not ok) as failures, case when bool_and(ok) then 'PASS' else 'FAIL' end as result
    from c group by grouping sets ((source, lang, class), (source))""")
def b28(spark, d):
    return ops.claim_rollup(document_findings(spark, d))


@R.add("b29_state_evidence_gate", """
    with s as (select o_orderkey, o_orderstatus as st, case o_custkey % 3 when 0 then 'required' when 1 then 'not-requested' else 'maybe' end as scope,
                      o_orderkey % 4 = 0 as no_contract, o_orderkey % 5 = 0 as no_projection, o_orderkey % 6 = 0 as no_proof from orders)
    select o_orderkey, concat_ws(',', case when scope = 'maybe' then 'scope is invalid' end,
       case when st = 'F' and scope <> 'not-requested' then 'scope must be not-requested' end,
       case when st in ('O', 'P') and scope <> 'required' then 'scope must be required' end,
       case when st in ('O', 'P') and (no_contract or no_projection) then 'contract and projection required' end,
       case when st = 'P' and no_proof then 'proof required' end) as reasons from s""")
def b29(spark, d):
    rows = load(spark, d, "orders").select(
        "o_orderkey",
        F.expr("case o_orderstatus when 'F' then 'package-ready' when 'O' then 'runtime-metadata-complete' else 'runtime-verified' end").alias("status"),
        F.expr("case o_custkey % 3 when 0 then 'required' when 1 then 'not-requested' else 'maybe' end").alias("scope"),
        F.expr("if(o_orderkey % 4 = 0, null, 'c')").alias("contract"),
        F.expr("if(o_orderkey % 5 = 0, null, 'p')").alias("projection"),
        F.expr("if(o_orderkey % 6 = 0, null, 'x')").alias("proof"))
    return contracts.state_evidence_gate(rows).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@R.add("b30_projection_audit", """
    select o_orderkey, case when o_orderkey % 41 = 0 then 'absent' when o_orderkey % 23 = 0 or o_orderkey % 31 = 0 then 'differs'
                            else 'equal' end as status,
           case when o_orderkey % 41 = 0 then '' else concat_ws(',', case when o_orderkey % 23 = 0 then 'o_orderstatus' end,
                            case when o_orderkey % 31 = 0 then 'o_totalprice' end) end as fields from orders""")
def b30(spark, d):
    orders = load(spark, d, "orders")
    shown = orders.where("o_orderkey % 41 <> 0").withColumn(
        "o_orderstatus", F.expr("if(o_orderkey % 23 = 0, 'X', o_orderstatus)")).withColumn(
        "o_totalprice", F.expr("if(o_orderkey % 31 = 0, null, o_totalprice)"))
    out = ops.projection_audit(orders, shown, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    return out.withColumn("fields", F.array_join("fields", ","))


@R.add("b31_observed_events_audit", """
    with e as (select distinct user_id, event_type as clip, 'e' || (event_id % 5) as name, event_id as position, event_id from events)
    select user_id, clip, name, position, case when event_id % 37 = 0 then 'missing' else 'mismatch' end as status from e
    where event_id % 37 = 0 or event_id % 41 = 0
    union all select user_id, clip, name, position + 1000000000, 'unexpected' from e where event_id % 43 = 0 and event_id % 37 <> 0
    union all select distinct user_id, clip, '', -1, 'clip-order' from e where user_id % 10 = 0 and clip = 'view'""")
def b31(spark, d):
    ev = load(spark, d, "events").select(
        "user_id", F.col("event_type").alias("clip"), F.expr("concat('e', event_id % 5)").alias("name"),
        F.col("event_id").alias("position"), F.expr("ascii(event_type)").alias("clip_order"))
    seen = ev.where("position % 37 <> 0").withColumn("observed", F.col("position") % 41 != 0)
    extra = seen.where("position % 43 = 0").withColumn("position", F.col("position") + 1_000_000_000)
    # the observer lists every clip, also one whose events are all missing
    clips = ev.withColumn("clip_order", F.expr("if(user_id % 10 = 0 and clip = 'view', 0, clip_order)"))
    return ops.observed_events_audit(ev, seen.union(extra), "user_id", clips)


@R.add("b32_replay_audit", """
    with g as (select l_orderkey, count(*) as lines, cast(sum(l_quantity) as bigint) as quantity, max(l_partkey) as last_part
               from lineitem group by 1)
    select l_orderkey, 'lines' as metric, lines + 1 as recorded, lines as recomputed from g where l_orderkey % 31 = 0
    union all select l_orderkey, 'last_part', -1, last_part from g where l_orderkey % 29 = 0""")
def b32(spark, d):
    again = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.max("l_partkey").alias("last_part"))
    kept = again.withColumn("lines", F.expr("if(l_orderkey % 31 = 0, lines + 1, lines)")).withColumn(
        "last_part", F.expr("if(l_orderkey % 29 = 0, -1, last_part)"))
    return ops.replay_audit(kept, again, ["l_orderkey"], ["lines", "quantity", "last_part"])


@R.add("b33_job_cache_match", """
    with j as (select min(o_orderkey) as job_id, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 3 = 0 group by 2, 3, 4),
    q as (select o_orderkey, o_custkey, case when o_orderkey % 5 = 0 then 'Z' else o_orderstatus end as o_orderstatus, o_orderpriority from orders)
    select q.o_orderkey, coalesce(j.job_id, -1) as reused_job from q left join j using (o_custkey, o_orderstatus, o_orderpriority)""")
def b33(spark, d):
    orders = load(spark, d, "orders").withColumn("input_sha256", sha256(F.col("o_custkey").cast("string")))
    jobs = orders.where("o_orderkey % 3 = 0").withColumn("job_id", F.col("o_orderkey"))
    asked = orders.withColumn("o_orderstatus", F.expr("if(o_orderkey % 5 = 0, 'Z', o_orderstatus)"))
    out = ops.job_cache_match(jobs, asked, "input_sha256", ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", F.coalesce("reused_job", F.lit(-1)).alias("reused_job"))


@R.add("b34_evidence_key_audit", """
    with c as (select unnest([upper(lang), upper(source), 'Q' || (doc_id % 3)]) as k from documents),
    u as (select k, count(*) as n from c group by 1),
    s as (select distinct upper(source) as k from documents where source <> 'src7' union select 'EN' union select 'UNUSED')
    select coalesce(u.k, s.k) as evidence_key, coalesce(n, 0) as uses,
           case when s.k is null then 'unresolved' when n is null then 'unused' else 'resolved' end as status
    from u full join s on u.k = s.k""")
def b34(spark, d):
    docs = load(spark, d, "documents")
    records = docs.select(F.concat_ws(", ", F.upper("lang"), F.upper("source"), F.expr("concat('Q', doc_id % 3)")).alias("keys"))
    sources = docs.where("source <> 'src7'").select(F.upper("source").alias("k")).distinct().union(
        spark.createDataFrame([("EN",), ("UNUSED",)], "k string"))
    return contracts.evidence_key_audit(records, "keys", sources, "k")


TERMS = ("confidential", "password", "license", "The The", "ÉTRE")


@R.add("b35_vocabulary_audit", """
    select doc_id, array_to_string(list_filter(['confidential', 'password', 'license', 'The The', 'ÉTRE'],
           lambda t: contains(lower(text), lower(t))), ',') as forbidden_terms from documents""")
def b35(spark, d):
    return contracts.vocabulary_audit(load(spark, d, "documents"), "text", TERMS).select(
        "doc_id", F.array_join("forbidden_terms", ",").alias("forbidden_terms"))


@R.add("b36_value_domain_audit", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
      case when l_partkey % 10 = 0 then 'name' end, case when l_suppkey % 7 = 0 then 'loop' end,
      case when l_partkey % 8 = 0 or l_quantity < 3 then 'count' end,
      case when l_returnflag = 'R' then 'flag' end,
      case when l_linenumber > 5 then 'items' end,
      case when l_suppkey % 9 = 0 then 'anchor' end,
      case when l_linenumber + 10 > 15 or l_suppkey % 5 = 0 then 'box' end) as breaches from lineitem""")
def b36(spark, d):
    raw = F.concat(
        F.lit('{"name":'), F.expr("if(l_partkey % 10 = 0, '\"\"', concat('\"p', l_partkey, '\"'))"),
        F.lit(',"loop":'), F.expr("if(l_suppkey % 7 = 0, '1', 'true')"),
        F.lit(',"count":'), F.expr("if(l_partkey % 8 = 0, 'true', cast(cast(l_quantity as int) as string))"),
        F.lit(',"flag":"'), F.col("l_returnflag"), F.lit('","items":['),
        F.expr("array_join(array_repeat('\"i\"', l_linenumber), ',')"), F.lit('],"anchor":'),
        F.expr("if(l_suppkey % 9 = 0, '[1,2.5]', '[3,4]')"), F.lit(',"box":['),
        F.expr("if(l_suppkey % 5 = 0, '9', '0')"), F.lit(",0,9,"), (F.col("l_linenumber") + 10).cast("string"), F.lit("]}"))
    rule = contracts.ValueRule
    rules = [rule("name", "string"), rule("loop", "boolean"), rule("count", "integer", minimum=3),
             rule("flag", "enum", domain=("A", "N")), rule("items", "array", minimum=1, maximum=5),
             rule("anchor", "point"), rule("box", "box")]
    rows = spread(load(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))
    return contracts.value_domain_audit(rows, "raw", rules, canvas=(20, 15)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("breaches", ",").alias("breaches"))
