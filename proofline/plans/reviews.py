"""Review and admission audits; orders, events and labels stand in for review records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.hashing import sha256, sorted_struct
from proofline.operators import reviews as ops
from proofline.operators.sequence import numbered, ordered
from proofline.plans.registry import Registry
from proofline.plans.tracks import micros
from proofline.session import load

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _admission(subjects) -> Column:
    """Proofs of the canonical subjects (1 and 2) of a review; some are wrong, missing or of a subject that has none."""
    canonical = F.filter(subjects, lambda s: s.isin("1", "2"))
    named = F.expr("order_id % 31 = 5")
    keys = F.when(named, F.array_append(canonical, F.lit("9"))).when(F.col("order_id") % 29 == 4, F.slice(canonical, 1, 0)).otherwise(canonical)
    seal = F.when(F.col("order_id") % 19 == 6, F.lit("z")).otherwise(F.lit("a"))
    return F.map_from_arrays(keys, F.transform(keys, lambda s: sha256(F.concat(seal, s))))


def order_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as scoped reviews, the subject hashes partly out of date."""
    orders = load(spark, d, "orders").select(
        F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("order_id"), "o_orderpriority")
    ranked = numbered(ordered(orders, ["package"], ["order_id"]), "place").plain()
    subjects = F.array(F.expr("cast(order_id % 5 as string)"), F.expr("cast(order_id % 5 + 1 as string)"))
    held = F.when(F.col("order_id") % 11 == 0, F.lit("old")).otherwise(F.lit("s"))
    return ranked.select(
        "package", F.when(F.col("order_id") % 23 == 0, F.lit(-7)).otherwise(F.col("order_id")).alias("id"), "order_id",
        F.substring("o_orderpriority", 1, 1).alias("gate"), subjects.alias("subject_ids"),
        F.map_from_arrays(subjects, F.transform(subjects, lambda s: sha256(F.concat(held, s)))).alias("subject_sha256"),
        F.when(F.col("order_id") % 50 == 0, F.col("place") + 100).otherwise(F.col("place")).alias("declared_order"),
        _admission(subjects).alias("admission_sha256"),
    )


@R.add("b23_review_scope_audit", """
    with r as (select o_custkey as package, case when o_orderkey % 23 = 0 then -7 else o_orderkey end as id, o_orderkey as oid,
                      substr(o_orderpriority, 1, 1) as gate, o_orderkey % 5 as s,
                      row_number() over (partition by o_custkey order by o_orderkey) + case when o_orderkey % 50 = 0 then 100 else 0 end as ord
               from orders),
    e as (select distinct package, gate, s from r where oid % 13 <> 0
          union select distinct package, '9', 0 from r where package % 10 = 0),
    g as (select package, gate, s, count(*) as n, min(id) as id from r group by 1, 2, 3)
    select coalesce(g.package, e.package) as package, coalesce(g.id, -1) as id,
           case when n is null then 'missing' when e.package is null then 'unexpected' else 'duplicate' end as code
    from g full join e on g.package = e.package and g.gate = e.gate and g.s = e.s
    where n is null or e.package is null or n > 1
    union all select distinct package, id, 'stale' from r where oid % 11 = 0
    union all select distinct package, id, 'admission' from r
      where oid % 31 = 5 or (s between 0 and 2 and oid % 29 = 4) or (s between 0 and 2 and oid % 19 = 6)
    union all select package, id, 'repeated-id' from r group by 1, 2 having count(*) > 1
    union all select package, -1, 'order-not-contiguous' from r group by 1
              having min(ord) <> 1 or max(ord) <> count(*) or count(distinct ord) <> count(*)""")
def b23(spark, d):
    found = order_reviews(spark, d)
    expected = found.where("order_id % 13 <> 0").select("package", "gate", "subject_ids").union(
        found.where("package % 10 = 0").select("package", F.lit("9"), F.array(F.lit("0"), F.lit("1"))))
    hashes = found.select("package", F.explode("subject_ids").alias("subject_id")).distinct().withColumn(
        "sha256", sha256(F.concat(F.lit("s"), F.col("subject_id"))))
    admissions = hashes.where("subject_id in ('1', '2')").select("package", "subject_id", sha256(F.concat(F.lit("a"), F.col("subject_id"))).alias("sha256"))
    return ops.review_scope_audit(found, expected, hashes, "package", admissions)


@R.add("b24_gate_order_audit", """
    with r as (select user_id, event_id as id, epoch_us(ts) as ord, 'c' || (event_id % 3) as canon,
                      case event_type when 'signup' then 0 when 'purchase' then 2 else 1 end as rank,
                      case when event_type = 'purchase' then ['f0', 'f1', 'f2'] else ['f' || (event_id % 50)] end as frames
               from events),
    p as (select *, max(rank) over (partition by user_id order by ord, id rows between unbounded preceding and 1 preceding) as peak from r),
    c as (select user_id, canon, max(ord) as at from r where rank = 0 group by 1, 2),
    k as (select s.user_id, s.id, s.ord, count(f.id) as n, min(f.ord) as key_ord
          from r s left join r f on f.user_id = s.user_id and f.canon = s.canon and f.rank = 1
                                 and list_has_all(s.frames, f.frames)
          where s.rank = 2 group by 1, 2, 3)
    select user_id, id, 'rank-decreases' as code from p where rank < peak
    union all select r.user_id, r.id, 'before-canonical' from r left join c using (user_id, canon)
              where rank > 0 and (c.at is null or c.at >= ord)
    union all select user_id, id, 'keyframes-not-before-sequence' from k where n <> 1 or key_ord >= ord""")
def b24(spark, d):
    gate = F.expr("""case event_type when 'signup' then 'canonical-approval' when 'purchase' then 'sequence-approval'
                     else 'keyframe-set-approval' end""")
    canonical = F.expr("concat('c', event_id % 3)")
    subjects = F.when(F.col("event_type") == "purchase", F.array(canonical, F.lit("f0"), F.lit("f1"), F.lit("f2"))).otherwise(
        F.array(canonical, F.expr("concat('f', event_id % 50)")))
    rows = load(spark, d, "events").select(
        "user_id", F.col("event_id").alias("id"), gate.alias("gate"), subjects.alias("subject_ids"), micros().alias("declared_order"))
    return ops.gate_order_audit(rows, "user_id")


def packets(spark: SparkSession, d: str) -> DataFrame:
    """One review packet per labelled document."""
    labels = load(spark, d, "labels")
    disposition = F.expr("case when toxic = 1 then 'rework-required' when quality = 0 then 'uncertain' else 'acceptable' end")

    def observation(subject):
        return F.struct(F.lit("reviewed").alias("classification"), disposition.alias("disposition"), subject.alias("subject_id"))

    second = F.expr("if(doc_id % 12 = 0, 'ghost', 's2')")
    observations = F.when(F.col("doc_id") % 14 == 0, F.array(observation(F.lit("s1"))).cast(
        "array<struct<classification:string,disposition:string,subject_id:string>>")).otherwise(
        F.array(observation(F.lit("s1")), observation(second)))
    observations = F.when(F.col("doc_id") % 17 == 0, F.slice(observations, 1, 0)).otherwise(observations)
    evidence = F.expr("case when doc_id % 10 = 0 then array('e9') when doc_id % 16 = 0 then cast(array() as array<string>) else array('e1') end")
    reviews = F.array(F.struct(evidence.alias("evidence_ids"), observations.alias("observations"), F.lit("r1").alias("reviewer")))
    return labels.select("doc_id", F.col("doc_id").alias("packet"), F.array(F.lit("s1"), F.lit("s2")).alias("subjects"),
                         F.array(F.lit("e1")).alias("evidence"), reviews.alias("reviews"),
                         F.expr("if(doc_id % 18 = 0, 'pending', 'approved')").alias("status"))


def bound_text():
    """Canonical text of packet id, subjects, evidence and reviews."""
    return F.to_json(sorted_struct({c: F.col(c) for c in ("packet", "subjects", "evidence", "reviews")}), {"ignoreNullFields": "false"})


@R.add("b25_review_decision", """
    with l as (select *, case when doc_id % 17 = 0 then 0 when doc_id % 14 = 0 then 1 else 2 end as n from labels),
    p as (select doc_id, concat_ws('; ',
       case when doc_id % 10 <> 0 and doc_id % 16 = 0 then 'review without evidence' end,
       case when doc_id % 10 = 0 then 'unknown evidence' end,
       case when n = 2 and doc_id % 12 = 0 then 'unknown subject' end,
       case when doc_id % 18 = 0 then 'invalid status' end,
       case when doc_id % 21 = 0 then 'decision hash mismatch' end,
       case when n = 0 or toxic = 1 or quality = 0 then 'not acceptable' end,
       case when n < 2 or toxic = 1 or quality = 0 or doc_id % 12 = 0 then 'subject coverage' end) as problems,
       sha256('{"evidence":["e1"],"packet":' || doc_id || ',"reviews":[{"evidence_ids":['
         || case when doc_id % 10 = 0 then '"e9"' when doc_id % 16 = 0 then '' else '"e1"' end || '],"observations":['
         || array_to_string(list_transform(range(n), lambda i: '{"classification":"reviewed","disposition":"'
              || case when toxic = 1 then 'rework-required' when quality = 0 then 'uncertain' else 'acceptable' end
              || '","subject_id":"' || case when i = 0 then 's1' when doc_id % 12 = 0 then 'ghost' else 's2' end || '"}'), ',')
         || '],"reviewer":"r1"}],"subjects":["s1","s2"]}') as bound from l)
    select doc_id, bound, problems, problems = '' as approved from p""")
def b25(spark, d):
    rows = packets(spark, d)
    recorded = F.when(F.col("doc_id") % 21 == 0, F.lit("0" * 64)).otherwise(sha256(bound_text()))
    out = ops.review_decision(rows.withColumn("subject_sha256", recorded), bound_text())
    return out.select("doc_id", sha256(bound_text()).alias("bound"), F.array_join("problems", "; ").alias("problems"), "approved")


@R.add("b26_artifact_lineage", """
    with j as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
        concat_ws(',', case when l_orderkey % 37 = 0 then 'artifact missing' end, case when l_partkey % 43 = 0 then 'plan position missing' end,
          case when l_orderkey % 37 <> 0 and l_suppkey % 30 = 0 then 'kind differs' end,
          case when l_orderkey % 37 <> 0 and l_suppkey % 31 = 0 then 'digest differs' end,
          case when l_partkey % 43 <> 0 and l_suppkey % 32 = 0 then 'size differs' end,
          case when l_returnflag = 'R' then 'policy' end) as reasons from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, reasons from j where reasons <> ''""")
def b26(spark, d):
    orders = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", sha256(F.col("o_orderkey").cast("string")).alias("o_sha"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    claims = load(spark, d, "lineitem").join(orders, "l_orderkey").join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.expr("if(l_suppkey % 30 = 0, 'X', o_orderstatus)").alias("kind"),
        F.expr("if(l_suppkey % 31 = 0, 'none', o_sha)").alias("digest"),
        F.expr("if(l_suppkey % 32 = 0, -1, p_size)").alias("size"))
    out = ops.artifact_lineage(
        claims, orders.where("l_orderkey % 37 <> 0"), parts.where("l_partkey % 43 <> 0"), "l_orderkey", "l_partkey",
        {"kind": "o_orderstatus", "digest": "o_sha"}, {"size": "p_size"}, F.col("l_returnflag").isin("A", "N"))
    return out.where(F.size("reasons") > 0).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("reasons", ",").alias("reasons"))
