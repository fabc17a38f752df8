"""Scoring and evaluation queries over documents, labels, orders, part, lineitem and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import scoring as ops
from proofline.operators.sequence import ordered, scan
from proofline.plans.motion import PLANES, planes
from proofline.plans.registry import Registry
from proofline.plans.tracks import micros
from proofline.session import load

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def judged_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(load(spark, d, "labels"), "doc_id")


def confusion_sql(source: str, keys: str) -> str:
    return f"""
      select {keys}, tp, fp, fn, round(p, 9) as "precision", round(r, 9) as recall,
             round(case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 1 end, 9) as iou,
             round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1
      from (select *, case when tp + fp > 0 then tp / (tp + fp) else 1.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 1.0 end as r from {source})"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@R.add("d01_binary_scores", """
    with j as (select lang, source, n_chars > 500 as pred, quality = 1 as truth from documents join labels using (doc_id)),
    c as (select lang, source, count(*) filter (pred and truth) as tp, count(*) filter (pred and not truth) as fp,
                 count(*) filter (not pred and truth) as fn from j group by 1, 2)""" + confusion_sql("c", "lang, source"))
def d01(spark, d):
    out = ops.binary_scores(judged_documents(spark, d), ["lang", "source"], F.col("n_chars") > 500, F.col("quality") == 1)
    return rounded(out, "precision", "recall", "iou", "f1")


@R.add("d02_mask_scores", PLANES + """,
    w as (select clip, vec_id, a as x, lag(a) over (partition by clip order by vec_id) as y from p),
    m as (select clip, vec_id, len(list_filter(range(1, 65), lambda i: x[i] >= 128 and y[i] >= 128)) as tp,
                 len(list_filter(range(1, 65), lambda i: x[i] >= 128 and y[i] < 128)) as fp,
                 len(list_filter(range(1, 65), lambda i: x[i] < 128 and y[i] >= 128)) as fn,
                 round(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) / (64 * 255.0), 9) as alpha_mae from w where y is not null)
    select * exclude (tp, fp, fn) from (""" + confusion_sql("m", "clip, vec_id, alpha_mae") + ")")
def d02(spark, d):
    seq = scan(ordered(planes(spark, d), ["clip"], ["vec_id"]), prev={"truth": "alpha"}).plain().where("truth is not null")
    out = ops.mask_scores(seq, "alpha", "truth").drop("alpha", "truth")
    return rounded(out, "precision", "recall", "iou", "f1", "alpha_mae")


@R.add("d03_trigger_eval", """
    with c as (select doc_id, quality = 1 as want, case when doc_id % 2 = 0 then 'even' else 'odd' end as split from labels),
    u as (select 'r1' as release, doc_id, n_chars > 500 as hit from documents
          union all select 'r2', doc_id, n_chars > 800 from documents where doc_id % 10 <> 0
          union all select 'r3', doc_id, n_chars > 300 from documents where doc_id % 2 = 0),
    t as (select split, count(*) filter (want) as pos from c group by 1),
    g as (select release, split, count(*) filter (hit and want) as tp, count(*) filter (hit and not want) as fp
          from c join u using (doc_id) group by 1, 2),
    f as (select release, split, pos, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp
          from (select distinct release from u) cross join t left join g using (release, split))
    select release, split, tp, fp, pos - tp as fn, round(case when tp + fp > 0 then tp / (tp + fp) else 1 end, 9) as "precision",
           round(case when pos > 0 then tp / pos else 1 end, 9) as recall from f""")
def d03(spark, d):
    cases = load(spark, d, "labels").select(
        F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("should_trigger"),
        F.expr("if(doc_id % 2 = 0, 'even', 'odd')").alias("split"))
    docs = load(spark, d, "documents")
    runs = docs.select(F.lit("r1").alias("release"), F.col("doc_id").alias("case_id"), (F.col("n_chars") > 500).alias("triggered")).union(
        docs.where("doc_id % 10 <> 0").select(F.lit("r2"), "doc_id", F.col("n_chars") > 800)).union(
        docs.where("doc_id % 2 = 0").select(F.lit("r3"), "doc_id", F.col("n_chars") > 300))
    return rounded(ops.trigger_eval(runs, cases), "precision", "recall")


@R.add("d04_rubric_score", """
    with s as (select o_orderkey as run_id, i as dim, case when o_orderkey % 33 = 0 and i = 2 then 5
                      when (o_orderkey * i) % 11 < o_custkey % 13 then 2 else (o_orderkey + i) % 3 end as score
               from orders, range(1, 17) as r(i) where not (o_orderkey % 20 = 0 and i = 16)),
    t as (select run_id, cast(sum(score) as bigint) as total, count(*) as n, count(*) filter (score not in (0, 1, 2)) as bad from s group by 1),
    v as (select o_orderkey as run_id, 2 as n from orders where o_orderstatus = 'P' and o_orderkey % 4 = 0)
    select run_id, total, coalesce(cast(v.n as bigint), 0) as vetoes,
           case when t.n <> 16 or bad > 0 then 'invalid' when v.n > 0 then 'failed' when total >= 28 then 'strong' when total >= 23 then 'useful'
                when total >= 17 then 'insufficient' else 'failed' end as verdict
    from t left join v using (run_id)""")
def d04(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cells = orders.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("dimension"))
    scores = cells.where("not (o_orderkey % 20 = 0 and dimension = 16)").select(
        F.col("o_orderkey").alias("run_id"), "dimension", F.expr("""case when o_orderkey % 33 = 0 and dimension = 2 then 5
            when (o_orderkey * dimension) % 11 < o_custkey % 13 then 2 else (o_orderkey + dimension) % 3 end""").alias("score"))
    bad = orders.where("o_orderstatus = 'P' and o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("run_id"))
    return ops.rubric_score(scores, bad.union(bad))


@R.add("d05_weighted_score", """
    with w(i, weight) as (values (0, 20), (1, 15), (2, 15), (3, 15), (4, 10), (5, 10), (6, 10), (7, 5)),
    s as (select p_partkey as candidate, i, weight, case when not (i = 4 and p_size % 2 = 0) then (p_partkey + i * p_size) % 5 + 1 end as score from part, w),
    g as (select p_partkey as candidate, count(*) filter ((p_partkey + i) % 40 = 0) as failed_gates from part, range(5) as r(i) group by 1),
    t as (select candidate, count(*) filter (score is null) as not_applicable, sum(score / 5.0 * weight) as num,
                 sum(weight) filter (score is not null) as den from s group by 1)
    select candidate, failed_gates, not_applicable, coalesce(round(case when failed_gates = 0 then num / den * 100 end, 6), -1) as score
    from t join g using (candidate)""")
def d05(spark, d):
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("candidate"), "p_size")
    names = F.array(*[F.lit(n) for n in ops.CRITERION_WEIGHTS])
    scores = parts.select("candidate", "p_size", F.posexplode(names).alias("i", "criterion")).select(
        "candidate", "criterion", F.expr("case when not (i = 4 and p_size % 2 = 0) then (candidate + i * p_size) % 5 + 1 end").alias("score"))
    gates = parts.select("candidate", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(
        "candidate", ((F.col("candidate") + F.col("i")) % 40 != 0).alias("passed"))
    out = ops.weighted_score(scores, gates)
    return out.withColumn("score", F.round(F.coalesce("score", F.lit(-1.0)), 6))


@R.add("d06_must_checks", """
    with c as (select *, case lang when 'en' then ['the', 'of'] when 'fr' then ['que', 'les'] when 'de' then ['und', 'der'] else ['que', 'el'] end as must,
                      case when lang = 'en' then ['***', 'token'] else ['###', '@'] end as must_not from documents),
    r as (select doc_id, lang, list_filter(must, lambda m: not contains(text, m)) as a, list_filter(must_not, lambda m: contains(text, m)) as f from c)
    select doc_id, case when lang <> 'es' then array_to_string(a, ',') else '' end as absent,
           case when lang <> 'es' then array_to_string(f, ',') else '' end as forbidden, lang <> 'es' and len(a) + len(f) = 0 as passed,
           case when lang = 'es' then 'no case' else 'judged' end as status from r
    union all select null, '', '', false, 'no output'""")
def d06(spark, d):
    docs = load(spark, d, "documents")
    asked = docs.where("lang <> 'es'").select(F.col("lang").alias("case_id")).distinct().union(spark.range(1).select(F.lit("it")))
    cases = asked.select(
        "case_id",
        F.expr("""case case_id when 'en' then array('the', 'of') when 'fr' then array('que', 'les')
                  when 'de' then array('und', 'der') else array('que', 'el') end""").alias("must"),
        F.expr("if(case_id = 'en', array('***', 'token'), array('###', '@'))").alias("must_not"))
    out = ops.must_checks(docs.select("doc_id", F.col("lang").alias("case_id"), F.col("text").alias("output")), cases)
    joined = {c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("absent", "forbidden")}
    return out.withColumns(joined).select("doc_id", "absent", "forbidden", "passed", "status")


@R.add("d07_release_regressions", """
    with o as (select o_orderkey as k, o_orderpriority as track, o_totalprice > 150000 as ok from orders where o_orderkey % 10 < 9),
    n as (select o_orderkey as k, o_orderpriority as track, o_totalprice + o_orderkey % 7 * 10000 > 170000 as ok from orders where o_orderkey % 11 < 10)
    select coalesce(n.track, o.track) as track, count(*) filter (o.ok and not n.ok) as regressed, count(*) filter (not o.ok and n.ok) as fixed,
           count(*) filter (o.k is null) as added, count(*) filter (n.k is null) as removed, count(*) filter (o.ok) as old_passed, count(*) filter (n.ok) as new_passed
    from o full join n on o.k = n.k group by 1""")
def d07(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("track"), "o_totalprice")
    old = orders.where("case_id % 10 < 9").withColumn("passed", F.col("o_totalprice") > 150_000)
    new = orders.where("case_id % 11 < 10").withColumn("passed", F.expr("o_totalprice + case_id % 7 * 10000 > 170000"))
    return ops.release_regressions(old, new)


@R.add("d08_worst_case_rollup", """
    with j as (select lang, source, n_chars > 500 as pred, quality = 1 as truth from documents join labels using (doc_id)),
    c as (select lang, source, count(*) filter (pred and truth) as tp, count(*) filter (pred and not truth) as fp, count(*) filter (not pred and truth) as fn from j group by 1, 2),
    m as (""" + confusion_sql("c", "lang, source") + """)
    select lang, count(*) as cases, min(iou) as worst_iou, min("precision") as worst_precision, min(recall) as worst_recall, max(fp) as worst_fp,
           count(*) filter (iou < 0.4 or "precision" < 0.5 or recall < 0.6 or fp > 3) as failures,
           bool_and(not (iou < 0.4 or "precision" < 0.5 or recall < 0.6 or fp > 3)) as passed from m group by 1""")
def d08(spark, d):
    return ops.worst_case_rollup(d01(spark, d), ["lang"], {"iou": 0.4, "precision": 0.5, "recall": 0.6}, {"fp": 3})


@R.add("d09_threshold_gates", """
    select l_orderkey, l_linenumber, l_partkey, concat_ws('; ', case when l_quantity < 3 then printf('l_quantity %.6f below 3.000000', l_quantity) end,
        case when l_discount > 0.08 then printf('l_discount %.6f above 0.080000', l_discount) end,
        case when l_tax < 0.01 then printf('l_tax %.6f below 0.010000', l_tax) end,
        case when l_tax > 0.07 then printf('l_tax %.6f above 0.070000', l_tax) end) as reasons,
        not (l_quantity < 3 or l_discount > 0.08 or l_tax < 0.01 or l_tax > 0.07) as passed from lineitem""")
def d09(spark, d):
    rules = [ops.Gate("l_quantity", minimum=3), ops.Gate("l_discount", maximum=0.08), ops.Gate("l_tax", minimum=0.01, maximum=0.07)]
    out = ops.threshold_gates(load(spark, d, "lineitem"), rules)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("reasons", "; ").alias("reasons"), "passed")


@R.add("d09_synthetic_gates", PLANES + """,
    w as (select clip, vec_id, a as x, lag(a) over (partition by clip order by vec_id) as y from p),
    m as (select clip, vec_id, len(list_filter(range(1, 65), lambda i: x[i] >= 128 and y[i] >= 128)) as tp,
                 len(list_filter(range(1, 65), lambda i: x[i] >= 128 and y[i] < 128)) as fp,
                 len(list_filter(range(1, 65), lambda i: x[i] < 128 and y[i] >= 128)) as fn,
                 list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) / (64 * 255.0) as mae from w where y is not null),
    c as (""" + confusion_sql("m", "clip, vec_id, mae") + """)
    select clip, vec_id, (iou < 0.965)::int + ("precision" < 0.98)::int + (recall < 0.98)::int + (f1 < 0.98)::int + (mae > 0.018)::int as reasons from c""")
def d09_synthetic(spark, d):
    seq = scan(ordered(planes(spark, d), ["clip"], ["vec_id"]), prev={"truth": "alpha"}).plain().where("truth is not null")
    scores = ops.mask_scores(seq, "alpha", "truth")
    rules = [g for g in ops.SYNTHETIC_GATES if g.metric in scores.columns]
    return ops.threshold_gates(scores, rules).select("clip", "vec_id", F.size("reasons").alias("reasons"))


@R.add("d09_synthetic_gates_all", PLANES + """,
    w as (select clip, vec_id, a as x, lag(a) over (partition by clip order by vec_id) as y from p),
    k as (select *, list_filter(range(0, 64), lambda i: x[i + 1] >= 128 and len(list_filter(range(0, 64), lambda j: x[j + 1] < 128 and abs(i % 8 - j % 8) <= 1 and abs(i // 8 - j // 8) <= 1)) > 0) as ex,
                    list_filter(range(0, 64), lambda i: y[i + 1] >= 128 and len(list_filter(range(0, 64), lambda j: y[j + 1] < 128 and abs(i % 8 - j % 8) <= 1 and abs(i // 8 - j // 8) <= 1)) > 0) as ey
          from w where y is not null),
    m as (select clip, vec_id, len(list_filter(range(1, 65), lambda i: x[i] >= 128 and y[i] >= 128)) as tp,
                 len(list_filter(range(1, 65), lambda i: x[i] >= 128 and y[i] < 128)) as fp,
                 len(list_filter(range(1, 65), lambda i: x[i] < 128 and y[i] >= 128)) as fn,
                 list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) / (64 * 255.0) as mae,
                 coalesce((list_avg(list_transform(ex, lambda i: list_min(list_transform(ey, lambda j: sqrt((i % 8 - j % 8) ** 2 + (i // 8 - j // 8) ** 2)))))
                           + list_avg(list_transform(ey, lambda i: list_min(list_transform(ex, lambda j: sqrt((i % 8 - j % 8) ** 2 + (i // 8 - j // 8) ** 2)))))) / 2, 'inf'::double) as edge from k),
    c as (""" + confusion_sql("m", "clip, vec_id, mae, edge") + """)
    select clip, vec_id, round(edge, 9) as boundary_error_px,
           (iou < 0.965)::int + ("precision" < 0.98)::int + (recall < 0.98)::int + (f1 < 0.98)::int + (mae > 0.018)::int + (edge > 2)::int as reasons from c""")
def d09_synthetic_all(spark, d):
    seq = scan(ordered(planes(spark, d), ["clip"], ["vec_id"]), prev={"truth": "alpha"}).plain().where("truth is not null")
    judged = ops.threshold_gates(ops.mask_scores(seq, "alpha", "truth", width=8), ops.SYNTHETIC_GATES)
    return rounded(judged.select("clip", "vec_id", "boundary_error_px", F.size("reasons").alias("reasons")), "boundary_error_px")


@R.add("d10_framing_stability", """
    with c as (select user_id, event_id % 3 as framing, event_type, count(*) as n from events group by 1, 2, 3)
    select user_id, framing, cast(sum(n) as bigint) as runs, count(*) as outcomes, min_by(event_type, {'n': -n, 't': event_type}) as modal_outcome,
           round(max(n) / sum(n), 9) as modal_share, count(*) = 1 as stable from c group by 1, 2""")
def d10(spark, d):
    runs = load(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("framing"), "event_type")
    return rounded(ops.framing_stability(runs, ["user_id", "framing"], "event_type"), "modal_share")


def conversation_cases(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select(
        F.expr("concat(conv_id, '-', turn)").alias("case_id"), "role", F.expr("element_at(array('fast', 'deliberate', 'critical'), cast(conv_id % 3 as int) + 1)").alias("mode"),
        F.expr("array(role, concat('turn ', turn))").alias("must"), F.array(F.substring("text", 1, 12)).alias("must_not"))


MODES = "list_extract(['fast', 'deliberate', 'critical'], cast(conv_id % 3 as int) + 1)"


@R.add("d11_eval_inventory", f"select role, {MODES} as mode, count(*) as cases from conversations group by 1, 2")
def d11(spark, d):
    return ops.eval_inventory(conversation_cases(spark, d), "role", "mode")


@R.add("d11_checklist", f"""
    select conv_id || '-' || turn as case_id, conv_id || '-' || turn || ' [' || {MODES} || '] must: ' || role || '; turn ' || turn
           || ' | must not: ' || substr(text, 1, 12) as line from conversations""")
def d11_checklist(spark, d):
    return ops.checklist(conversation_cases(spark, d)).select("case_id", "line")


@R.add("d12_score_disagreement", """
    select l_partkey % 500 as item, l_linenumber as criterion, min(l_quantity % 5 + 1) as lowest, max(l_quantity % 5 + 1) as highest, count(*) as scores
    from lineitem group by 1, 2 having max(l_quantity % 5) - min(l_quantity % 5) >= 3""")
def d12(spark, d):
    scores = load(spark, d, "lineitem").select(
        (F.col("l_partkey") % 500).alias("item"), F.col("l_linenumber").alias("criterion"), (F.col("l_quantity") % 5 + 1).alias("score"))
    return ops.score_disagreement(scores, ["item", "criterion"], "score", 3)


@R.add("d13_findability_summary", """
    with m as (select *, first_value(case when event_type = 'purchase' then epoch_us(ts) end ignore nulls)
                         over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as nxt from events),
    t as (select event_type, nxt - epoch_us(ts) as gap, event_id % 5 as bad, event_id % 3 = 0 as again from m where nxt is not null),
    g as (select event_type, count(*) as n, cast(sum(bad) as bigint) as bad, avg(case when again then 1 else 0 end) as share, quantile_cont(gap, 0.5) as mid from t group by 1),
    c as (select distinct event_type from events union select r_name from region)
    select event_type, coalesce(n, 0) as sample, coalesce(bad, 0) as incorrect, coalesce(round(share, 9), -1) as refind_share,
           coalesce(round(mid, 3), -1) as median_time, case when n > 0 then 'directional evidence' else 'no evidence' end as evidence
    from c left join g using (event_type)""")
def d13(spark, d):
    return findability(spark, d, F.col("_next").isNotNull()).drop("failed")


@R.add("d13_findability_all", """
    with m as (select *, first_value(case when event_type = 'purchase' then epoch_us(ts) end ignore nulls)
                         over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as nxt from events),
    t as (select event_type, nxt - epoch_us(ts) as gap, event_id % 5 as bad, event_id % 3 = 0 as again from m),
    g as (select event_type, count(*) as n, count(*) - count(gap) as failed, cast(sum(bad) as bigint) as bad, avg(case when again then 1 else 0 end) as share,
                 quantile_cont(gap, 0.5) as mid from t group by 1),
    c as (select distinct event_type from events union select r_name from region)
    select event_type, coalesce(n, 0) as sample, coalesce(failed, 0) as failed, coalesce(bad, 0) as incorrect, coalesce(round(share, 9), -1) as refind_share,
           coalesce(round(mid, 3), -1) as median_time, case when n > 0 then 'directional evidence' else 'no evidence' end as evidence
    from c left join g using (event_type)""")
def d13_all(spark, d):
    return findability(spark, d, F.lit(True))


def findability(spark: SparkSession, d: str, taken: Column) -> DataFrame:
    ev = load(spark, d, "events").select("user_id", "event_id", "event_type", micros().alias("us"))
    marked = ev.withColumn("_buy", F.when(F.col("event_type") == "purchase", F.col("us")))
    seq = scan(ordered(marked, ["user_id"], ["us", "event_id"]), after_valid={"_next": "_buy"}).plain()
    trials = seq.where(taken).select(
        "event_type", (F.col("_next") - F.col("us")).alias("time_to_find"), (F.col("event_id") % 5).alias("incorrect"), (F.col("event_id") % 3 == 0).alias("refound"))
    known = ev.select("event_type").distinct().union(load(spark, d, "region").select("r_name"))
    out = ops.findability_summary(known, trials, "event_type")
    return out.withColumn("refind_share", F.round(F.coalesce("refind_share", F.lit(-1.0)), 9)).withColumn(
        "median_time", F.round(F.coalesce("median_time", F.lit(-1.0)), 3))


@R.add("d14_signal_shift", """
    with s as (select event_type as surface, case when event_id % 2 = 0 then 'mis-taps' else 'sentiment' end as signal, cast(round(value * 100) as bigint) as v,
                      ts < timestamp '2024-01-16' as base from events),
    g as (select surface, signal, avg(v) filter (base) as a, avg(v) filter (not base) as b, count(*) filter (base) as baseline_n,
                 count(*) filter (not base) as observed_n from s group by 1, 2)
    select surface, signal, round(a, 6) as baseline, round(b, 6) as observed, baseline_n, observed_n, round(b - a, 6) as shift from g""")
def d14(spark, d):
    rows = load(spark, d, "events").select(
        F.col("event_type").alias("surface"), F.expr("if(event_id % 2 = 0, 'mis-taps', 'sentiment')").alias("signal"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"), (F.col("ts") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")).alias("base"))
    out = ops.signal_shift(rows, ["surface", "signal"], "v", F.col("base"))
    return out.withColumns({c: F.round(c, 6) for c in ("baseline", "observed", "shift")})
