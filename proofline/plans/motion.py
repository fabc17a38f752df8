"""Frame-sequence queries: embeddings of one label stand in for the frames of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import motion as ops
from proofline.operators.sequence import numbered, ordered, union_all
from proofline.plans.registry import Registry
from proofline.plans.tracks import micros
from proofline.session import load

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("clip"), "vec_id", F.col("embedding").cast("array<double>").alias("feature"))


def planes(spark: SparkSession, d: str) -> DataFrame:
    """8x8 planes of 0..255 scaled from the vectors."""
    alpha = F.transform("feature", lambda v: F.floor(F.least(F.lit(255.0), F.abs(v) * 1020)).cast("int"))
    return vectors(spark, d).select("clip", "vec_id", alpha.alias("alpha"))


VECTORS = """
    with v as (select cast(label as bigint) as clip, vec_id, list_transform(embedding, lambda z: cast(z as double)) as f from embeddings)"""
PLANES = VECTORS + """,
    p as (select clip, vec_id, list_transform(f, lambda z: cast(floor(least(255.0, abs(z) * 1020)) as integer)) as a from v)"""


def delta_sql(source: str, keys: str, order: str) -> str:
    """Pair metrics between array columns ``x`` (left) and ``y`` (right) of ``source``."""
    return f"""
      select {keys}, {order},
        list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))) / (len(x) * 255.0) as mean_alpha_difference,
        case when len(list_filter(range(1, len(x) + 1), lambda i: x[i] >= 128 or y[i] >= 128)) = 0 then 0.0 else
          len(list_filter(range(1, len(x) + 1), lambda i: (x[i] >= 128) <> (y[i] >= 128)))
          / len(list_filter(range(1, len(x) + 1), lambda i: x[i] >= 128 or y[i] >= 128)) end as contour_change_ratio,
        (abs(list_sum(x) - list_sum(y)) / 255.0) / greatest((list_sum(x) + list_sum(y)) / 510.0, 1.0) as area_change_ratio
      from {source}"""


PAIRS = PLANES + """,
    nb as (select clip, lag(vec_id) over w as from_frame, vec_id as to_frame, false as is_loop, lag(a) over w as x, a as y
           from p window w as (partition by clip order by vec_id)),
    nbd as (""" + delta_sql("nb where from_frame is not null", "clip, from_frame, to_frame", "is_loop") + """),
    lp as (select clip, max(vec_id) as from_frame, min(vec_id) as to_frame, true as is_loop,
                  max_by(a, vec_id) as x, min_by(a, vec_id) as y from p group by 1),
    lpd as (""" + delta_sql("lp", "clip, from_frame, to_frame", "is_loop") + ")"

ROUNDED = ", ".join(f"round({m}, 9) as {m}" for m in ops.DELTAS)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(m, 9).alias(m) for m in ops.DELTAS])


@R.add("c01_timing_repair", """
    with s as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, epoch_us(ts) / 1e6 as t,
                      case when event_id % 3 = 0 then value else 0.0 end as dur, ts, event_id from events),
    n as (select user_id, count(*) as n, count(*) + case when user_id % 7 = 0 then 2 else 0 end as decoded,
                 case when user_id % 30 = 0 then 1 / 24.0 else 1.0 / (user_id % 30) end as fb from events group by 1),
    k as (select s.*, lead(t) over (partition by s.user_id order by i) as nx, fb from s join n using (user_id) where decoded = n)
    select user_id, i as idx, round(t, 6) as "timestamp",
           round(case when dur > 0 then dur when nx is null then fb else greatest(nx - t, fb) end, 6) as duration, false as synthetic from k
    union all
    select user_id, r.i, round(r.i * fb, 6), round(fb, 6), true from n, lateral (select unnest(range(decoded)) as i) r where decoded <> n""")
def c01(spark, d):
    ev = load(spark, d, "events").select("user_id", "event_id", micros().alias("us"), "value")
    stamps = numbered(ordered(ev, ["user_id"], ["us", "event_id"]), "rn").plain().select(
        "user_id", (F.col("rn") - 1).alias("idx"), (F.col("us") / 1e6).alias("timestamp"),
        F.expr("if(event_id % 3 = 0, value, 0.0D)").alias("duration"))
    clips = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.expr("n + if(user_id % 7 = 0, 2, 0)").alias("decoded"), (F.col("user_id") % 30).cast("double").alias("fps"))
    out = ops.timing_repair(stamps, clips, "user_id", "idx")
    return out.select("user_id", "idx", "synthetic", *[F.round(c, 6).alias(c) for c in ("timestamp", "duration")])


@R.add("c02_step_motion", VECTORS + """,
    s as (select clip, vec_id, f, lag(f) over (partition by clip order by vec_id) as g from v),
    m as (select clip, vec_id, list_sum(list_transform(range(1, len(f) + 1), lambda i: abs(f[i] - g[i]))) / len(f) as step
          from s where g is not null),
    t as (select clip, greatest(quantile_cont(step, 0.5), 1e-6) as typical from m group by 1)
    select clip, vec_id, round(step, 9) as step, round(typical, 9) as typical_motion from m join t using (clip)""")
def c02(spark, d):
    steps = ops.step_motion(vectors(spark, d), "clip", "vec_id", "feature")
    return steps.join(ops.typical_motion(steps, "clip"), "clip").select(
        "clip", "vec_id", F.round("step", 9).alias("step"), F.round("typical_motion", 9).alias("typical_motion"))


@R.add("c03_pair_deltas", PAIRS + f"select clip, from_frame, to_frame, is_loop, {ROUNDED} from nbd")
def c03(spark, d):
    return rounded(ops.pair_deltas(planes(spark, d), "clip", "vec_id", "alpha"), "clip", "from_frame", "to_frame", "is_loop")


@R.add("c04_loop_pair", PAIRS + f"select clip, from_frame, to_frame, is_loop, {ROUNDED} from lpd")
def c04(spark, d):
    return rounded(ops.loop_pair(planes(spark, d), "clip", "vec_id", "alpha"), "clip", "from_frame", "to_frame", "is_loop")


CYCLES = VECTORS + """,
    q as (select clip, row_number() over (partition by clip order by vec_id) - 1 as i, count(*) over (partition by clip) as n, f from v),
    st as (select *, lag(f) over w as pf, lead(f) over w as nf from q window w as (partition by clip order by i)),
    sp as (select clip, i, n, f,
             coalesce(list_sum(list_transform(range(1, len(f) + 1), lambda k: abs(f[k] - nf[k]))) / len(f), 0) as so,
             coalesce(list_sum(list_transform(range(1, len(f) + 1), lambda k: abs(f[k] - pf[k]))) / len(f), 0) as si from st),
    ty as (select clip, greatest(quantile_cont(si, 0.5), 1e-6) as typical from sp where i > 0 group by 1),
    pa as (select sp.*, typical, coalesce(sum(so) over (partition by sp.clip order by i rows between unbounded preceding and 1 preceding), 0) as path,
                  greatest(3, least(8, n // 4)) as m from sp join ty using (clip)),
    pr as (select a.clip, a.i as s, b.i as e, b.i - a.i + 1 as cnt, a.n, a.typical,
                  list_sum(list_transform(range(1, len(a.f) + 1), lambda k: abs(a.f[k] - b.f[k]))) / len(a.f) as pose,
                  abs(a.so - b.si) as vel, (b.path - a.path) / (b.i - a.i) as energy
           from pa a join pa b on a.clip = b.clip and b.i >= a.i + a.m - 1),
    sc as (select *, pose + vel * 0.5 + greatest(0, typical * 0.25 - energy) * 4.0
                  + case when s = 0 or e = n - 1 then 0 else typical * 0.02 end as score from pr),
    rk as (select *, row_number() over (partition by clip order by score, cnt desc, s) as rn from sc)"""


def clip_statistics(spark: SparkSession, d: str) -> DataFrame:
    frames = numbered(ordered(vectors(spark, d), ["clip"], ["vec_id"]), "rn").plain().withColumn("i", F.col("rn") - 1)
    return ops.frame_statistics(frames, "clip", "i", "feature")


@R.add("c05_cycle_candidates", CYCLES + """
    select clip, s as start_frame, e as end_frame, cnt as frame_count, case when rn <= 100 then rn else 0 end as rank,
           round(pose, 9) as pose_distance, round(vel, 9) as velocity_distance, round(energy, 9) as motion_energy, round(score, 9) as score
    from rk where rn <= 100 or (s = 0 and e = n - 1)""")
def c05(spark, d):
    out = ops.cycle_candidates(clip_statistics(spark, d))
    return out.select("clip", "start_frame", "end_frame", "frame_count", F.col("rank").cast("bigint").alias("rank"), *[
        F.round(c, 9).alias(c) for c in ("pose_distance", "velocity_distance", "motion_energy", "score")])


@R.add("c06_cycle_select", CYCLES + """,
    top as (select * from rk where rn = 1),
    pick as (select t.clip, case when f.score <= t.score * 1.15 + 1e-6 then f.s else t.s end as s,
                    case when f.score <= t.score * 1.15 + 1e-6 then f.e else t.e end as e
             from top t left join rk f on f.clip = t.clip and f.s = 0 and f.e = f.n - 1),
    px as (select case when p.clip = 3 then 2 else p.s end as s, case when p.clip = 3 then 20 else p.e end as e, p.clip from pick p),
    ch as (select r.* from px join rk r using (clip, s, e)),
    al as (select ch.clip, min_by(r.score, r.rn) as rival from ch join rk r on r.clip = ch.clip
           where abs(r.s - ch.s) > 2 or abs(r.e - ch.e) > 2 group by 1)
    select clip, case when clip <> 3 and rival <= score * 1.01 and score > 1e-6 then 'AMBIGUOUS_CYCLE'
                      when energy <= 1e-6 then 'NO_COMPLETE_CYCLE' else 'OK' end as status,
           s as start_frame, e as end_frame, round(score, 9) as score
    from ch left join al using (clip)""")
def c06(spark, d):
    stats = clip_statistics(spark, d)
    asked = stats.where("clip = 3").select("clip", F.lit(2).cast("bigint").alias("start_frame"), F.lit(20).cast("bigint").alias("end_frame")).distinct()
    out = ops.cycle_select(ops.cycle_candidates(stats), stats, ops.explicit_cycles(stats, asked), asked)
    return out.withColumn("score", F.round("score", 9))


def doubled(spark: SparkSession, d: str) -> DataFrame:
    """Every plane twice in a row, the second copy off by at most one step in one cell."""
    base = planes(spark, d)
    nudged = F.transform("alpha", lambda v, k: F.when((k == 0) & (F.col("vec_id") % 4 == 0), F.abs(v - 1)).when(
        (k == 0) & (F.col("vec_id") % 4 == 1), (v + 200) % 256).otherwise(v))
    return union_all([
        base.select("clip", (F.col("vec_id") * 2).alias("frame"), "alpha", (F.col("vec_id") % 50 + 10).alias("ms")),
        base.select("clip", (F.col("vec_id") * 2 + 1).alias("frame"), nudged.alias("alpha"), F.lit(7).cast("bigint").alias("ms")),
    ])


@R.add("c07_collapse_near_duplicates", PLANES + """,
    u as (select clip, vec_id * 2 as frame, a, vec_id % 50 + 10 as ms from p
          union all
          select clip, vec_id * 2 + 1, list_transform(a, lambda z, k: case when k = 1 and vec_id % 4 = 0 then abs(z - 1)
              when k = 1 and vec_id % 4 = 1 then (z + 200) % 256 else z end), 7 from p),
    w as (select clip, frame, ms, lag(a) over x as x, a as y from u window x as (partition by clip order by frame)),
    g as (""" + delta_sql("w", "clip, frame, ms", "x is null as head") + """),
    r as (select clip, frame, ms, sum(case when not head and mean_alpha_difference <= 0.003 and contour_change_ratio <= 0.012
                 and area_change_ratio <= 0.003 then 0 else 1 end) over (partition by clip order by frame) as grp from g)
    select clip, cast(grp as bigint) as "group", min(frame) as first_frame, max(frame) as last_frame, count(*) as frames,
           cast(sum(ms) as bigint) as duration from r group by 1, 2""")
def c07(spark, d):
    return ops.collapse_near_duplicates(doubled(spark, d), "clip", "frame", "alpha", "ms")


FLASH = "case when vec_id % 61 = 0 then 255 else cast(floor(least(255.0, abs(z) * 1020)) as integer) end"


@R.add("c08_robust_outliers", PAIRS.replace("cast(floor(least(255.0, abs(z) * 1020)) as integer)", FLASH) + """,
    al as (select * from nbd union all select * from lpd),
    lg as (unpivot al on mean_alpha_difference, contour_change_ratio, area_change_ratio into name metric value v),
    md as (select clip, metric, quantile_cont(v, 0.5) as med from lg where not is_loop group by 1, 2),
    ma as (select lg.clip, lg.metric, any_value(med) as med, quantile_cont(abs(v - med), 0.5) * 1.4826 as sc
           from lg join md on lg.clip = md.clip and lg.metric = md.metric where not is_loop group by 1, 2)
    select lg.clip, from_frame, to_frame, is_loop, lg.metric, round(v, 9) as value, round(med, 9) as median, round(sc, 9) as robust_scale
    from lg join ma on lg.clip = ma.clip and lg.metric = ma.metric
    where case when sc <= 1e-12 then v > med + 1e-6 else (v - med) / sc > 6.0 end
      and v > case lg.metric when 'contour_change_ratio' then 0.040 else 0.015 end""")
def c08(spark, d):
    # a few fully lit frames leave the envelope of their clip
    frames = planes(spark, d).withColumn(
        "alpha", F.when(F.col("vec_id") % 61 == 0, F.transform("alpha", lambda v: F.lit(255))).otherwise(F.col("alpha")))
    pairs = ops.pair_deltas(frames, "clip", "vec_id", "alpha").unionByName(ops.loop_pair(frames, "clip", "vec_id", "alpha"))
    out = ops.robust_outliers(pairs, "clip")
    return out.select("clip", "from_frame", "to_frame", "is_loop", "metric",
                      *[F.round(c, 9).alias(c) for c in ("value", "median", "robust_scale")])


@R.add("c08_value_outliers", """
    with m as (select l_returnflag as flag, quantile_cont(l_extendedprice, 0.5) as med from lineitem group by 1),
    a as (select l_returnflag as flag, any_value(med) as med, quantile_cont(abs(l_extendedprice - med), 0.5) * 1.4826 as sc
          from lineitem join m on flag = l_returnflag group by 1),
    x as (select user_id, value, event_id, event_type from events),
    em as (select event_type, quantile_cont(value, 0.5) as med from x group by 1),
    ea as (select event_type, any_value(em.med) as med, quantile_cont(abs(value - em.med), 0.5) * 1.4826 as sc from x join em using (event_type) group by 1)
    select event_id as id, event_type as kind, value, round(med, 9) as median, round(sc, 9) as robust_scale from x join ea using (event_type)
    where (value - med) / sc > 6.0 and value > 0.015""")
def c08_values(spark, d):
    ev = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    envelope = ops.robust_envelope(ev, ["kind"], "value")
    out = ev.join(envelope, "kind").where(ops.beyond_envelope(F.col("value"), F.lit(0.015)))
    return out.select("id", "kind", "value", F.round("median", 9).alias("median"), F.round("robust_scale", 9).alias("robust_scale"))
