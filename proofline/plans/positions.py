"""Rectangles, rasters and ordered positions over lineitem, embeddings, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import geometry as geo, positions as ops
from proofline.operators.sequence import numbered, ordered, scan
from proofline.plans.motion import PLANES, planes
from proofline.plans.registry import Registry
from proofline.plans.tracks import micros
from proofline.session import load

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def rectangles(spark: SparkSession, d: str):
    rects = load(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("clip"), "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_partkey") % 500).alias("left"), (F.col("l_orderkey") % 300).alias("top"),
        F.col("l_quantity").cast("bigint").alias("width"), (F.col("l_linenumber") * 5).cast("bigint").alias("height"))
    s = F.col("s_suppkey")
    suppliers = load(spark, d, "supplier")
    regions = suppliers.select(s.alias("clip"), (s * 7 % 400).alias("left"), (s * 3 % 200).alias("top"),
                               F.lit(60).cast("bigint").alias("width"), F.lit(40).cast("bigint").alias("height")).union(
        suppliers.select(s, (s * 11 % 450), (s * 5 % 250), F.lit(30).cast("bigint"), F.lit(90).cast("bigint")))
    reviews = suppliers.select(s.alias("clip"), F.expr("if(s_suppkey % 9 = 0, 'ambiguous', 'detected')").alias("status"))
    return rects, regions, reviews


OVERLAP = """
    with c as (select l_suppkey as clip, l_orderkey, l_linenumber, l_partkey, l_partkey % 500 as l, l_orderkey % 300 as t,
                      l_partkey % 500 + cast(l_quantity as bigint) as r, l_orderkey % 300 + l_linenumber * 5 as b from lineitem),
    g as (select s_suppkey as clip, s_suppkey * 7 % 400 as l, s_suppkey * 3 % 200 as t, s_suppkey * 7 % 400 + 60 as r, s_suppkey * 3 % 200 + 40 as b from supplier
          union all select s_suppkey, s_suppkey * 11 % 450, s_suppkey * 5 % 250, s_suppkey * 11 % 450 + 30, s_suppkey * 5 % 250 + 90 from supplier),
    m as (select c.*, exists (select 1 from g where g.clip = c.clip and c.l < g.r and c.r > g.l and c.t < g.b and c.b > g.t) as in_scope from c)"""


@R.add("c09_region_overlap", OVERLAP + "select clip, l_orderkey, l_linenumber, l_partkey, in_scope from m")
def c09(spark, d):
    rects, regions, _ = rectangles(spark, d)
    return geo.region_overlap(rects, regions, "clip", ["l_orderkey", "l_linenumber", "l_partkey", "width"]).select(
        "clip", "l_orderkey", "l_linenumber", "l_partkey", "in_scope")


@R.add("c09_scoped_review", OVERLAP + """
    select s_suppkey as clip, case when s_suppkey % 9 = 0 then 'ambiguous' when count(*) filter (in_scope) > 0 then 'detected' else 'clear' end as status,
           case when s_suppkey % 9 = 0 then count(clip) else count(*) filter (in_scope) end as candidates,
           case when s_suppkey % 9 = 0 then 0 else count(*) filter (not in_scope) end as ignored
    from supplier left join m on clip = s_suppkey group by s_suppkey""")
def c09_review(spark, d):
    rects, regions, reviews = rectangles(spark, d)
    marked = geo.region_overlap(rects, regions, "clip", ["l_orderkey", "l_linenumber", "l_partkey", "width"])
    return geo.scoped_review(reviews, marked, "clip")


@R.add("c10_nearest_timestamp", """
    with e as (select event_type, event_id, epoch_us(ts) as t from events),
    a as (select distinct event_type, (t // 3600000000) * 3600000000 as ask from e)
    select a.event_type, ask, min_by(event_id, {'d': abs(t - ask), 't': t, 'i': event_id}) as event_id, min(abs(t - ask)) as distance
    from a join e using (event_type) group by 1, 2""")
def c10(spark, d):
    ev = load(spark, d, "events").select("event_type", "event_id", micros().alias("t"))
    asks = ev.select("event_type", (F.expr("div(t, 3600000000)") * 3_600_000_000).alias("ask")).distinct()
    return ops.nearest_timestamp(ev, asks, ["event_type"], "event_id", "t", "ask")


@R.add("c11_bracket_lookup", """
    with m as (select user_id, event_id, ts, case when event_type = 'purchase' then event_id end as k from events),
    b as (select *, last_value(k ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as p,
                 first_value(k ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as n from m),
    e as (select user_id, min_by(k, {'t': ts, 'i': event_id}) as f, max_by(k, {'t': ts, 'i': event_id}) as l from m where k is not null group by 1)
    select b.user_id, event_id, coalesce(p, case when b.user_id % 2 = 0 then l end, -1) as previous_keyframe,
           coalesce(n, case when b.user_id % 2 = 0 then f end, -1) as next_keyframe
    from b left join e using (user_id) where k is null""")
def c11(spark, d):
    ev = load(spark, d, "events").select("user_id", "event_id", micros().alias("us"), "event_type", (F.col("user_id") % 2 == 0).alias("loop"))
    out = ops.bracket_lookup(ev, "user_id", ["us", "event_id"], "event_id", F.col("event_type") == "purchase", "loop")
    return out.select("user_id", "event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous_keyframe", "next_keyframe")])


GEOMETRY = PLANES.replace("abs(z) * 1020", "greatest(abs(z) * 1020 - 130, 0)") + """,
    px as (select clip, vec_id, i - 1 as i, (i - 1) % 8 as x, (i - 1) // 8 as y, a[i] as v from p, range(1, 65) as r(i)),
    ge as (select clip, vec_id, count(*) filter (v > 0) as area, min(x) filter (v > 0) as l, min(y) filter (v > 0) as t,
                  max(x) filter (v > 0) + 1 as r, max(y) filter (v > 0) + 1 as b,
                  round(avg(x) filter (v > 0), 6) as cx, round(avg(y) filter (v > 0), 6) as cy,
                  round(sum(x * v) / sum(v), 6) as wx, round(sum(y * v) / sum(v), 6) as wy,
                  count(*) filter (v = 255) as opaque, count(*) filter (v > 0 and v < 255) as partial
           from px group by 1, 2)"""


def sparse_planes(spark: SparkSession, d: str) -> DataFrame:
    """8x8 planes with an empty background, so boxes and margins vary."""
    alpha = F.transform("embedding", lambda v: F.floor(F.least(
        F.lit(255.0), F.greatest(F.abs(v.cast("double")) * 1020 - 130, F.lit(0.0)))).cast("int"))
    return load(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("clip"), "vec_id", alpha.alias("alpha"))


@R.add("c12_centroid_step_gate", GEOMETRY + """,
    w as (select clip, vec_id, case when vec_id % 50 <> 7 then cx end as x, case when vec_id % 50 <> 7 then cy end as y from ge),
    s as (select *, lag(vec_id) over z as i, lag(x) over z as px, lag(y) over z as py from w window z as (partition by clip order by vec_id))
    select clip, vec_id, coalesce(round(case when x is not null and px is not null then greatest(abs(x - px), abs(y - py)) end, 6), -1) as step,
           case when x is null or px is null then 'no visible content' else 'step too large' end as reason
    from s where i is not null and (x is null or px is null or greatest(abs(x - px), abs(y - py)) > 1.2)""")
def c12(spark, d):
    frames = geo.frame_geometry(sparse_planes(spark, d), "alpha", 8)
    blank = F.col("vec_id") % 50 == 7
    metrics = frames.select("clip", "vec_id", F.when(~blank, F.col("centroid_x")).alias("x"), F.when(~blank, F.col("centroid_y")).alias("y"))
    out = geo.centroid_step_gate(metrics, "clip", "vec_id", "x", "y", 1.2)
    return out.withColumn("step", F.round(F.coalesce("step", F.lit(-1.0)), 6))


@R.add("c13_frame_geometry", GEOMETRY + """
    select clip, vec_id, area, l as "left", t as top, r as "right", b as bottom, cx as centroid_x, cy as centroid_y, wx as weighted_x,
           wy as weighted_y, opaque, partial, least(l, t, 8 - r, 8 - b) as margin, round(cx - 4, 6) as offset_x, round(cy - 6, 6) as offset_y
    from ge""")
def c13(spark, d):
    return geo.frame_geometry(sparse_planes(spark, d), "alpha", 8, (4, 6)).drop("alpha")


@R.add("c14_safe_bounds_audit", GEOMETRY + """
    select clip, vec_id, count(*) filter (v > 0 and x < 1) as left_pixels, count(*) filter (v > 0 and y < 2) as top_pixels,
           count(*) filter (v > 0 and x >= 6) as right_pixels, count(*) filter (v > 0 and y >= 7) as bottom_pixels,
           concat_ws(',', case when bool_or(v > 0 and x = 0) then 'left' end, case when bool_or(v > 0 and y = 0) then 'top' end,
                          case when bool_or(v > 0 and x = 7) then 'right' end, case when bool_or(v > 0 and y = 7) then 'bottom' end) as clipped_edges
    from px group by 1, 2""")
def c14(spark, d):
    return geo.safe_bounds_audit(sparse_planes(spark, d), "alpha", 8, (1, 2, 6, 7)).drop("alpha")


@R.add("c15_raster_diff", PLANES + """,
    w as (select clip, vec_id, a, lag(a) over (partition by clip order by vec_id) as b from p)
    select clip, vec_id, len(list_filter(range(1, 65), lambda i: a[i] <> b[i])) as changed,
           cast(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) as bigint) as absolute_difference
    from w where b is not null""")
def c15(spark, d):
    return geo.raster_diff(planes(spark, d), "clip", "vec_id", "alpha")


@R.add("c16_edge_residue", GEOMETRY + """
    select clip, vec_id,
      round((count(*) filter (v > 8 and x = 0) + count(*) filter (v > 8 and x = 7) + count(*) filter (v > 8 and y = 0)
       + count(*) filter (v > 8 and y = 7)) / 32, 9) as residue_rate,
      coalesce(least(min(x) filter (v >= 128), min(y) filter (v >= 128), 7 - max(x) filter (v >= 128), 7 - max(y) filter (v >= 128)) < 2, true) as clipped,
      count(*) filter (v = 0 and i % 3 = vec_id % 3) as hidden_colour
    from px group by 1, 2""")
def c16(spark, d):
    tinted = sparse_planes(spark, d).withColumn("colour", F.transform(
        "alpha", lambda v, i: F.when(i % 3 == F.col("vec_id") % 3, 9).otherwise(0)))
    out = geo.edge_residue(tinted, "alpha", "colour", 8, 0.5)
    return out.select("clip", "vec_id", F.round("residue_rate", 9).alias("residue_rate"), "clipped", "hidden_colour")


ALIAS = """
    with n as (select user_id as clip, event_id, row_number() over w as idx, event_id % 4 = 0 as is_alias,
                      case when event_id % 3 = 0 then lead(event_id) over w when event_id % 20 = 4 then -1 else lag(event_id) over w end as target
               from events window w as (partition by user_id order by ts, event_id)),
    e as (select clip, max(idx) as last from n group by 1)"""


@R.add("c17_alias_resolution", ALIAS + """,
    r as (select n.clip, n.event_id, concat_ws('; ', case when c.idx is null then 'no such concrete position' end,
        case when c.idx >= n.idx then 'not earlier' end, case when n.event_id % 28 = 0 then 'unknown kind' end,
        case when n.event_id % 28 <> 0 and n.event_id % 8 = 0 and not (n.clip % 2 = 0 and n.idx = e.last) then 'closing must end a loop' end) as reasons
      from n join e on e.clip = n.clip left join n c on c.clip = n.clip and c.event_id = n.target and not c.is_alias where n.is_alias)
    select * from r where reasons <> ''""")
def c17(spark, d):
    ev = load(spark, d, "events").select(F.col("user_id").alias("clip"), "event_id", micros().alias("us"))
    seq = scan(ordered(ev, ["clip"], ["us", "event_id"]), prev={"_p": "event_id"}, next={"_n": "event_id"})
    rows = numbered(seq, "index").plain()
    target = F.when(F.col("event_id") % 3 == 0, F.col("_n")).when(F.col("event_id") % 20 == 4, F.lit(-1)).otherwise(F.col("_p"))
    positions = rows.select(
        "clip", "index", "event_id", F.concat(F.lit("p"), F.col("event_id")).alias("id"),
        F.expr("if(event_id % 4 = 0, 'alias', 'keyframe')").alias("role"), F.concat(F.lit("p"), target).alias("alias_of"),
        F.expr("case when event_id % 28 = 0 then 'skip' when event_id % 8 = 0 then 'closing' else 'hold' end").alias("alias_kind"),
        (F.col("clip") % 2 == 0).alias("loop"))
    return ops.alias_resolution(positions, "clip").select("clip", "event_id", F.array_join("reasons", "; ").alias("reasons"))


@R.add("c18_running_offset", """
    with c as (select conv_id % 5 as package, conv_id as clip, count(*) as n from conversations group by 2)
    select package, clip, n, cast(coalesce(sum(n) over (partition by package order by clip rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
    from c""")
def c18(spark, d):
    clips = load(spark, d, "conversations").groupBy(F.col("conv_id").alias("clip")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "package", F.col("clip") % 5)
    return ops.running_offset(clips, "package", "clip", "n")


@R.add("c19_grid_position", """
    with p as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part),
    g as (select *, ceil(n / 7.0)::bigint as rows_, right(p_brand, 1) in ('0', '2', '4', '6', '8') as cm from p)
    select p_brand, p_partkey, case when cm then i // rows_ else i % 7 end as "column", case when cm then i % rows_ else i // 7 end as "row" from g
    union all
    select p_brand, -1, s // 1, -1 from (select distinct p_brand, n, rows_ from g), lateral (select unnest(range(n, rows_ * 7)) as s)""")
def c19(spark, d):
    parts = numbered(ordered(load(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"]), "rn", size="n").plain()
    rows = F.ceil(F.col("n") / 7)
    major = F.col("p_brand").rlike("[02468]$")
    placed = ops.grid_position(parts.withColumn("i", F.col("rn") - 1), "i", F.lit(7), rows, major)
    empty = ops.unused_slots(parts.select("p_brand", "n").distinct(), "p_brand", "n", 7)
    minus = F.lit(-1).cast("bigint")
    return placed.select("p_brand", "p_partkey", "column", "row").union(empty.select("p_brand", minus, "slot", minus))


@R.add("c20_event_positions", r"""
    with c as (select conv_id, count(*) as n from conversations group by 1),
    l as (select conv_id, turn + case when conv_id % 6 = 0 then 100 else 0 end as position, string_split(text, chr(10)) as parts from conversations)
    select conv_id, position, i - 1 as ordinal, parts[i] as name, position < n as in_range
    from (select conv_id, position, parts, unnest(range(1, len(parts) + 1)) as i from l) join c using (conv_id)""")
def c20(spark, d):
    turns = load(spark, d, "conversations")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("positions"))
    plan = turns.select("conv_id", F.expr("turn + if(conv_id % 6 = 0, 100, 0)").alias("position"), F.split("text", "\n").alias("events"))
    return ops.event_positions(plan, "conv_id", "position", "events", counts).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@R.add("c21_duration_audit", """
    with e as (select user_id, case when event_id % 40 = 0 then null when event_id % 90 = 1 then 0 else cast(round(value * 100) as bigint) end as ms from events),
    g as (select user_id, count(ms) as durations, count(*) as positions, count(*) filter (ms < 1) as bad, count(*) filter (ms > 20000) as long_,
                 cast(sum(ms) as bigint) as measured_ms, cast(sum(ms) as bigint) + case when user_id % 10 = 0 then 1 else 0 end as total_ms from e group by 1)
    select user_id, durations, measured_ms, concat_ws('; ', case when durations <> positions then 'one duration per position' end,
        case when bad > 0 then 'not positive' end, case when long_ > 0 then 'too long' end,
        case when measured_ms <> total_ms then 'total not preserved' end) as reasons from g""")
def c21(spark, d):
    rows = load(spark, d, "events").select("user_id", F.expr(
        "case when event_id % 40 = 0 then null when event_id % 90 = 1 then 0 else cast(round(value * 100) as bigint) end").alias("ms"))
    clips = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("positions"), F.sum("ms").alias("total_ms")).withColumn(
        "total_ms", F.expr("total_ms + if(user_id % 10 = 0, 1, 0)"))
    out = ops.duration_audit(rows, clips, "user_id", "ms", 20_000)
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@R.add("c22_role_topology", """
    with r as (select user_id, event_id, ts, case event_type when 'purchase' then 'keyframe' when 'error' then 'alias' else 'in-between' end as role from events),
    k as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as o from r where role = 'keyframe'),
    a as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as o from r
          where role = 'keyframe' and not (user_id % 8 = 0 and event_id % 6 = 0)),
    m as (select coalesce(k.user_id, a.user_id) as user_id, count(*) as n from k full join a on k.user_id = a.user_id and k.o = a.o
          where k.event_id is distinct from a.event_id group by 1),
    g as (select user_id, count(*) filter (role = 'keyframe') as keyframes, count(*) filter (role = 'in-between') as in_betweens,
                 count(*) filter (role <> 'alias') as concrete from r group by 1)
    select g.*, coalesce(n, 0) as moved_keyframes, concat_ws('; ', case when keyframes < 2 then 'at least two keyframes' end,
       case when in_betweens < 2 then 'at least two in-betweens' end, case when concrete < 1 then 'a concrete position' end,
       case when n > 0 then 'approved keyframe order' end) as reasons from g left join m using (user_id)""")
def c22(spark, d):
    rows = load(spark, d, "events").select(
        "user_id", F.col("event_id").alias("id"), micros().alias("us"),
        F.expr("case event_type when 'purchase' then 'keyframe' when 'error' then 'alias' else 'in-between' end").alias("role"))
    kept = rows.where("role = 'keyframe' and not (user_id % 8 = 0 and id % 6 = 0)").select("user_id", "us", "id")
    approved = numbered(ordered(kept, ["user_id"], ["us", "id"]), "ordinal").plain()
    out = ops.role_topology(rows, approved, "user_id", ["us", "id"])
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@R.add("c23_region_persistence", """
    with e as (select user_id % 10 as clip, event_type as region, epoch_us(ts) // 3600000000 as frame, cast(round(value * 100) as bigint) as area from events),
    f as (select clip, count(distinct frame) as n from e group by 1),
    w as (select clip, max(area) as big from e where region = 'view' group by 1)
    select e.clip, region, min(frame) as first_frame, max(frame) as last_frame, count(distinct frame) as frame_count,
           round(count(distinct frame) / any_value(n), 9) as frame_coverage, round(max(area) / any_value(big), 9) as area_ratio
    from e join f using (clip) left join w using (clip) group by 1, 2""")
def c23(spark, d):
    rows = load(spark, d, "events").select(
        (F.col("user_id") % 10).alias("clip"), F.col("event_type").alias("region"), F.expr(
            "div(unix_micros(cast(ts as timestamp)), 3600000000)").alias("frame"), F.expr("cast(round(value * 100) as bigint)").alias("area"))
    out = geo.region_persistence(rows, rows, rows.where("region = 'view'"), "clip", "region")
    return out.withColumn("frame_coverage", F.round("frame_coverage", 9)).withColumn("area_ratio", F.round("area_ratio", 9))


@R.add("c24_dominant_bin", """
    with s as (select l_returnflag as flag, l_linestatus as status_, cast(case when l_suppkey % 10 = 0 then l_quantity else l_quantity / 10 end as bigint) as a,
                      cast(round(l_discount * 100) as bigint) as b, cast(round(l_tax * 100) as bigint) as c from lineitem),
    q as (select *, floor(a / 6.0) as ba, floor(b / 6.0) as bb, floor(c / 6.0) as bc from s),
    g as (select flag, ba, bb, bc, count(*) as n, avg(a) as sa, avg(b) as sb, avg(c) as sc from q group by 1, 2, 3, 4),
    w as (select * from g qualify row_number() over (partition by flag order by n desc, ba, bb, bc) = 1),
    j as (select q.*, w.n as bin_count, sqrt((a - sa) * (a - sa) + (b - sb) * (b - sb) + (c - sc) * (c - sc)) <= 20 * 0.55 as inside from q join w using (flag)),
    ce as (select flag, count(*) as samples, count(*) filter (inside) as members, any_value(bin_count) as bin_count,
                  avg(a) filter (inside) as ca, avg(b) filter (inside) as cb, avg(c) filter (inside) as cc from j group by 1),
    di as (select s.flag, sqrt((a - ca) * (a - ca) + (b - cb) * (b - cb) + (c - cc) * (c - cc)) as dist from s join ce using (flag)),
    fi as (select flag, avg(case when dist <= 20 then 1 else 0 end) as confidence, quantile_cont(dist, 0.95) as residual_p95 from di group by 1)
    select flag, samples, members, bin_count, round(ca, 6) as centre_a, round(cb, 6) as centre_b, round(cc, 6) as centre_c,
           round(confidence, 6) as confidence, round(residual_p95, 6) as residual_p95,
           case when members >= greatest(16, floor(samples * 0.8)) then 'OK' else 'UNSUPPORTED_BACKGROUND' end as status
    from ce join fi using (flag)""")
def c24(spark, d):
    rows = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.expr("if(l_suppkey % 10 = 0, l_quantity, l_quantity / 10)").alias("q"),
        F.expr("cast(round(l_discount * 100) as bigint)").alias("b"), F.expr("cast(round(l_tax * 100) as bigint)").alias("c"))
    rows = rows.withColumn("a", F.bround("q").cast("bigint"))
    out = geo.dominant_bin(rows, ["flag"], ["a", "b", "c"], 20.0)
    return out.select("flag", "samples", "members", "bin_count", "status", *[
        F.round(c, 6).alias(c) for c in ("centre_a", "centre_b", "centre_c", "confidence", "residual_p95")])


@R.add("c25_nearest_center", PLANES + """,
    u as (select clip, i, avg(f[i]) as m from v, range(1, 65) as r(i) group by 1, 2),
    ce as (select clip as center_id, list(round(m, 9) order by i) as c from u group by 1),
    di as (select vec_id, center_id, list_sum(list_transform(range(1, 65), lambda i: (f[i] - c[i]) * (f[i] - c[i]))) as d from v, ce)
    select vec_id, min_by(center_id, {'d': d, 'c': center_id}) as center_id, round(sqrt(min(d)), 9) as distance from di group by 1""")
def c25(spark, d):
    points = load(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("clip"), F.col("embedding").cast("array<double>").alias("f"))
    # means element by element; each label ends as one array of 64 values
    cells = points.select("clip", F.posexplode("f").alias("i", "x")).groupBy("clip", "i").agg(F.round(F.avg("x"), 9).alias("m"))
    centers = cells.groupBy(F.col("clip").alias("center_id")).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_c")).select(
        "center_id", F.transform("_c", lambda s: s["m"]).alias("center"))
    out = geo.nearest_center(points.select("vec_id", "f"), centers, "vec_id", "f")
    return out.withColumn("distance", F.round("distance", 9))


@R.add("c26_palette_consensus", """
    with s as (select l_suppkey % 20 as clip, l_linenumber as frame, cast(l_quantity as bigint) * 4 as r,
                      cast(round(l_discount * 100) as bigint) * 5 as g, cast(round(l_tax * 100) as bigint) * case when l_suppkey % 20 = 4 then l_linenumber * 3 else 5 end as b
               from lineitem),
    y as (select *, 0.0::double + r * 0.2126::double + g * 0.7152::double + b * 0.0722::double as y from s),
    c as (select clip, frame, count(*) as n, quantile_cont(y, 0.30) as cut from y group by 1, 2),
    d as (select y.* from y join c using (clip, frame) where y.y <= cut),
    e as (select clip, frame, median(r) as r, median(g) as g, median(b) as b from d group by 1, 2),
    m as (select clip, greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) as widest_spread,
                 cast(round_even(median(r), 0) as bigint) as r, cast(round_even(median(g), 0) as bigint) as g, cast(round_even(median(b), 0) as bigint) as b from e group by 1),
    f as (select clip, min(n) as fewest_samples from c group by 1)
    select m.*, fewest_samples, round(sqrt((r - 40.0) * (r - 40.0) + (g - 20.0) * (g - 20.0) + (b - 15.0) * (b - 15.0)), 6) as distance,
           case when fewest_samples < 16 or widest_spread > 24 then 'OUTLINE_COLOR_UNCERTAIN'
                when sqrt((r - 40.0) * (r - 40.0) + (g - 20.0) * (g - 20.0) + (b - 15.0) * (b - 15.0)) > 12 then 'OUTLINE_COLOR_MISMATCH' else 'OK' end as status
    from m join f using (clip)""")
def c26(spark, d):
    rows = load(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("clip"), F.col("l_linenumber").alias("frame"), (F.col("l_quantity").cast("bigint") * 4).alias("r"),
        (F.expr("cast(round(l_discount * 100) as bigint)") * 5).alias("g"),
        F.expr("cast(round(l_tax * 100) as bigint) * if(l_suppkey % 20 = 4, l_linenumber * 3, 5)").alias("b"))
    out = geo.palette_consensus(rows, "clip", "frame", ["r", "g", "b"], (40.0, 20.0, 15.0), 12.0)
    return out.withColumn("distance", F.round("distance", 6))
