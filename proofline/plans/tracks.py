"""Track and stream inventory over events, documents, part, lineitem and pages.

The tables stand in for caption metadata; they prove the operators, not the media domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import language_matches, normalize_language
from proofline.operators import tracks as ops
from proofline.plans.registry import Registry
from proofline.session import load

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

FORMAT = "struct<ext:string,name:string,is_original:boolean,default:boolean>"


def micros(col: str = "ts"):
    return F.unix_micros(F.col(col).cast("timestamp"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an interval of ``value`` minutes, in integer microseconds."""
    length = F.round(F.col("value") * 100).cast("bigint") * 600_000
    return load(spark, d, "events").select(
        "event_id", "event_type", "user_id", micros().alias("start_us"), (micros() + length).alias("end_us")
    )


@R.add("a01_normalize_language", """
    with raw as (
      select doc_id, lang, '  ' || upper(lang) || '_' || upper(source) || ' ' as raw from documents)
    select doc_id, replace(lower(trim(raw)), '_', '-') as normalized,
           lang <> '' and split_part(replace(lower(trim(raw)), '_', '-'), '-', 1) = lang as same_language,
           split_part(replace(lower(trim(raw)), '_', '-'), '-', 1) = 'en' as is_english
    from raw""")
def a01(spark, d):
    raw = F.concat(F.lit("  "), F.upper("lang"), F.lit("_"), F.upper("source"), F.lit(" "))
    norm = normalize_language(raw)
    return load(spark, d, "documents").select(
        "doc_id", norm.alias("normalized"),
        language_matches(norm, normalize_language(F.col("lang"))).alias("same_language"),
        language_matches(norm, F.lit("en")).alias("is_english"),
    )


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Caption metadata derived from every document."""
    entry = "named_struct('ext', {0}, 'name', {1}, 'is_original', {2}, 'default', {3})"

    def fmt(ext, name, original="false", default="false"):
        return entry.format(ext, name, original, default)

    manual = (
        f"map('en', array({fmt(chr(39) + 'vtt' + chr(39), chr(39) + 'English' + chr(39), default='doc_id % 2 = 0')},"
        f" {fmt('cast(null as string)', 'source')}),"
        f" concat(upper(lang), '_XX'), array({fmt(chr(39) + 'srt' + chr(39), 'source', 'doc_id % 9 = 0')}))"
    )
    auto = (
        f"map('de-orig', array({fmt(chr(39) + 'json3' + chr(39), chr(39) + 'auto' + chr(39))}),"
        f" 'fr', array({fmt(chr(39) + 'vtt' + chr(39), 'if(doc_id % 5 = 0, ' + chr(39) + 'French (Original)' + chr(39) + ', ' + chr(39) + 'French' + chr(39) + ')')}))"
    )
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("if(doc_id % 7 = 0, '', lang)").alias("language"),
        F.lit("de").alias("original_language"),
        F.lit("fr").alias("default_subtitle_language"),
        F.expr(f"case when doc_id % 3 <> 0 then {manual} end").alias("subtitles"),
        F.expr(auto).alias("automatic_captions"),
        F.expr("case when doc_id % 10 = 0 then 'playlist' when doc_id % 15 = 0 then 'multi_video' end").alias("_type"),
        F.expr("filter(array(if(doc_id % 11 = 0, source, null)), x -> x is not null)").alias("entries"),
    )


@R.add("a02_explode_tracks", """
    with m as (select doc_id as id, lang, source, case when doc_id % 7 = 0 then 'de' else lang end as orig
               from documents),
    t as (
      select id, orig, 'manual' as kind, 'en' as language, false as marked, id % 2 = 0 as dflt,
             'unknown,vtt' as formats from m where id % 3 <> 0
      union all
      select id, orig, 'manual', upper(lang) || '_XX', id % 9 = 0, false, 'srt' from m where id % 3 <> 0
      union all
      select id, orig, 'automatic', 'de-orig', false, false, 'json3' from m
      union all
      select id, orig, 'automatic', 'fr', id % 5 = 0, false, 'vtt' from m),
    n as (select *, replace(lower(language), '_', '-') as norm from t),
    f as (select *, split_part(norm, '-', 1) = split_part(orig, '-', 1) or norm like '%-orig' or marked as orig_flag,
                 split_part(norm, '-', 1) = 'fr' or dflt as dflt_flag from n)
    select id, kind || ':' || language as key, norm as normalized_language, formats,
           orig_flag as is_original, dflt_flag as is_platform_default,
           cast(case when kind = 'manual' and orig_flag then 1 when orig_flag then 2
                     when kind = 'manual' then 3 else 4 end as bigint) as rank
    from f""")
def a02(spark, d):
    tracks = ops.explode_tracks(metadata(spark, d))
    return tracks.select("id", "key", "normalized_language", F.array_join("formats", ",").alias("formats"),
                         "is_original", "is_platform_default", "rank")


def cue_texts(spark: SparkSession, d: str) -> DataFrame:
    """A small SRT text per event: one hour-form cue and, at times, cues that must not count."""
    day_ms = F.pmod(F.expr("div(start_us, 1000)"), F.lit(86_400_000))
    span = F.expr("div(end_us - start_us, 1000)")

    def clock(ms, sep):
        return F.format_string(
            f"%02d:%02d:%02d{sep}%03d", (ms / 3_600_000).cast("int"), ((ms / 60_000) % 60).cast("int"),
            ((ms / 1000) % 60).cast("int"), (ms % 1000).cast("int"),
        )

    ev = intervals(spark, d).select("event_id", "event_type", day_ms.alias("a"), (day_ms + span).alias("b"))
    real = F.concat(clock(F.col("a"), ","), F.lit(" --> "), clock(F.col("b"), "."))
    short = F.when(F.col("event_id") % 10 == 0, "\n2\n00:01.000 --> 00:02.000\nshort").otherwise("")
    return ev.select("event_id", "event_type", F.concat(F.lit("﻿1\n"), real, F.lit("\nhello"), short).alias("text"))


@R.add("a03_parse_cues", """
    with e as (select event_id, event_type, (epoch_us(ts) // 1000) % 86400000 as a,
                      cast(round(value * 100) as bigint) * 600 as span from events)
    select event_id, event_type, a as start_ms, a + span as end_ms from e where span > 0""")
def a03(spark, d):
    return ops.parse_cues(cue_texts(spark, d), ["event_id", "event_type"])


ISLANDS = """
    with e as (select event_id, event_type, epoch_us(ts) as s,
                      epoch_us(ts) + cast(round(value * 100) as bigint) * 600000 as e from events),
    u as (select *, max(e) over (partition by event_type order by s, e, event_id
                                 rows between unbounded preceding and 1 preceding) as reach
          from e where e > s),
    f as (select *, sum(case when reach is null or s > reach then 1 else 0 end)
                      over (partition by event_type order by s, e, event_id) as island from u),
    g as (select event_type, island, min(s) as s, max(e) as e, count(*) as n from f group by all)"""


@R.add("a04_interval_union", ISLANDS + """
    select event_type, cast(island as bigint) as island, s as "start", e as "end", n as cue_count from g""")
def a04(spark, d):
    return ops.merged_intervals(intervals(spark, d), ["event_type"], "start_us", "end_us", "event_id")


def union_by_type(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals(spark, d)
    union = ops.interval_union(spans, ["event_type"], "start_us", "end_us", "event_id")
    span = spans.groupBy("event_type").agg((F.max("end_us") - F.min("start_us")).alias("duration_us"))
    return ops.coverage_ratio(union, span, ["event_type"], "duration_us")


@R.add("a06_coverage_ratio", ISLANDS + """,
    d as (select event_type, max(e) - min(s) as duration_us from e group by 1)
    select d.event_type, cast(sum(n) as bigint) as cue_count, count(*) as islands,
           cast(sum(g.e - g.s) as bigint) as covered, d.duration_us,
           round(sum(g.e - g.s) / d.duration_us, 9) as coverage_ratio
    from d join g using (event_type) group by d.event_type, d.duration_us""")
def a06(spark, d):
    return union_by_type(spark, d).select(
        "event_type", "cue_count", "islands", "covered", "duration_us",
        F.round("coverage_ratio", 9).alias("coverage_ratio"),
    )


def document_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as caption tracks of the video named by their source."""
    docs = load(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("automatic")
    original = F.col("doc_id") % 4 < 2
    measured = F.col("doc_id") % 5 != 0
    return docs.select(
        F.col("source").alias("video_id"),
        F.format_string("%s:%012d", kind, "doc_id").alias("key"),
        kind.alias("kind"),
        ops.tier(kind, original).alias("rank"),
        F.when(measured, F.col("n_chars")).alias("covered_ms"),
        F.when(measured, F.col("n_chars") % 50).alias("cue_count"),
        (F.col("doc_id") % 3 == 0).alias("is_platform_default"),
        F.col("lang").alias("normalized_language"),
    )


TRACKS = """
    with t as (
      select source as video_id, case when doc_id % 2 = 0 then 'manual' else 'automatic' end as kind,
             lang as normalized_language, doc_id,
             case when doc_id % 5 <> 0 then n_chars end as covered_ms,
             case when doc_id % 5 <> 0 then n_chars % 50 end as cue_count,
             doc_id % 3 = 0 as is_platform_default, doc_id % 4 < 2 as orig from documents),
    k as (
      select *, kind || ':' || lpad(cast(doc_id as varchar), 12, '0') as key,
             case when kind = 'manual' and orig then 1 when orig then 2 when kind = 'manual' then 3 else 4 end as rank
      from t),
    r as (
      select *, row_number() over (
        partition by video_id
        order by rank, coalesce(covered_ms, -1) desc, coalesce(cue_count, -1) desc,
                 is_platform_default desc, normalized_language, kind, key) as position from k)"""


@R.add("a05_rank_tracks", TRACKS + "select video_id, key, position from r")
def a05(spark, d):
    return ops.rank_tracks(document_tracks(spark, d)).select("video_id", "key", "position")


@R.add("a07_choose_track", TRACKS + """,
    v as (select source as video_id from documents union select r_name from region)
    select v.video_id, coalesce(r.key, '') as key,
      case when r.key is null then 'no downloadable caption tracks' else
        'rank ' || r.rank || '; coverage ' ||
        case when covered_ms is null then 'None' else
          '{''cue_count'': ' || cue_count || ', ''covered_seconds'': ' || cast(covered_ms / 1000 as double) || '}' end ||
        '; platform_default=' || case when is_platform_default then 'True' else 'False' end end as selection_reason
    from v left join r on r.video_id = v.video_id and r.position = 1""")
def a07(spark, d):
    tracks = document_tracks(spark, d)
    videos = tracks.select("video_id").union(load(spark, d, "region").select("r_name")).distinct()
    return ops.choose_track(videos, tracks).select(
        "video_id", F.coalesce("key", F.lit("")).alias("key"), "selection_reason"
    )


@R.add("a08_reject_multi_entry", """
    select doc_id as id, doc_id % 10 = 0 or doc_id % 15 = 0 or doc_id % 11 = 0 as rejected from documents""")
def a08(spark, d):
    return ops.reject_multi_entry(metadata(spark, d)).select("id", "rejected")


@R.add("a09_first_success", """
    with w as (select user_id, min({'ts': ts, 'id': event_id}) filter (event_type = 'purchase') as win
               from events group by 1)
    select e.user_id, count(*) filter (win is null or {'ts': ts, 'id': event_id} <= win) as used,
           count(*) filter ({'ts': ts, 'id': event_id} > win) as unused,
           coalesce(max(event_id) filter ({'ts': ts, 'id': event_id} = win), -1) as success_event
    from events e join w using (user_id) group by 1""")
def a09(spark, d):
    ev = load(spark, d, "events").select("user_id", micros().alias("us"), "event_id", "event_type")
    marked = ops.first_success(ev, ["user_id"], ["us", "event_id"], F.col("event_type") == "purchase")
    return marked.groupBy("user_id").agg(
        F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("unused"),
        F.coalesce(F.max(F.when(F.col("succeeded_here"), F.col("event_id"))), F.lit(-1)).alias("success_event"),
    )


@R.add("a10_bounded_retries", """
    with n as (select *, event_type not in ('error', 'view') as ok,
                      row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as attempt
               from events),
    g as (select user_id, epoch_us(date_trunc('day', ts)) // 86400000000 as day, count(*) as tries,
                 min(attempt) filter (ok) as hit from n where attempt <= 3 group by 1, 2)
    select user_id, day, coalesce(hit, tries) as attempts_used,
           case when hit is not null then 'acquired' when tries < 3 then 'retrying'
                when user_id % 2 = 0 then 'ask' when user_id % 3 = 0 then 'media-branch' else 'blocked' end as status
    from g""")
def a10(spark, d):
    ev = load(spark, d, "events").select(
        "user_id", "event_id", "event_type", micros().alias("us"),
        F.expr("div(unix_micros(cast(ts as timestamp)), 86400000000)").alias("day"),
    )
    return ops.bounded_retries(
        ev, ["user_id", "day"], ["us", "event_id"], ~F.col("event_type").isin("error", "view"),
        F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0,
    )


@R.add("a11_normalize_media_url", r"""
    with u as (
      select page_id, 'as crawled' as origin, url from pages
      union all
      select page_id, 'as shared', 'https://' ||
        list_extract(['www.bilibili.com', 'B23.tv', 'v.douyin.com', 'tiktok.com', 'x.com', 'youtu.be'],
                     cast(page_id % 6 as int) + 1)
        || '/video/' || (page_id % 4 + 1) || '?t=' || page_id || 's&p=' || (page_id % 3) ||
        case when page_id % 2 = 0 then '&start=9#clip' else '' end from pages),
    h as (select *, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) as host from u)
    select page_id, origin, host,
      case when regexp_matches(host, '(^|\.)(bilibili\.com|b23\.tv)$') then 'Bilibili'
           when regexp_matches(host, '(^|\.)douyin\.com$') then 'Douyin'
           when regexp_matches(host, '(^|\.)tiktok\.com$') then 'TikTok'
           when regexp_matches(host, '(^|\.)(x|twitter)\.com$') then 'X'
           when regexp_matches(host, '(^|\.)(youtube\.com|youtu\.be)$') then 'YouTube' else 'other' end as platform,
      regexp_extract(url, '/video/(\d+)', 1) as item_selector,
      regexp_extract(url, '[?&](?:p|page)=(\d+)', 1) as page_index,
      regexp_extract(url, '[?&](?:t|start|time_continue)=([^&#]*)', 1) as playback_time,
      case when origin = 'as crawled' then trim(url) else
        'https://' || list_extract(['www.bilibili.com', 'B23.tv', 'v.douyin.com', 'tiktok.com', 'x.com', 'youtu.be'],
                     cast(page_id % 6 as int) + 1) || '/video/' || (page_id % 4 + 1) || '?p=' || (page_id % 3) ||
        case when page_id % 2 = 0 then '#clip' else '' end end as normalized_url
    from h""")
def a11(spark, d):
    pages = load(spark, d, "pages")
    shared = pages.select(
        "page_id", F.lit("as shared").alias("origin"),
        F.expr("""concat('https://', element_at(
            array('www.bilibili.com', 'B23.tv', 'v.douyin.com', 'tiktok.com', 'x.com', 'youtu.be'),
            cast(page_id % 6 as int) + 1), '/video/', page_id % 4 + 1, '?t=', page_id, 's&p=', page_id % 3,
            if(page_id % 2 = 0, '&start=9#clip', ''))""").alias("url"),
    )
    urls = pages.select("page_id", F.lit("as crawled").alias("origin"), "url").union(shared)
    return ops.normalize_media_url(urls, "url").drop("url")


@R.add("a12_select_formats", """
    with f as (
      select p_brand as video, p_partkey as id, p_size as height, cast(round(p_retailprice * 100) as bigint) as bitrate,
             p_partkey % 3 * 15 + 30 as fps, case when p_partkey % 4 = 0 then 'none' else p_type end as vcodec,
             case when p_partkey % 4 = 0 or p_partkey % 6 = 1 then 'aac' else 'none' end as acodec from part),
    p as (select *, row_number() over (partition by video order by (vcodec <> 'ECONOMY'), height desc, bitrate desc,
                 fps desc, (acodec = 'none'), id) as rn
          from f where vcodec <> 'none' and height <= 20),
    s as (select *, row_number() over (partition by video order by bitrate desc, id) as rn
          from f where vcodec = 'none' and acodec <> 'none'),
    v as (select distinct video from f)
    select v.video, coalesce(p.id, -1) as video_format, coalesce(p.height, -1) as video_height,
           coalesce(case when p.acodec = 'none' then s.id end, -1) as audio_format,
           concat_ws('; ', case when p.id is null then 'no video at or below 20' end,
                           case when p.vcodec <> 'ECONOMY' then 'requested codec unavailable' end,
                           case when p.acodec = 'none' and s.id is null then 'no audio stream' end) as mismatch
    from v left join p on p.video = v.video and p.rn = 1 left join s on s.video = v.video and s.rn = 1""")
def a12(spark, d):
    formats = load(spark, d, "part").select(
        F.col("p_brand").alias("video"), F.col("p_partkey").alias("format_id"), F.col("p_size").alias("height"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("bitrate"),
        (F.col("p_partkey") % 3 * 15 + 30).alias("fps"),
        F.expr("if(p_partkey % 4 = 0, 'none', p_type)").alias("vcodec"),
        F.expr("if(p_partkey % 4 = 0 or p_partkey % 6 = 1, 'aac', 'none')").alias("acodec"),
    )
    chosen = ops.select_formats(formats, "video", 20, "ECONOMY")
    return chosen.select("video", "mismatch", *[
        F.coalesce(c, F.lit(-1)).alias(c) for c in ("video_format", "video_height", "audio_format")
    ])


@R.add("a13_normalize_probe", """
    with s as (
      select l_orderkey as video, l_linenumber as idx,
             case when l_linenumber % 3 = 0 then 'audio' else 'video' end as kind,
             l_partkey % 1920 + 1 as width, l_suppkey % 1080 + 1 as height,
             l_quantity as avg_n, case when l_suppkey % 10 = 0 then 0.0 else l_quantity end as avg_fps,
             (l_quantity * 1001 + l_linenumber) / 1001.0 as nom_fps,
             ((case when l_suppkey % 4 = 0 then -90 else l_partkey % 5 * 90 end) % 360 + 360) % 360 as rotation,
             case when l_partkey % 7 = 0 then l_extendedprice / 2 else l_extendedprice end as duration,
             case when l_partkey % 3 = 0 then null else l_partkey end as frames,
             case when l_orderkey % 4 = 0 then 2 end as asked, l_partkey, l_suppkey,
             row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as dup
      from lineitem),
    c as (select video, count(*) filter (kind = 'video') as n, max(asked) as asked from s where dup = 1 group by 1),
    w as (select s.*, row_number() over (partition by s.video order by idx) as rn from s
          where dup = 1 and kind = 'video' and (asked is null or idx = asked)),
    o as (select c.video, n, c.asked, w.*,
                 case when n = 0 then 'UNSUPPORTED_INPUT'
                      when c.asked is null and n > 1 then 'AMBIGUOUS_VIDEO_STREAM'
                      when w.idx is null then 'UNSUPPORTED_INPUT' else 'OK' end as status
          from c left join w on w.video = c.video and w.rn = 1)
    select video, status, n as video_streams,
      coalesce(case when status = 'OK' then cast(idx as bigint) end, -1) as stream_index,
      coalesce(case when status = 'OK' then cast(rotation as bigint) end, -1) as rotation,
      coalesce(case when status = 'OK' then case when rotation in (90, 270) then height else width end end, -1) as display_width,
      coalesce(case when status = 'OK' then case when rotation in (90, 270) then width else height end end, -1) as display_height,
      coalesce(case when status = 'OK' then avg_fps end, -1) as average_fps,
      coalesce(case when status = 'OK' then round(duration, 6) end, -1) as duration_seconds,
      coalesce(case when status = 'OK' then frames end, -1) as frame_count,
      coalesce(status = 'OK' and avg_fps <> 0 and abs(avg_fps - nom_fps) > 0.01, false) as variable_frame_rate
    from o""")
def a13(spark, d):
    first = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("l")
    ).select("l_orderkey", "l_linenumber", "l.*")
    q = F.col("l_quantity").cast("int")
    streams = first.select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("index"),
        F.expr("if(l_linenumber % 3 = 0, 'audio', 'video')").alias("codec_type"),
        (F.col("l_partkey") % 1920 + 1).alias("width"), (F.col("l_suppkey") % 1080 + 1).alias("height"),
        F.when(F.col("l_suppkey") % 10 == 0, "0/0").otherwise(F.concat(q.cast("string"), F.lit("/1"))).alias("avg_frame_rate"),
        F.concat((q * 1001 + F.col("l_linenumber")).cast("string"), F.lit("/1001")).alias("r_frame_rate"),
        (F.col("l_partkey") % 5 * 90).cast("string").alias("rotate"),
        F.expr("if(l_suppkey % 4 = 0, -90.0D, null)").alias("side_rotation"),
        F.expr("if(l_partkey % 7 = 0, 0.0D, l_extendedprice)").alias("duration"),
        (F.col("l_extendedprice") / 2).alias("format_duration"),
        F.expr("if(l_partkey % 3 = 0, 'N/A', cast(l_partkey as string))").alias("nb_frames"),
        F.expr("if(l_orderkey % 4 = 0, 2, null)").alias("asked"),
    )
    out = ops.normalize_probe(streams, "video", "asked")
    return out.select(
        "video", "status", "video_streams", "variable_frame_rate",
        F.round(F.coalesce("duration_seconds", F.lit(-1.0)), 6).alias("duration_seconds"),
        F.coalesce("average_fps", F.lit(-1.0)).alias("average_fps"),
        *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in
          ("stream_index", "rotation", "display_width", "display_height", "frame_count")],
    )


@R.add("a14_even_sample", """
    with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as p,
                      count(*) over (partition by user_id) as n from events),
    w as (select distinct n.user_id, case when n = 1 then 0 else i * (n - 1) // (least(8, n) - 1) end as p
          from n, range(8) as r(i) where i < least(8, n))
    select n.user_id, n.event_id, n.p as sample_position from n join w using (user_id, p)""")
def a14(spark, d):
    ev = load(spark, d, "events").select("user_id", micros().alias("us"), "event_id")
    return ops.even_sample(ev, ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "sample_position")
