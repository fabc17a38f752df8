"""Track and stream inventory: expand, measure, rank, choose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import CUE, clock_ms, language_matches, normalize_language
from proofline.operators.sequence import best_per_key, islands, numbered, ordered, scan, union_all

# Host suffix to platform.
PLATFORMS = {
    "bilibili.com": "Bilibili",
    "b23.tv": "Bilibili",
    "douyin.com": "Douyin",
    "tiktok.com": "TikTok",
    "x.com": "X",
    "twitter.com": "X",
    "youtube.com": "YouTube",
    "youtu.be": "YouTube",
}
# Query parameters that only move the playback start; they never trim a video.
PLAYBACK_PARAMETERS = ("t", "start", "time_continue")
NO_TRACKS = "no downloadable caption tracks"
MULTI_ENTRY_TYPES = ("playlist", "multi_video")


def explode_tracks(meta: DataFrame) -> DataFrame:
    """One row per caption track from the manual and automatic language maps."""
    original = normalize_language(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.col("original_language")))
    default = normalize_language(F.col("default_subtitle_language"))
    base = meta.withColumn("_original", original).withColumn("_default", default)
    sides = [
        base.select("id", "_original", "_default", F.lit(kind).alias("kind"),
                    F.explode(field).alias("language", "formats"))
        for kind, field in (("manual", "subtitles"), ("automatic", "automatic_captions"))
    ]
    tracks = union_all(sides).withColumn("normalized_language", normalize_language(F.col("language")))
    marked = F.exists(
        "formats",
        lambda f: F.coalesce(F.lower(f["name"]).contains("original"), F.lit(False))
        | F.coalesce(f["is_original"], F.lit(False)),
    )
    is_original = (
        language_matches(F.col("normalized_language"), F.col("_original"))
        | F.col("normalized_language").endswith("-orig")
        | marked
    )
    is_default = language_matches(F.col("normalized_language"), F.col("_default")) | F.exists(
        "formats", lambda f: F.coalesce(f["default"], F.lit(False))
    )
    extensions = F.array_sort(
        F.array_distinct(F.transform("formats", lambda f: F.coalesce(f["ext"], F.lit("unknown"))))
    )
    return tracks.select(
        "id",
        F.concat_ws(":", "kind", "language").alias("key"),
        "language", "normalized_language", "kind",
        is_original.alias("is_original"),
        is_default.alias("is_platform_default"),
        extensions.alias("formats"),
    ).withColumn("rank", tier(F.col("kind"), F.col("is_original")))


def tier(kind: Column, is_original: Column) -> Column:
    manual = kind == "manual"
    return (
        F.when(manual & is_original, 1).when(is_original, 2).when(manual, 3).otherwise(4).cast("bigint")
    )


def parse_cues(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Cue intervals in integer milliseconds; hours are mandatory, end must follow start."""
    clean = F.regexp_replace(F.col(text), r"^\uFEFF", "")
    cues = texts.select(*keys, F.explode(F.regexp_extract_all(clean, F.lit(CUE), F.lit(0))).alias("_cue"))
    side = F.split("_cue", r"\s+-->\s+")
    spans = cues.select(*keys, clock_ms(side[0]).alias("start_ms"), clock_ms(side[1]).alias("end_ms"))
    return spans.where("end_ms > start_ms")


def merged_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, parts: int | None = None
) -> DataFrame:
    """Islands of touching or overlapping intervals: start, end, cue count."""
    usable = df.where(F.col(end) > F.col(start)).select(*keys, start, end, tie)
    seq = scan(ordered(usable, keys, [start, end, tie], parts), before_max={"_reach": end})
    opens = F.coalesce(F.col(start) > F.col("_reach"), F.lit(True))
    runs = islands(seq, opens).plain()
    return runs.groupBy(*keys, "island").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("cue_count")
    )


def interval_union(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Per key: cue count, island count, covered length, first start and last end."""
    return merged_intervals(df, keys, start, end, tie).groupBy(*keys).agg(
        F.sum("cue_count").alias("cue_count"),
        F.count(F.lit(1)).alias("islands"),
        F.sum(F.col("end") - F.col("start")).alias("covered"),
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
    )


def coverage_ratio(union: DataFrame, durations: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    """Covered share of the media duration; null when the duration is not positive."""
    ratio = F.when(F.col(duration) > 0, F.coalesce(F.col("covered"), F.lit(0)) / F.col(duration))
    return durations.join(union, on=list(keys), how="left").withColumn("coverage_ratio", ratio)


def track_order() -> list[Column]:
    """Ascending sort keys; unmeasured coverage sorts after a measured zero."""
    return [
        F.col("rank"),
        (-F.coalesce(F.col("covered_ms"), F.lit(-1))).cast("bigint"),
        (-F.coalesce(F.col("cue_count"), F.lit(-1))).cast("bigint"),
        (~F.col("is_platform_default")).cast("int"),
        F.col("normalized_language"),
        F.col("kind"),
        F.col("key"),
    ]


def rank_tracks(tracks: DataFrame, video: str = "video_id") -> DataFrame:
    names = [f"_o{i}" for i in range(len(track_order()))]
    keyed = tracks.select("*", *[c.alias(n) for c, n in zip(track_order(), names)])
    return numbered(ordered(keyed, [video], names), "position").plain().drop(*names)


def choose_track(videos: DataFrame, tracks: DataFrame, video: str = "video_id") -> DataFrame:
    """Best track per video with its reason; videos without tracks stay."""
    best = best_per_key(tracks, [video], track_order())
    coverage = F.when(F.col("covered_ms").isNull(), F.lit("None")).otherwise(
        F.format_string("{'cue_count': %d, 'covered_seconds': %s}", "cue_count",
                        (F.col("covered_ms") / 1000).cast("string"))
    )
    reason = F.when(F.col("key").isNull(), F.lit(NO_TRACKS)).otherwise(
        F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit("; coverage "), coverage,
                 F.lit("; platform_default="), F.initcap(F.col("is_platform_default").cast("string")))
    )
    return videos.join(best, on=video, how="left").withColumn("selection_reason", reason)


def reject_multi_entry(meta: DataFrame) -> DataFrame:
    """Flag documents that expand to several entries."""
    many = F.coalesce(F.col("_type").isin(*MULTI_ENTRY_TYPES), F.lit(False)) | (
        F.coalesce(F.size("entries"), F.lit(0)) > 0
    )
    return meta.withColumn("rejected", many)


def first_success(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column) -> DataFrame:
    """Mark attempts up to the first success as used; later ones stay unused."""
    place = F.struct(*order)
    wins = attempts.groupBy(*keys).agg(F.min(F.when(ok, place)).alias("_win"))
    used = F.col("_win").isNull() | (place <= F.col("_win"))
    return attempts.join(wins, on=list(keys)).withColumn("used", used).withColumn(
        "succeeded_here", F.coalesce(place == F.col("_win"), F.lit(False))
    ).drop("_win")


def bounded_retries(
    attempts: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column,
    interactive: Column, has_media: Column, n: int = 3,
) -> DataFrame:
    """At most ``n`` attempts, then ask, fall back to the media branch, or block."""
    tried = numbered(ordered(attempts.withColumn("_ok", ok), keys, order), "attempt").plain()
    outcome = tried.where(F.col("attempt") <= n).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_tries"), F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("_hit")
    )
    status = (
        F.when(F.col("_hit").isNotNull(), "acquired").when(F.col("_tries") < n, "retrying")
        .when(interactive, "ask").when(has_media, "media-branch").otherwise("blocked")
    )
    return outcome.select(
        *keys, F.coalesce("_hit", "_tries").cast("bigint").alias("attempts_used"), status.alias("status")
    )


def normalize_media_url(df: DataFrame, url: str) -> DataFrame:
    """Host, platform, kept item selectors, and the URL without playback-time parameters."""
    names = "|".join(PLAYBACK_PARAMETERS)
    raw = F.trim(F.col(url))
    host = F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    platform = F.lit("other")
    for suffix, name in PLATFORMS.items():
        platform = F.when((host == suffix) | host.endswith("." + suffix), name).otherwise(platform)
    timed = F.regexp_extract(raw, rf"[?&](?:{names})=([^&#]*)", 1)
    cleaned = F.regexp_replace(raw, rf"([?&])(?:{names})=[^&#]*", "$1")
    cleaned = F.regexp_replace(cleaned, r"&+", "&")
    cleaned = F.regexp_replace(cleaned, r"\?&", "?")
    cleaned = F.regexp_replace(cleaned, r"[?&]+(#|$)", "$1")
    return df.select(
        "*", host.alias("host"), platform.alias("platform"),
        F.regexp_extract(raw, r"/video/(\d+)", 1).alias("item_selector"),
        F.regexp_extract(raw, r"[?&](?:p|page)=(\d+)", 1).alias("page_index"),
        timed.alias("playback_time"), cleaned.alias("normalized_url"),
    )


def select_formats(formats: DataFrame, video: str, cap: int, codec: str | None = None) -> DataFrame:
    """Best video at or under the cap plus audio; any mismatch is disclosed, never hidden."""
    has_video = F.col("vcodec") != "none"
    has_audio = F.col("acodec") != "none"
    wanted = F.lit(True) if codec is None else F.col("vcodec") == codec
    picture = best_per_key(
        formats.where(has_video & (F.col("height") <= cap)), [video],
        [(~wanted).cast("int"), -F.col("height"), -F.col("bitrate"), -F.col("fps"),
         (~has_audio).cast("int"), F.col("format_id")],
    ).select(video, F.col("format_id").alias("video_format"), F.col("height").alias("video_height"),
             has_audio.alias("progressive"), wanted.alias("codec_ok"))
    sound = best_per_key(
        formats.where(~has_video & has_audio), [video], [-F.col("bitrate"), F.col("format_id")]
    ).select(video, F.col("format_id").alias("_sound"))
    everyone = formats.select(video).distinct()
    none_fit = F.col("video_format").isNull()
    return everyone.join(picture, on=video, how="left").join(sound, on=video, how="left").select(
        video, "video_format", "video_height",
        F.when(none_fit | F.col("progressive"), F.lit(None)).otherwise(F.col("_sound")).alias("audio_format"),
        F.concat_ws(
            "; ",
            F.when(none_fit, f"no video at or below {cap}"),
            F.when(~F.col("codec_ok"), "requested codec unavailable"),
            F.when(~none_fit & ~F.col("progressive") & F.col("_sound").isNull(), "no audio stream"),
        ).alias("mismatch"),
    )


def rate(col: Column) -> Column:
    """Rational ``num/den``; empty and 0/0 give 0."""
    num = F.split_part(col, F.lit("/"), F.lit(1)).cast("double")
    den = F.split_part(col, F.lit("/"), F.lit(2)).cast("double")
    empty = F.coalesce(col, F.lit("")).isin("", "0/0")
    return F.when(empty, F.lit(0.0)).otherwise(F.try_divide(num, den))


def normalize_probe(streams: DataFrame, video: str, requested: str) -> DataFrame:
    """One record per video from its stream rows, or the reason it has none."""
    is_video = F.col("codec_type") == "video"
    wanted = is_video & (F.col(requested).isNull() | (F.col("index") == F.col(requested)))
    picked = streams.groupBy(video).agg(
        F.count_if(is_video).alias("video_streams"),
        F.first(requested).alias("_asked"),
        F.min_by(F.when(wanted, F.struct(*streams.columns)), F.when(wanted, F.col("index"))).alias("s"),
    )
    status = (
        F.when(F.col("video_streams") == 0, "UNSUPPORTED_INPUT")
        .when(F.col("_asked").isNull() & (F.col("video_streams") > 1), "AMBIGUOUS_VIDEO_STREAM")
        .when(F.col("s").isNull(), "UNSUPPORTED_INPUT")
        .otherwise("OK")
    )
    turned = F.pmod(
        F.coalesce(F.bround(F.col("s.side_rotation")).cast("bigint"), F.col("s.rotate").cast("bigint"), F.lit(0)),
        F.lit(360),
    )
    ok = picked.withColumn("status", status)
    values = {
        "stream_index": F.col("s.index").cast("bigint"),
        "rotation": turned.cast("bigint"),
        "display_width": F.when(turned.isin(90, 270), F.col("s.height")).otherwise(F.col("s.width")).cast("bigint"),
        "display_height": F.when(turned.isin(90, 270), F.col("s.width")).otherwise(F.col("s.height")).cast("bigint"),
        "average_fps": rate(F.col("s.avg_frame_rate")),
        "nominal_fps": rate(F.col("s.r_frame_rate")),
        "duration_seconds": F.coalesce(
            F.nullif(F.col("s.duration"), F.lit(0.0)), F.col("s.format_duration"), F.lit(0.0)
        ),
        "frame_count": F.when(F.col("s.nb_frames").rlike("^[0-9]+$"), F.col("s.nb_frames").cast("bigint")),
    }
    out = ok.select(
        video, "status", "video_streams",
        *[F.when(F.col("status") == "OK", c).alias(n) for n, c in values.items()],
    )
    varies = (F.col("average_fps") != 0) & (F.col("nominal_fps") != 0) & (
        F.abs(F.col("average_fps") - F.col("nominal_fps")) > 0.01
    )
    return out.withColumn("variable_frame_rate", F.coalesce(varies, F.lit(False)))


def even_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 8) -> DataFrame:
    """Rows at up to ``n`` evenly spaced positions of every ordered key."""
    rows = numbered(ordered(df, keys, order), "_rn", size="_size").plain()
    p, last = F.col("_rn") - 1, F.col("_size") - 1
    gaps = F.least(F.lit(n), F.col("_size")) - 1
    i = F.ceil((p * gaps) / F.greatest(last, F.lit(1)))
    hit = (last == 0) | (F.floor((i * last) / F.greatest(gaps, F.lit(1))) == p)
    return rows.where(hit).withColumn("sample_position", p.cast("bigint")).drop("_rn", "_size")
