"""Queries of media candidates, matching and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutroom.operators import candidates as c
from cutroom.operators import match, timeline

from cutroom.operators import cache
from cutroom.sources.folders import shared_folder

from .catalog import query

_SOURCE = "concat('video', page_id % 40)"


@query("media_url_key", "select page_id, md5(split_part(url, '?', 1)) as url_key from {candidates}")
def _(get):
    return c.media_url_key(get("candidates")).select("page_id", "url_key")


@query("source_key", f"select page_id, {_SOURCE} as source from {{candidates}}")
def _(get):
    return c.source_key(get("candidates")).select("page_id", "source")


@query("watermark_domain_filter", "select page_id from {candidates} where not contains(url, 'example.net') and not contains(url, 'blog.')")
def _(get):
    return c.watermark_domain_filter(get("candidates"), ["example.net", "blog."]).select("page_id")


@query("resolution_gate", "select page_id, width, height from {candidates} where width >= 480 and height >= 480")
def _(get):
    return c.resolution_gate(get("candidates")).select("page_id", "width", "height")


@query("frame_fill_decision", """select page_id, round(k, 6) as crop_keep, case when width > height then 'landscape' when width < height then 'portrait' else 'square' end as orientation, case when k >= 0.6 then 'cover' else 'fit' end as fill
    from (select *, least(1080 / (width * s), 1920 / (height * s)) as k from (select *, greatest(cast(1080 as double) / width, cast(1920 as double) / height) as s from {candidates}))""")
def _(get):
    return c.frame_fill_decision(get("candidates")).select("page_id", "crop_keep", "orientation", "fill")


@query("media_kind", "select page_id, case when page_id % 2 = 0 then 'video' else 'image' end as kind from {candidates}")
def _(get):
    return c.media_kind(get("candidates")).select("page_id", "kind")


_GRAPHIC = "(dominant_share >= 0.45 or n_colours <= 12 or dark_border >= 0.70 or detail < 3.5 or (dark_border >= 0.45 and dominant_share >= 0.30))"


@query("graphic_frame_gate", f"select page_id, {_GRAPHIC} as is_graphic from {{candidates}}")
def _(get):
    return c.graphic_frame_gate(get("candidates")).select("page_id", "is_graphic")


@query("frame_quality_flag", "select page_id, brightness < 8 or brightness > 247 or contrast < 4 or edge_detail < 1.5 as unusable from {candidates}")
def _(get):
    return c.frame_quality_flag(get("candidates")).select("page_id", "unusable")


@query("first_wins_dedupe", "select pool, term, page_id from (select *, row_number() over (partition by pool, term order by term_ord, hit_ord) as rn from {candidates}) where rn = 1")
def _(get):
    return c.first_wins_dedupe(get("candidates"), "term", ["pool"]).select("pool", "term", "page_id")


@query("per_term_cap", """select pool, page_id from (select k.*, row_number() over (partition by k.pool, term order by hit_ord, url) as rn, audio_s, terms from {candidates} k join {pools} p on k.pool = p.pool
    join (select pool, count(distinct term) as terms from {candidates} group by pool) t on t.pool = k.pool) where rn <= greatest(1, floor(audio_s / 4 / terms) + 1)""")
def _(get):
    return c.per_term_cap(get("candidates"), get("pools"), "pool", 4.0).select("pool", "page_id")


@query("duration_budget", """select pool, page_id, used_s from (select k.*, least(5.0, duration) as used_s, coalesce(sum(least(5.0, duration)) over (partition by k.pool order by term_ord, hit_ord rows between unbounded preceding and 1 preceding), 0) as b, audio_s
    from {candidates} k join {pools} p on k.pool = p.pool) where b <= audio_s""")
def _(get):
    return c.duration_budget(get("candidates"), get("pools"), "pool", ["term_ord", "hit_ord"], 5.0).select("pool", "page_id", "used_s")


@query("provider_quota", """select pool, page_id from (select *, coalesce(sum(duration) over (partition by pool order by term_ord, hit_ord rows between unbounded preceding and 1 preceding), 0) as b from
    (select k.*, audio_s, row_number() over (partition by k.pool, term, kind order by term_ord, hit_ord) as rn from {candidates} k join {pools} p on k.pool = p.pool) where rn <= case when kind = 'video' then 2 else 4 end) where b < greatest(4 * audio_s, audio_s + 30)""")
def _(get):
    return c.provider_quota(get("candidates"), get("pools"), "pool", 0.6, ["term_ord", "hit_ord"]).select("pool", "page_id")


@query("term_share", """select pool, term, count(*) as n, round(100.0 * count(*) / cast(sum(count(*)) over (partition by pool) as bigint), 3) as share, count(*) over (partition by pool) as terms from {candidates} group by pool, term""")
def _(get):
    return c.term_share(get("candidates"), "pool")


@query("reuse_distribution", """select pool, total, unique_media, most_used, used_once, round(unique_media / cast(total as double), 3) as diversity, case when unique_media / cast(total as double) >= 0.8 then 'excellent' when unique_media / cast(total as double) >= 0.6 then 'good'
    when unique_media / cast(total as double) >= 0.4 then 'fair' else 'poor' end as band from (select pool, cast(sum(n) as bigint) as total, count(*) as unique_media, max(n) as most_used, count(*) filter (n = 1) as used_once from (select pool, term, count(*) as n from {candidates} group by 1, 2) group by pool)""")
def _(get):
    return c.reuse_distribution(get("candidates"), "pool", "term")


@query("media_plan_verdict", """select pool as plan_id, n as clips, concat_ws('|', case when n < 3 then 'too few clips' end, case when small > 0 then 'file too small' end, case when silent > 0 then 'no video stream' end, case when unreadable > 0 then 'unreadable image' end,
    case when short > 0 then 'clip too short' end, case when wide > 0 then 'not portrait' end, case when bad > greatest(1, floor(n / 3)) then 'too many unusable frames' end, case when n >= 5 and frames < greatest(3, floor(n * 0.4)) then 'too few different frames' end,
    case when pool % 3 = 0 and sources < 39 then 'too few sources' end, case when seconds + 0.2 < audio_s then 'shorter than the audio' end) as failures
    from (select k.pool, max(audio_s) * 5 as audio_s, count(*) as n, count(*) filter (bytes < 1024) as small, count(*) filter (page_id % 131 = 5) as silent, count(*) filter (page_id % 67 = 3 and page_id % 131 <> 5 and page_id % 2 <> 0) as unreadable,
    count(*) filter (page_id % 61 = 4 and page_id % 131 <> 5 and page_id % 2 = 0) as short, count(*) filter (page_id % 131 <> 5 and page_id % 2 = 0 and (page_id % 67 = 3 or width >= height)) as wide,
    count(*) filter (brightness < 8 or brightness > 247 or contrast < 4 or edge_detail < 1.5) as bad, count(distinct page_id % 40) as frames, count(distinct page_id % 40) as sources,
    sum(case when page_id % 2 <> 0 then 2 when page_id % 131 = 5 then 0 when page_id % 61 = 4 then 0.2 else duration end) as seconds from {candidates} k join {pools} p on k.pool = p.pool group by k.pool)""")
def _(get):
    clips = c.source_key(get("candidates")).withColumns({"plan_id": F.col("pool"), "is_image": F.expr("page_id % 2 <> 0"), "frame_signature": F.col("source")})
    clips = clips.withColumns({"width": F.expr("case when page_id % 131 = 5 then null when page_id % 67 = 3 then 0 else width end"), "height": F.expr("case when page_id % 131 = 5 then null else height end")})
    clips = clips.withColumn("duration", F.expr("case when page_id % 131 = 5 then null when page_id % 61 = 4 then 0.2D else duration end"))
    plans = get("pools").select(F.col("pool").alias("plan_id"), (F.col("audio_s") * 5).alias("audio_s"))
    some = c.media_plan_verdict(clips, plans.where("plan_id % 3 = 0"), min_sources=39)
    out = some.unionByName(c.media_plan_verdict(clips, plans.where("plan_id % 3 <> 0")))
    return out.select("plan_id", "clips", F.array_join("failures", "|").alias("failures"))


@query("dark_clip_gate", "select page_id from {candidates} where not (brightness < 9 or brightness + 9 < 22 or brightness + 3 < 17.6)")
def _(get):
    clips = get("candidates").select("page_id", "brightness")
    samples = clips.select("page_id", F.explode(F.array(F.col("brightness"), F.col("brightness"), F.col("brightness") + 9)).alias("brightness"))
    return c.dark_clip_gate(clips, samples, "page_id").select("page_id")


@query("render_verdict", """select page_id, true as has_video, page_id % 4 > 0 as has_audio, page_id % 6 > 0 as frame_ok, bytes >= 10000 and page_id % 4 > 0 and page_id % 6 > 0 and page_id % 3 <= 1 as ok from {candidates}""")
def _(get):
    kinds = F.when(F.col("page_id") % 4 > 0, F.array(F.lit("video"), F.lit("audio"))).otherwise(F.array(F.lit("video")))
    probes = get("candidates").select("page_id", "bytes", F.explode(kinds).alias("kind"), F.expr("case when page_id % 6 > 0 then 1080 else 720 end").alias("width"), F.lit(1920).alias("height"), F.col("duration"), (F.col("duration") + F.col("page_id") % 3).alias("expected"))
    return c.render_verdict(probes, "page_id")


@query("acquisition_counts", "select pool, count(*) filter (kind = 'video') as clips, count(*) filter (kind <> 'video') as photos from {candidates} group by pool")
def _(get):
    return c.acquisition_counts(get("candidates"), "pool")


@query("graphics_filter_with_floor", f"select pool, page_id from (select *, {_GRAPHIC} as g, count(*) filter (not {_GRAPHIC}) over (partition by pool) as n from {{candidates}}) where not g or n < 2")
def _(get):
    return c.graphics_filter_with_floor(get("candidates"), "pool", 2, False).select("pool", "page_id")


@query("sidecar_default_join", """select page_id, case when page_id % 3 = 0 then term else regexp_extract(path, '([^/]*?)([.][^./]*)?$', 1) end as search_term from {candidates}""")
def _(get):
    media = get("candidates").select("page_id", "path", "term").withColumn("path", F.concat("path", F.lit("")))
    side = media.where("page_id % 3 = 0").select(F.concat(F.col("path"), F.lit("#"), F.col("page_id")).alias("path"), F.col("term").alias("search_term"))
    keyed = media.withColumn("plain", F.col("path")).withColumn("path", F.concat(F.col("path"), F.lit("#"), F.col("page_id")))
    joined = c.sidecar_default_join(keyed.drop("term"), side)
    return joined.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("search_term")).otherwise(F.regexp_extract("plain", r"([^/]*?)([.][^./]*)?$", 1)).alias("search_term"))


@query("pool_union", "select pool, page_id, case when kind = 'video' then 0 else 1 end as priority from {candidates}")
def _(get):
    rows = get("candidates").select("pool", "page_id", "kind")
    return c.pool_union(rows.where("kind = 'video'"), rows.where("kind <> 'video'")).select("pool", "page_id", "priority")


@query("pin_restore", "select pool, page_id, case when width < 480 then 0 else 1 end as priority from {candidates} where width >= 480 or page_id % 10 = 1")
def _(get):
    rows = get("candidates").select("pool", "page_id", "width")
    return c.pin_restore(rows.where("width >= 480"), rows.where("page_id % 10 = 1"), ["page_id"]).select("pool", "page_id", "priority")


@query("subclip_windows", """select page_id, cast(w as int) as "window", cast(w * 5 as double) as start, least(duration, (w + 1) * 5.0) as "end" from (select page_id, duration, unnest(range(0, cast(ceil(duration / 5) as bigint))) as w from {candidates}) where w = 0 or least(duration, (w + 1) * 5.0) - w * 5.0 >= 5""")
def _(get):
    return c.subclip_windows(get("candidates"), 5.0).select("page_id", "window", "start", "end").withColumn("start", F.col("start").cast("double"))


@query("even_cut_offsets", """select page_id, cast(k as int) as cut, round(6 + k * greatest(3.0, span / 4), 6) as "offset" from (select page_id, duration * 3 as d, duration * 3 - 10 as span, unnest(range(0, 4)) as k from {candidates})
    where case when span <= 3 then k = 0 else 6 + k * greatest(3.0, span / 4) + 3 <= d - 4 end""")
def _(get):
    rows = c.even_cut_offsets(get("candidates").withColumn("duration", F.col("duration") * 3), 3.0, 4)
    return rows.select("page_id", "cut", F.round("offset", 6).alias("offset"))


@query("sample_times", "select page_id, cast(k as int) as sample, round(duration * ((k + cast(0.5 as double)) / 6), 6) as t from (select page_id, duration, unnest(range(0, 6)) as k from {candidates})")
def _(get):
    return c.sample_times(get("candidates")).select("page_id", "sample", "t")


@query("segment_cycle", """select s.script_id, cast(k as int) as clip, s.seg_idx from (select script_id, unnest(range(0, 25)) as k from (select distinct script_id from {segments})) c join (select script_id, count(*) as n from {segments} group by 1) t on t.script_id = c.script_id
    join {segments} s on s.script_id = c.script_id and s.seg_idx = c.k % t.n""")
def _(get):
    s = get("segments")
    return c.segment_cycle(s, s.select("script_id").distinct().withColumn("clips", F.lit(25)), "script_id").select("script_id", "clip", F.col("seg_idx").cast("bigint").alias("seg_idx"))


# --- vectors

_SIM = """select s.script_id, s.seg_idx, m.media_idx, round(list_dot_product(cast(s.embedding as double[]), cast(m.embedding as double[])), 6) as sim, m.source, m.is_video from {segments} s join {media} m on m.script_id = s.script_id"""


def _sims(get):
    return match.segment_media_similarity(get("segments"), get("media"), "script_id")


def _scores(get):
    """One score per media item: its best over the segments."""
    best = _sims(get).groupBy("script_id", "media_idx").agg(F.max("sim").alias("score"))
    return get("media").drop("embedding").join(best, ["script_id", "media_idx"])


_SCORES = f"select script_id, media_idx, max(sim) as score, bool_or(is_video) as is_video from ({_SIM}) group by 1, 2"


@query("segment_media_similarity", f"select script_id, seg_idx, media_idx, sim from ({_SIM})")
def _(get):
    return _sims(get)


@query("best_media", f"select script_id, seg_idx, media_idx, sim from (select *, row_number() over (partition by script_id, seg_idx order by sim desc, media_idx) as rn from ({_SIM})) where rn = 1")
def _(get):
    return match.top_media(get("segments"), get("media"), "script_id")


@query("relevance_filter", f"""select script_id, media_idx from (select *, score >= 0.3 or is_video as g, count(*) filter (score >= 0.3 or is_video) over (partition by script_id) as n,
    row_number() over (partition by script_id order by score desc, media_idx) as rk from ({_SCORES})) where case when n < 24 then rk <= 24 else g end""")
def _(get):
    return match.relevance_filter(_scores(get), "script_id", 0.3, 24).select("script_id", "media_idx")


@query("hook_candidate", f"""select script_id, arg_max(media_idx, (s, -media_idx)) filter (ok) as idx, round(max(s) filter (ok), 6) as score from (select *, pos >= 0.1 and con >= 0 as ok, round(pos + 0.04 * sharp + 0.10 * con, 9) as s from (select script_id, media_idx, score as pos, score - 0.2 as con,
    (media_idx % 90 - min(media_idx % 90) over w) / (max(media_idx % 90) over w - min(media_idx % 90) over w + 1e-6) as sharp from ({_SCORES}) window w as (partition by script_id))) group by script_id""")
def _(get):
    frames = _scores(get).select("script_id", F.col("media_idx").alias("idx"), F.col("score").alias("pos"), (F.col("media_idx") % 90).cast("double").alias("sharpness"), F.array(F.lit(0.2), F.lit(0.1)).alias("negs"))
    return match.hook_candidate(frames, "script_id", 0.1, 0.0)


_PROB = f"""select script_id, media_idx, bool_or(is_video) as is_video, max(p) filter (seg_idx < 5) as p_pos, max(p) filter (seg_idx >= 5) as p_neg from
    (select *, e / sum(e) over (partition by script_id, media_idx) as p from (select *, exp(100 * (sim - max(sim) over (partition by script_id, media_idx))) as e from ({_SIM}))) group by 1, 2"""


@query("subject_presence_gate", f"""select script_id, media_idx, round(p_pos, 6) as p_pos, round(p_neg, 6) as p_neg from (select *, count(*) filter (take) over (partition by script_id) as anyn from (select *, ok or (rk <= 3 and p_pos >= 0.2) as take from
    (select *, row_number() over (partition by script_id order by ok desc, round(p_pos, 9) desc, media_idx) as rk from (select *, case when is_video then p_neg - p_pos < 0.35 else p_pos - p_neg >= 0.3 and p_pos >= 0.2 end as ok from ({_PROB}))))) where take or (anyn = 0 and rk <= 3)""")
def _(get):
    labels = _sims(get).select("script_id", "media_idx", (F.col("seg_idx") < 5).alias("positive"), F.col("sim").alias("cos"))
    media = get("media").select("script_id", "media_idx", "is_video")
    return match.subject_presence_gate(media, labels, "script_id", 0.3, 0.2, min_keep=3).select("script_id", "media_idx", "p_pos", "p_neg")


@query("modality_blend", f"""with s as materialized ({_SIM}), r as (select script_id, media_idx, media_idx // 8 as item, row_number() over (partition by script_id, media_idx // 8 order by media_idx) - 1 as nth, count(*) over (partition by script_id, media_idx // 8) as n from {{media}}),
    i as (select s.script_id, seg_idx, item, max(sim) as img from s join r on r.script_id = s.script_id and r.media_idx = s.media_idx where item % 4 > 0 and (n <= 3 or nth in (0, n // 3, 2 * n // 3)) group by all)
    select s.script_id, s.seg_idx, cast(s.media_idx // 8 as bigint) as media_idx, round(case when img is null then sim else cast(0.3 as double) * sim + cast(0.7 as double) * (img + 1) / 2 end, 9) as blend from s left join i on i.script_id = s.script_id and i.seg_idx = s.seg_idx and i.item = s.media_idx // 8 where s.media_idx % 8 = 0""")
def _(get):
    """Items of up to eight images, three of which stand for an item; each fourth item has no images."""
    s, item = _sims(get), F.floor(F.col("media_idx") / 8)
    images = get("media").select("script_id", "media_idx", item.alias("item")).where("item % 4 > 0")
    images = match.representative_images(images, ["script_id", "item"], "media_idx", 3)
    images = s.join(images, ["script_id", "media_idx"]).select("script_id", "seg_idx", F.col("item").alias("media_idx"), "sim")
    return match.modality_blend(s.where("media_idx % 8 = 0").withColumn("media_idx", item), images, "script_id")


@query("min_max_normalise", f"select script_id, media_idx, round((score - min(score) over (partition by script_id)) / (max(score) over (partition by script_id) - min(score) over (partition by script_id) + 1e-6), 6) as normal from ({_SCORES})")
def _(get):
    return timeline.min_max_normalise(_scores(get), "script_id", "score").select("script_id", "media_idx", F.round("normal", 6).alias("normal"))


@query("embed_distinct", "select page_id, md5(term) as embedding from {candidates}")
def _(get):
    return match.embed_distinct(get("candidates").select("page_id", "term"), "term", "term", lambda t: F.md5(t.cast("binary"))).select("page_id", "embedding")


@query("cached_results", "select page_id, md5(concat(page_id % 40, ':', term)) as embedding, case when page_id % 40 < 30 then 'known' else 'new' end as made from {candidates}")
def _(get):
    """A first run over some files, then one over all: what the first one made is not made again."""
    rows = get("candidates").select("page_id", F.concat(F.col("page_id") % 40, F.lit(":"), "term").alias("key"), (F.col("page_id") % 40).alias("file"), F.lit(7).alias("size"))
    where = shared_folder(rows.sparkSession, "cache")
    made = lambda run: lambda c: F.concat_ws("|", F.md5(c.cast("binary")), F.lit(run))
    cache.cached(rows.where("file < 30"), ["key", "size"], "key", made("known"), where)
    out = cache.cached(rows, ["key", "size"], "key", made("new"), where)
    return out.select("page_id", F.split_part("result", F.lit("|"), F.lit(1)).alias("embedding"), F.split_part("result", F.lit("|"), F.lit(2)).alias("made"))


@query("assign_media_to_segments")
def _(get):
    sims = match.assignment_similarity(get("segments"), get("media"), "script_id", 0.05)
    return match.assign_media_to_segments(sims, get("media"), "script_id", max_media_reuse=1, max_source_reuse=2, video_bonus=0.05, min_video_fraction=0.4)


@query("rank_media_for_script")
def _(get):
    return match.rank_media_for_script(_sims(get), "script_id")


@query("select_clips_for_script")
def _(get):
    audio = get("segments").select("script_id").distinct().withColumn("audio_s", F.lit(61.0))
    return match.select_clips_for_script(_sims(get), audio, "script_id", 4.0)
