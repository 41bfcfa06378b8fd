"""Queries of timelines and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutroom.operators import timeline

from .catalog import query

_AUDIO = "(select script_id, max(\"end\") + 1 as audio_s from {words} group by script_id)"


def _audio(get):
    return get("words").groupBy("script_id").agg((F.max("end") + 1).alias("audio_s"))


def _clips(get):
    """Clips of a pool in page order."""
    return get("candidates").select("pool", "page_id", "duration")


@query("cut_times", """select pool, page_id, round(cut, 3) as cut from (select pool, page_id, sum(duration) over (partition by pool order by page_id) as cut, lead(page_id) over (partition by pool order by page_id) as nx from {candidates}) where nx is not null""")
def _(get):
    return timeline.cut_times(_clips(get), "pool", "page_id")


_TICKS = """select script_id, line_idx, cast(floor(length(line) * floor(cast(60.5 as double) * 10000000) / cast(sum(length(line)) over (partition by script_id) as bigint)) as bigint) as k from {lines}"""


@query("proportional_timing", f"""select script_id, line_idx, cast(sum(k) over (partition by script_id order by line_idx) - k as bigint) as start_tick, cast(sum(k) over (partition by script_id order by line_idx) as bigint) as end_tick from ({_TICKS})""")
def _(get):
    lines = get("lines").withColumnRenamed("line", "sentence")
    totals = lines.select("script_id").distinct().withColumn("total_s", F.lit(60.5))
    return timeline.proportional_timing(lines, totals, "script_id", "line_idx").select("script_id", "line_idx", "start_tick", "end_tick")


@query("chunk_offset_shift", """select script_id, seg_idx, word_idx, round(start + o, 3) as start, round("end" + o, 3) as "end" from {words} join
    (select script_id, seg_idx, coalesce(sum(len) over (partition by script_id order by seg_idx rows between unbounded preceding and 1 preceding), 0) as o from (select script_id, seg_idx, arg_max("end", word_idx) as len from {words} group by 1, 2)) using (script_id, seg_idx)""")
def _(get):
    return timeline.chunk_offset_shift(get("words"), "script_id", "seg_idx", "word_idx").select("script_id", "seg_idx", "word_idx", "start", "end")


@query("segment_windows", """select script_id, seg_idx, start, round(d + case when nx is null then greatest(0, audio_s - sum(d) over (partition by script_id)) + 0.35 else 0 end, 3) as duration from
    (select *, greatest(0.4, coalesce(nx, e) - start) as d from (select *, lead(start) over (partition by script_id order by seg_idx) as nx from (select script_id, seg_idx, cast(seg_idx * 3 as double) as start, cast(seg_idx * 3 + 2 as double) as e from {words} group by script_id, seg_idx)))
    join (select script_id, cast(30 as double) as audio_s from {words} group by script_id) using (script_id)""")
def _(get):
    captions = get("words").select("script_id", "seg_idx").distinct().withColumns({"start": (F.col("seg_idx") * 3).cast("double"), "end": (F.col("seg_idx") * 3 + 2).cast("double")})
    audio = captions.select("script_id").distinct().withColumn("audio_s", F.lit(30.0))
    return timeline.segment_windows(captions, audio, "script_id", "seg_idx")


@query("energy_drop", """select track, case when max(d) > 0 then arg_max(t, (d, -t)) else 0 end as drop_time from (select track, t, round(m - lag(m) over (partition by track order by t), 6) as d from
    (select track, t, sum(v) over (partition by track order by t rows between 1 preceding and 1 following) / 3 as m from {series})) where t <= 45 and d is not null group by track""")
def _(get):
    return timeline.energy_drop(get("series"), "track", energy="v")


@query("onset_peaks")
def _(get):
    return timeline.onset_peaks(get("series"), "track", onset="v", min_gap=0.25)


@query("dominant_period", """with c as (select track, idx, v - avg(v) over (partition by track) as x from {series}), s as (select a.track, b.idx - a.idx as lag, round(sum(a.x * b.x), 6) as s from c a join c b on a.track = b.track and b.idx - a.idx between 3 and 9 group by 1, 2), b as (select track, arg_max(lag, (s, -lag)) as lag from s group by track), n as (select track, count(*) as n from {series} group by track)
    select n.track, case when n > 10 then round(600.0 / lag, 1) end as bpm from n left join b on b.track = n.track""")
def _(get):
    return timeline.dominant_period(get("series"), "track", onset="v", fps=10.0)


@query("crossfade_timeline", """select pool, page_id, round(coalesce(sum(duration) over (partition by pool order by page_id rows between unbounded preceding and 1 preceding), 0) - cast(0.5 as double) * (row_number() over (partition by pool order by page_id) - 1), 6) as start,
    round(sum(duration) over (partition by pool) - cast(0.5 as double) * (count(*) over (partition by pool) - 1), 6) as total from {candidates}""")
def _(get):
    return timeline.crossfade_timeline(_clips(get), "pool", "page_id", 0.5)


@query("speech_end", """select pool, case when pool % 2 = 0 and s > 1 then round(s, 3) end as speech_end from (select pool, max(duration + page_id) - 0.4 as s from {candidates} group by pool)""")
def _(get):
    rows = get("candidates").select("pool", (F.col("duration") + F.col("page_id") - 0.4).alias("start"), (F.col("duration") + F.col("page_id")).alias("end"))
    totals = rows.groupBy("pool").agg((F.max("end") + F.col("pool") % 2).alias("total_s"))
    return timeline.speech_end(rows, totals, "pool")


@query("drop_alignment", """select track, greatest(0.0, cast(12 as double) - 5) as music_start, round(t - 7, 6) as t from {series} where t - 7 between 0 and 30""")
def _(get):
    s = get("series")
    keys = s.select("track").distinct()
    return timeline.drop_alignment(s.select("track", F.col("t").alias("beat")), keys.withColumn("drop_time", F.lit(12.0)), keys.withColumns({"seam": F.lit(5.0), "total_s": F.lit(30.0)}), "track")


@query("speech_target", f"""select script_id, case when last > 0 and last <= audio_s then last else audio_s end as target_s from (select script_id, arg_max("end", (seg_idx, word_idx)) as last from {{words}} group by script_id) join {_AUDIO} using (script_id)""")
def _(get):
    return timeline.speech_target(get("words"), _audio(get), "script_id", ["seg_idx", "word_idx"])


@query("nearest_event_snap", """select track, t, case when b is null then t else b end as snapped from (select p.track, p.t, arg_min(b.t, (round(abs(b.t - p.t), 9), b.t)) as b from (select track, t + 0.13 as t from {series}) p left join (select track, t from {series} where idx % 7 = 0) b on b.track = p.track group by 1, 2)""")
def _(get):
    s = get("series")
    return timeline.nearest_event_snap(s.select("track", (F.col("t") + 0.13).alias("t")), s.where("idx % 7 = 0").select("track", F.col("t").alias("beat")), "track")


@query("loop_fill_to_duration", """with c as (select k.pool, page_id, duration, audio_s * 60 as audio_s, sum(duration) over (partition by k.pool) as total from {candidates} k join {pools} p on p.pool = k.pool),
    r as (select *, unnest(range(1, cast(greatest(1, case when total >= audio_s then 1 else ceil(audio_s / total) end) as bigint) + 1)) as n from c)
    select pool, cast(n as int) as "loop", page_id, duration, round(b, 6) as start from (select *, coalesce(sum(duration) over (partition by pool order by n, page_id rows between unbounded preceding and 1 preceding), 0) as b from r) where n = 1 or round(b, 6) < audio_s""")
def _(get):
    targets = get("pools").select("pool", (F.col("audio_s") * 60).alias("audio_s")).withColumn("speech_s", F.col("audio_s"))
    return timeline.loop_fill_to_duration(_clips(get), targets, "pool", "page_id")


@query("pin_and_loop_edits", """select pool, ord, case when ord = max(ord) over (partition by pool) and pool % 2 = 0 then 'cover' when ord < 2 then concat('pin', ord) else path end as path from (select pool, path, row_number() over (partition by pool order by page_id) - 1 as ord from {candidates})""")
def _(get):
    from pyspark.sql import Window

    rows = get("candidates").select("pool", "path", (F.row_number().over(Window.partitionBy("pool").orderBy("page_id")).cast("bigint") - 1).alias("ord"))
    pins = rows.where("ord < 2").select("pool", "ord", F.concat(F.lit("pin"), F.col("ord")).alias("path"))
    covers = rows.select("pool").distinct().withColumns({"cover": F.lit("cover"), "cover_is_video": F.col("pool") % 2 != 0})
    return timeline.pin_and_loop_edits(rows, pins, covers, "pool", "ord")


@query("timestamp_validity", """select script_id, count(*) filter (trim(word) <> '' and word_idx % 10 <> 0) as kept, count(*) filter (trim(word) = '' or word_idx % 10 = 0) as dropped from {words} group by script_id""")
def _(get):
    from cutroom.operators.candidates import timestamp_validity

    return timestamp_validity(get("words").withColumn("end", F.expr("case when word_idx % 10 = 0 then null else `end` end")), "script_id")


@query("highlight_spans", r"""with c as (select script_id, seg_idx, cast(0 as double) as c0, round(max("end"), 3) - 0.1 as c1, regexp_split_to_array(lower(string_agg(word, ' ' order by word_idx) filter (word_idx % 3 <> 1)), '\s+') as t from {words} group by 1, 2 union all select distinct script_id, 1000, cast(1 as double), cast(2 as double), ['alone'] from {words}),
    w as (select w.script_id, w.seg_idx, word_idx, trim(lower(word)) as word, start, greatest(round(start, 3), c0) as w0, least(round("end", 3), c1) as w1, c1, t from {words} w join c on c.script_id = w.script_id and c.seg_idx = w.seg_idx),
    v as (select *, lag(w1) over (partition by script_id, seg_idx order by start, word_idx) as p, lead(word_idx) over (partition by script_id, seg_idx order by start, word_idx) is null as l from w where w1 > w0)
    select script_id, seg_idx, 'plain' as kind, round(coalesce(p, 0), 3) as "from", round(w0, 3) as "to", null as token from v where w0 > coalesce(p, 0) union all select script_id, seg_idx, 'highlight', round(w0, 3), round(w1, 3), word from v where word <> '' and list_contains(t, lower(word))
    union all select script_id, seg_idx, 'plain', round(w1, 3), round(c1, 3), null from v where l and c1 > w1 union all select c.script_id, c.seg_idx, 'plain', round(c0, 3), round(c1, 3), null from c where c1 > c0 and not exists (select 1 from v where v.script_id = c.script_id and v.seg_idx = c.seg_idx)""")
def _(get):
    """Captions whose text lacks each third word, words in small letters, and one caption of each script without words."""
    w = get("words")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word_idx") % 3 != 1, F.struct("word_idx", "word")))), lambda x: x["word"]), " ")
    captions = w.groupBy("script_id", "seg_idx").agg(F.lit(0.0).alias("start"), (F.round(F.max("end"), 3) - 0.1).alias("end"), text.alias("text"))
    alone = w.select("script_id").distinct().withColumns({"seg_idx": F.lit(1000), "start": F.lit(1.0), "end": F.lit(2.0), "text": F.lit("alone")})
    return timeline.highlight_spans(captions.unionByName(alone), w.withColumn("word", F.lower("word")), "script_id", "seg_idx")


@query("sticker_spacing", """with recursive w as materialized (select concat(script_id, '-', seg_idx) as script, start as t, row_number() over (partition by script_id, seg_idx order by start) as i from {words}),
    f as (select script, t, i, t as last from w where i = 1 union all select w.script, w.t, w.i, case when w.t - f.last >= cast(1.2 as double) then w.t else f.last end from f join w on w.script = f.script and w.i = f.i + 1) select script, t from f where t = last""")
def _(get):
    return timeline.sticker_spacing(get("words").select(F.concat_ws("-", "script_id", "seg_idx").alias("script"), F.col("start").alias("t")), "script", gap=1.2)
