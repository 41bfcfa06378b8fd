"""Queries of content performance, requests and task state."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutroom.operators import content, requests, tasks

from .catalog import query

TOPICS = ("red", "blue", "green", "small", "large")
ALIASES = {"rouge": "red"}
_ROLE = """select c.*, round(views / m, 3) as reach_index, case when b = 0 then 0 else round(subs_per_1k / b, 3) end as conversion_index from
    (select *, round(subscribers * 1000.0 / views, 3) as subs_per_1k, median(views) over (partition by channel) as m, sum(subscribers) over (partition by channel) * 1000.0 / sum(views) over (partition by channel) as b from {content}) c"""
_TOPIC = "case when title like '%red%' or title like '%rouge%' then 'red' when title like '%blue%' then 'blue' when title like '%green%' then 'green' when title like '%small%' then 'small' when title like '%large%' then 'large' else 'other' end"
_BUCKET = "case when duration_s <= 15 then '10-15s' when duration_s <= 25 then '16-25s' when duration_s <= 40 then '26-40s' else '41s+' end"


@query("clean_content_rows", r"""select content_id, title, cast(trim(views) as bigint) as views, cast(case when trim(subscribers) = '' then '0' else trim(subscribers) end as bigint) as subscribers,
    cast(case when trim(duration_s) = '' then '0' else trim(duration_s) end as bigint) as duration_s from {content_raw}
    where content_id <> 'Total' and regexp_full_match(trim(views), '[+-]?\d+') and regexp_full_match(trim(subscribers), '([+-]?\d+)?') and try_cast(trim(views) as bigint) > 0""")
def _(get):
    return content.clean_content_rows(get("content_raw")).select("content_id", "title", "views", "subscribers", "duration_s")


@query("topic_cluster", f"select content_id, {_TOPIC} as topic from {{content}}")
def _(get):
    return content.topic_cluster(get("content"), keywords=TOPICS, aliases=ALIASES).select("content_id", "topic")


@query("conversion_per_1k", "select content_id, round(subscribers * 1000.0 / views, 3) as subs_per_1k from {content}")
def _(get):
    return content.conversion_per_1k(get("content")).select("content_id", "subs_per_1k")


@query("channel_summary", """select channel, count(*) as videos, cast(sum(views) as bigint) as views, cast(sum(subscribers) as bigint) as subscribers, median(views) as median_views,
    round(sum(subscribers) * 1000.0 / sum(views), 3) as baseline_per_1k from {content} group by channel""")
def _(get):
    return content.channel_summary(get("content"))


@query("merged_summary", """select channel, count(*) as videos, cast(sum(views) as bigint) as views, cast(sum(subscribers) as bigint) as subscribers, round(sum(subscribers) * 1000.0 / sum(views), 3) as baseline_per_1k,
    true as median_close, true as count_close from {content} group by channel""")
def _(get):
    """Sketches of parts of each channel, merged; the estimates are held against the exact values."""
    rows = get("content").withColumn("part", F.col("content_id") % 7)
    merged = content.merged_summary(content.summary_sketches(rows, ["channel", "part"]), ["channel"])
    share = lambda c: F.count_if(c) / F.count("*")
    close = (share(F.col("views") < F.col("median_views")) <= 0.52) & (share(F.col("views") <= F.col("median_views")) >= 0.48)
    exact = rows.select("channel", "content_id", "views").join(merged.select("channel", "median_views"), "channel").groupBy("channel").agg(close.alias("median_close"), F.count_distinct("content_id").alias("ids"))
    out = merged.join(exact, "channel")
    return out.select("channel", "videos", "views", "subscribers", "baseline_per_1k", "median_close", (F.abs(F.col("different_videos") - F.col("ids")) <= 0.02 * F.col("ids") + 1).alias("count_close"))


@query("reach_conversion_role", f"""select content_id, channel, views, subs_per_1k, reach_index, conversion_index, case when reach_index >= 1.5 and conversion_index >= 1.5 then 'hybrid_winner' when reach_index >= 1.5 then 'reach_winner'
    when conversion_index >= 1.5 then 'loyalty_winner' else 'baseline' end as role from ({_ROLE})""")
def _(get):
    return content.reach_conversion_role(get("content")).select("content_id", "channel", "views", "subs_per_1k", "reach_index", "conversion_index", "role")


@query("cluster_performance", f"""select channel, {_TOPIC} as topic, count(*) as videos, cast(sum(views) as bigint) as views, cast(sum(subscribers) as bigint) as subscribers,
    cast(round_even(cast(sum(views) as double) / count(*), 0) as bigint) as views_per_video, round(sum(subscribers) * 1000.0 / sum(views), 3) as subs_per_1k from {{content}} group by 1, 2""")
def _(get):
    return content.cluster_performance(content.topic_cluster(get("content"), keywords=TOPICS, aliases=ALIASES))


@query("duration_bucket", f"select content_id, {_BUCKET} as duration_bucket from {{content}}")
def _(get):
    return content.duration_bucket(get("content")).select("content_id", "duration_bucket")


@query("duration_performance", f"""select channel, {_BUCKET} as duration_bucket, count(*) as videos, cast(round_even(median(views), 0) as bigint) as median_views, round(sum(subscribers) * 1000.0 / sum(views), 3) as subs_per_1k
    from {{content}} group by 1, 2""")
def _(get):
    return content.duration_performance(get("content"))


@query("top_reach", "select channel, content_id, views, cast(rank as int) as rank from (select *, row_number() over (partition by channel order by views desc, content_id) as rank from {content}) where rank <= 10")
def _(get):
    return content.top_reach(get("content")).select("channel", "content_id", "views", "rank")


@query("top_conversion", """select channel, content_id, subs_per_1k, cast(rank as int) as rank from (select *, row_number() over (partition by channel order by subs_per_1k desc, views desc, content_id) as rank
    from (select *, round(subscribers * 1000.0 / views, 3) as subs_per_1k from {content} where views >= 500)) where rank <= 10""")
def _(get):
    return content.top_conversion(get("content")).select("channel", "content_id", "subs_per_1k", "rank")


def _json(order: str, **cells: str) -> str:
    """A JSON array of objects, one for each row, from SQL expressions of their values."""
    return "concat('[', string_agg(concat('{', " + ", ',', ".join(f"'\"{k}\":', {v}" for k, v in cells.items()) + f", '}}'), ',' order by {order}), ']')"


_DEFAULT_TOPIC = "case " + " ".join(f"when lower(title) like '%{a}%' then '{k}'" for a, k in (*((k, k) for k in content.TOPIC_KEYWORDS), *content.TOPIC_ALIASES.items())) + " else 'other' end"
_ROLED = f"select *, case when reach_index >= 1.5 and conversion_index >= 1.5 then 'hybrid_winner' when reach_index >= 1.5 then 'reach_winner' when conversion_index >= 1.5 then 'loyalty_winner' else 'baseline' end as role from ({_ROLE})"
_ITEM = dict(rank="rank", content_id="content_id", title="'\"' || title || '\"'", views="views", subs_per_1k="subs_per_1k", role="'\"' || role || '\"'")
_GROUPED = "count(*) as videos, cast(sum(views) as bigint) as views, median(views) as m, round(sum(subscribers) * 1000.0 / sum(views), 3) as subs_per_1k"


@query("strategy_report", f"""with c as (select *, {_DEFAULT_TOPIC} as topic, {_BUCKET} as bucket, row_number() over (partition by channel order by views desc, content_id) as rank from ({_ROLED})),
    d as (select *, row_number() over (partition by channel order by subs_per_1k desc, views desc, content_id) as rank2 from c where views >= 500)
    select s.*, top_reach, top_conversion, topics, durations from (select channel, count(*) as videos, cast(sum(views) as bigint) as views, cast(sum(subscribers) as bigint) as subscribers, median(views) as median_views, round(sum(subscribers) * 1000.0 / sum(views), 3) as baseline_per_1k from c group by channel) s
    left join (select channel, {_json("rank", **_ITEM)} as top_reach from c where rank <= 10 group by channel) a on a.channel = s.channel
    left join (select channel, {_json("rank2", **_ITEM | dict(rank="rank2"))} as top_conversion from d where rank2 <= 10 group by channel) b on b.channel = s.channel
    left join (select channel, {_json("topic", topic="'\"' || topic || '\"'", videos="videos", views="views", subs_per_1k="subs_per_1k")} as topics from (select channel, topic, {_GROUPED} from c group by 1, 2) group by channel) t on t.channel = s.channel
    left join (select channel, {_json("bucket", duration_bucket="'\"' || bucket || '\"'", videos="videos", median_views="cast(round_even(m, 0) as bigint)", subs_per_1k="subs_per_1k")} as durations from (select channel, bucket, {_GROUPED} from c group by 1, 2) group by channel) u on u.channel = s.channel""")
def _(get):
    return content.strategy_report(get("content")).withColumns({c: F.to_json(c) for c in ("top_reach", "top_conversion", "topics", "durations")})


_WORDS = r"len(regexp_extract_all(coalesce(script, ''), '[\p{L}\p{N}_’''-]+'))"


@query("overlay_defaults", """select task_id, case when task_id % 3 = 1 then null when task_id % 3 = 2 then 'own' else 'file' end as subject, case when task_id % 2 = 0 then '1.5' else '1' end as voice_rate from {requests}""")
def _(get):
    entry = F.concat(F.lit("{"), F.expr("case task_id % 3 when 1 then '\"subject\":null' when 2 then '\"subject\":\"own\"' else '' end"), F.expr("case when task_id % 2 = 0 then case when task_id % 3 in (1, 2) then ',' else '' end || '\"voice_rate\":1.5' else '' end"), F.lit("}"))
    raw = get("requests").select("task_id", F.lit('{"subject":"file","voice_rate":1}').alias("defaults"), entry.alias("entry"))
    return requests.overlay_defaults(raw, ["subject", "voice_rate"])


@query("narration_estimate", f"select task_id, cast({_WORDS} as int) as words, round({_WORDS} / (2.65 * greatest(0.5, coalesce(nullif(voice_rate, 0), 1))), 3) as estimated_s from {{requests}}")
def _(get):
    return requests.narration_estimate(get("requests")).select("task_id", "words", "estimated_s")


def _full(get):
    return get("requests").withColumns({"terms": F.when(F.col("task_id") % 10 > 0, F.array(F.lit("goal"))), "negative_terms": F.when(F.col("task_id") % 11 > 0, F.array(F.lit("crowd"))), "hook_require_video": F.col("task_id") % 3 > 0})


_PREFLIGHT = f"""select *, {_WORDS} as words, {_WORDS} / (2.65 * greatest(0.5, coalesce(nullif(voice_rate, 0), 1))) as est, trim(coalesce(script, '')) = '' as no_script, coalesce(nullif(max_words, 0), 120) as most,
    coalesce(nullif(max_seconds, 0), 60) as ceiling, not comparison_mode as told, not comparison_mode and coalesce(enable_hook_card, true) as hook, not comparison_mode and coalesce(enable_cta, true) as cta from {{requests}}"""


@query("preflight_report", f"""select task_id, batch, concat_ws('|', case when video_count <> 1 then 'video_count=1 is required' end, case when aspect <> '9:16' then 'aspect must be 9:16' end,
    case when comparison_mode and comparison_clips < 2 then 'comparison needs two clips' end, case when told and trim(coalesce(subject, '')) = '' then 'video_subject must be supplied' end, case when told and no_script then 'video_script must be supplied' end,
    case when told and task_id % 10 = 0 then 'video_terms must be supplied' end, case when told and not no_script and words < 12 then 'script is too short' end, case when told and words > most then 'script is too long' end,
    case when told and est > ceiling then 'narration is too long' end, case when hook and hook_text = '' then 'hook_text must be supplied' end,
    case when hook and hook_cover is null and trim(coalesce(hook_image_path, '')) = '' then 'hook_cover_term or hook_image_path must be supplied' end) as errors,
    concat_ws('|', case when told and est > 45 then 'narration is over 45 seconds' end, case when hook and task_id % 11 = 0 and task_id % 3 > 0 then 'no contrasting negatives' end, case when cta and cta_text = 'Follow for more' then 'generic call to action' end,
    case when told and regexp_matches(script, '(?i)\\b(ended (?:his|her|their) career|never|always|first ever|on purpose)\\b') then 'absolute claim' end) as warnings
    from ({_PREFLIGHT})""")
def _(get):
    rows = requests.preflight_report(_full(get), 120, 60.0)
    return rows.select("task_id", "batch", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query("batch_status_summary", """select batch, count(*) as requests, count(*) filter (status = 'complete') as complete, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'pending') as pending,
    bool_or(subject is null or video_count <> 1) as blocked from {requests} group by batch""")
def _(get):
    return requests.batch_status_summary(get("requests").withColumn("ok", F.expr("subject is not null and video_count = 1")))


@query("risky_claims", r"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat(' ', regexp_replace(coalesce(text, ''), '([^\p{L}\p{N}_])', '\1\1', 'g'), ' '), '(?i)[^\p{L}\p{N}_](the|only|her|that|on)[^\p{L}\p{N}_]', 1), lambda x: lower(x)))), '|') as claims from {documents}""")
def _(get):
    # a word's edge is any character that is no letter, digit or _, in whatever language; RE2 has it for ASCII only
    rows = requests.risky_claims(get("documents"), "text", r"(?i)\b(the|only|her|that|on)\b")
    return rows.select("doc_id", F.array_join("claims", "|").alias("claims"))


@query("apply_growth_profile", """select task_id, concat_ws('|', case when loop_follow_tag then 'follow tag removed' end, case when cta_text like 'Follow%' then 'generic call to action replaced' end) as changes,
    case when cta_text like 'Follow%' then 'FOLLOW FOR UNTOLD FOOTBALL STORIES ⚡' else cta_text end as cta_text from {requests}""")
def _(get):
    return requests.apply_growth_profile(get("requests")).select("task_id", F.array_join("changes", "|").alias("changes"), "cta_text")


@query("request_fingerprint", """select task_id, fingerprint, substr(sha256(concat(fingerprint, ':', task_id)), 1, 16) as edit_seed from (select task_id, sha256(concat('{"aspect":"', aspect, '","status":"', status, '","video_count":', video_count, '}')) as fingerprint from {requests})""")
def _(get):
    return requests.request_fingerprint(get("requests"), ["video_count", "aspect", "status"]).select("task_id", "fingerprint", "edit_seed")


@query("narration_fit_plan", """select task_id, audio_s > 40 as blocked, case when audio_s > 40 then round(audio_s / (40 - 0.08), 6) end as tempo, case when audio_s > 40 then audio_s / (40 - 0.08) between 0.5 and 2.0 else true end as safe from {requests}""")
def _(get):
    return requests.narration_fit_plan(get("requests"), 40.0).select("task_id", "blocked", "tempo", "safe")


@query("voice_route", """select task_id, case task_id % 3 when 0 then 'azure' when 1 then 'azure-v2' else 'azure-v1' end as provider, case when task_id % 3 = 0 then 'neural' end as model, case when task_id % 3 = 1 then 'Female' else 'Male' end as gender,
    case task_id % 3 when 0 then 'en-US-GuyNeural' when 1 then 'fr-FR-DeniseNeural' else 'en-GB-RyanNeural' end as voice, case task_id % 3 when 0 then 'en-US' when 1 then 'fr-FR' else 'en-GB' end as locale,
    concat(case when voice_rate >= 1 then '+' else '' end, cast(cast(round_even((voice_rate - 1) * 100, 0) as int) as string), '%') as rate_text from {requests}""")
def _(get):
    return requests.voice_route(get("requests")).select("task_id", "provider", "model", "gender", "voice", "locale", "rate_text")


@query("effective_order_mode", "select task_id, case when source = 'search_images' then 'sequential' when video_count > 1 and order_mode = 'semantic' then 'random' else order_mode end as effective_order from {requests}")
def _(get):
    return requests.effective_order_mode(get("requests")).select("task_id", "effective_order")


_LATEST = "select task_id, job, arg_max(state, (ts, event_id)) as state, cast(least(100, floor(arg_max(progress, (ts, event_id)))) as int) as progress from {tasks} group by task_id, job"


@query("latest_task_state", f"select task_id, state, progress from ({_LATEST})")
def _(get):
    return tasks.latest_task_state(get("tasks"))


@query("claim_once_ledger", """select event_id, task_id, stage, rn = 1 as accepted, case when rn > 1 then 'stage already claimed' end as reason from (select *, row_number() over (partition by task_id, stage order by ts, event_id) as rn from {tasks})""")
def _(get):
    return tasks.claim_once_ledger(get("tasks").select("event_id", "task_id", "stage", "ts")).drop("ts")


@query("resume_eligibility", """with l as (select task_id, arg_max(stage, ts) filter (stage in ('error', 'purchase')) as f, list_sort(list_distinct(list(stage) filter (stage in ('view', 'click')))) as s from {tasks} group by task_id)
    select task_id, reason is null as eligible, reason from (select task_id, case when f is null or f <> 'error' then 'not failed' when s is distinct from ['view'] then 'other stages were claimed' end as reason from l)""")
def _(get):
    t = get("tasks")
    kind = "case when stage in ('view', 'click') then 'claim' when stage in ('error', 'purchase') then 'finish' else 'reserve' end"
    ledger = t.selectExpr("task_id", "ts", f"{kind} as kind", "case stage when 'view' then 'voice_generation' when 'click' then 'render' end as stage", "case stage when 'error' then 'failed' when 'purchase' then 'complete' end as status", "'over the retention ceiling' as error", "'f' as fingerprint")
    reserve = t.select("task_id").distinct().selectExpr("task_id", "timestamp'2000-01-01' as ts", "'reserve' as kind", "null as stage", "null as status", "null as error", "'f' as fingerprint")
    return tasks.resume_eligibility(ledger.unionByName(reserve), t.select("task_id").distinct().withColumn("fingerprint", F.lit("f")))


@query("overlap_and_stale_runs", """with recursive r as materialized (select task_id as slot, event_id as run_id, epoch_us(ts) / 1e6 as start_s, epoch_us(ts) / 1e6 + progress * 20 as end_s, row_number() over (partition by task_id order by ts, event_id) as i from {tasks}),
    f as (select slot, run_id, i, end_s as free, true as ok, end_s - start_s > 1800 as stale from r where i = 1 union all select r.slot, r.run_id, r.i, case when r.start_s >= f.free then r.end_s else f.free end, r.start_s >= f.free, r.start_s >= f.free and r.end_s - r.start_s > 1800
    from f join r on r.slot = f.slot and r.i = f.i + 1) select slot, run_id, ok as accepted, stale from f""")
def _(get):
    rows = get("tasks").selectExpr("task_id as slot", "event_id as run_id", "cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 as start_s", "cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 + progress * 20 as end_s")
    return tasks.overlap_and_stale_runs(rows, "slot")


@query("task_progress_rollup", f"""select job, count(*) filter (state = 1) as completed, count(*) filter (state = -1) as failed, count(*) filter (state = 4) as running, round(avg(progress), 3) as progress from ({_LATEST}) group by job""")
def _(get):
    return tasks.task_progress_rollup(get("tasks"), "job")


@query("task_page", "select event_id, case when event_id % 2 = 0 then concat('http://localhost/tasks/', event_id) else concat('/other/', event_id) end as path, (select count(*) from {tasks}) as total from {tasks} order by event_id limit 20 offset 40")
def _(get):
    rows = get("tasks").selectExpr("event_id", "case when event_id % 2 = 0 then concat('/tasks/', event_id) else concat('/other/', event_id) end as path")
    return tasks.task_page(rows, 3, 20, ["event_id"])


@query("typed_from_text", """select event_id, case when event_id % 3 = 0 then event_id end as as_int, case event_id % 3 when 0 then 'int' when 1 then 'list' else 'text' end as kind, case when event_id % 3 = 1 then concat('a|', event_id) end as items from {tasks}""")
def _(get):
    rows = get("tasks").selectExpr("event_id", "case event_id % 3 when 0 then cast(event_id as string) when 1 then concat(\"['a', '\", event_id, \"']\") else concat('t', event_id) end as value")
    return tasks.typed_from_text(rows).select("event_id", "as_int", "kind", F.array_join("as_list", "|").alias("items"))
