"""Queries of sources and sinks of files: tables are written as the files that a reader expects and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutroom.operators import tasks
from cutroom.sources import readers, writers
from cutroom.sources.folders import shared_folder
from cutroom.streaming import tasks as streams

from .catalog import query


@query("read_analytics_export", "select content_id, title, nullif(views, '') as views, nullif(subscribers, '') as subscribers, nullif(duration_s, '') as duration_s from {content_raw} where content_id <> 'Total'")
def _(get):
    raw = get("content_raw")
    where = shared_folder(raw.sparkSession, "export")
    table = raw.select(*(F.col(c).alias(name) for name, c in readers.EXPORT_COLUMNS.items()))
    table.write.csv(where, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_analytics_export(raw.sparkSession, where)


@query("read_batch_requests", """select batch, cast(row_number() over (partition by batch order by task_id) - 1 as int) as ordinal, concat('{"voice":"v', batch, '"}') as defaults,
    concat('{"task_id":', task_id, ',"hook":"', hook_text, '","tag":', case when loop_follow_tag then 'true' else 'false' end, '}') as entry from {requests}""")
def _(get):
    rows = get("requests").select("batch", F.struct("task_id", F.col("hook_text").alias("hook"), F.col("loop_follow_tag").alias("tag")).alias("v"))
    where = shared_folder(rows.sparkSession, "batches")
    files = rows.groupBy("batch").agg(F.sort_array(F.collect_list("v")).alias("videos"))
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("v"), "batch").alias("voice")).alias("defaults"), "videos"))
    files.select("batch", body.alias("value")).write.partitionBy("batch").text(where)
    return readers.read_batch_requests(rows.sparkSession, where).select(F.regexp_extract("file", r"batch=(\d+)", 1).cast("bigint").alias("batch"), "ordinal", "defaults", "entry")


@query("read_media_sidecars", """select concat('/cache/', pool, '/clip.', page_id, '.mp4') as path, case when page_id % 3 = 0 and page_id % 4 <> 1 then term else concat('clip.', page_id) end as search_term,
    case when page_id % 3 = 0 and page_id % 2 = 0 then bytes else width end as file_size, case when page_id % 3 = 0 then cast(page_id as double) / 4 else cast(1000 + page_id as double) end as created_at from {candidates}""")
def _(get):
    """Listings of media files and of sidecars that other folders' paths are written in; some lack a field."""
    rows = get("candidates").withColumn("place", F.concat(F.lit("/cache/"), "pool", F.lit("/clip."), "page_id"))
    media = rows.select(F.concat("place", F.lit(".mp4")).alias("path"), F.col("width").alias("file_size"), F.timestamp_seconds(F.col("page_id") + 1000).alias("modified"))
    fields = F.struct(F.lit("/elsewhere/old.mp4").alias("video_path"), F.when(F.col("page_id") % 4 != 1, F.col("term")).alias("search_term"), F.when(F.col("page_id") % 2 == 0, F.col("bytes")).alias("file_size"), (F.col("page_id") / 4).alias("created_at"))
    sidecars = rows.where("page_id % 3 = 0").select(F.concat("place", F.lit(readers.SIDECAR)).alias("path"), F.to_json(fields).alias("value"))
    return readers.with_sidecars(media, sidecars)


@query("read_task_manifests", """select concat('job=', job) as task_id, concat('job ', job) as script, array_to_string(list_sort(list_distinct(list(stage))), '|') as terms, concat('{"events":', count(*), '}') as params from {tasks} group by job""")
def _(get):
    jobs = get("tasks").groupBy("job").agg(F.sort_array(F.collect_set("stage")).alias("stages"), F.count("*").alias("events"))
    where = shared_folder(jobs.sparkSession, "manifests")
    terms = F.when(F.col("job") % 2 == 0, F.to_json("stages")).otherwise(F.concat(F.lit('"'), F.array_join("stages", ", "), F.lit('"')))  # a list, or a text
    body = F.concat(F.lit('{"script":"job '), "job", F.lit('","search_terms":'), terms, F.lit(',"params":{"events":'), "events", F.lit("}}"))
    jobs.select("job", body.alias("value")).write.partitionBy("job").text(where)
    return readers.read_task_manifests(jobs.sparkSession, where).withColumn("terms", F.array_join("terms", "|"))


@query("write_caption_json", "select script_id, line_idx, line from {lines}")
def _(get):
    lines = get("lines")
    where = shared_folder(lines.sparkSession, "captions")
    writers.write_caption_json(lines, where)
    return lines.sparkSession.read.schema(lines.schema).json(where)


@query("write_quality_reports", "select pool, case when pool % 2 = 0 then 'second' else 'first' end as run, count(*) as clips from {candidates} group by pool")
def _(get):
    """Reports of all pools, then those of every second pool again: these are replaced, the others stay."""
    reports = get("candidates").groupBy("pool").agg(F.count("*").alias("clips"))
    where = shared_folder(reports.sparkSession, "reports")
    writers.write_quality_reports(reports.withColumn("run", F.lit("first")), "pool", where)
    writers.write_quality_reports(reports.where("pool % 2 = 0").withColumn("run", F.lit("second")), "pool", where)
    return reports.sparkSession.read.schema("clips bigint, run string, pool bigint").json(where).select("pool", "run", "clips")


@query("upserted_states", "select task_id, state, least(100, cast(floor(coalesce(progress, 0)) as int)) as progress, event_id from (select *, row_number() over (partition by task_id order by ts desc, event_id desc) as rn from {tasks}) where rn = 1")
def _(get):
    """All updates in four batches that aren't in order of time, one of which is repeated, through the stream's sink."""
    updates = get("tasks").select("task_id", "ts", "event_id", "state", "progress")
    where = shared_folder(updates.sparkSession, "states")
    write = streams.upsert_states(where)
    for number, part in enumerate((2, 0, 3, 1)):
        for _ in range(1 + (number == 2)):
            write(updates.where(F.col("event_id") % 4 == part), number)
    table = streams.states(updates.sparkSession, where)
    return tasks.latest_task_state(table).join(table.select("task_id", "event_id"), "task_id")
