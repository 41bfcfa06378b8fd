"""Domain tables over the driver's tables, once in SQL that Spark and DuckDB share (or one text for each)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Name -> SQL, or (Spark SQL, DuckDB SQL); {name} is another view or a table.
VIEWS: dict[str, str | tuple[str, str]] = {
    "content": """select p.p_partkey as content_id, concat(p.p_name, ' ', p.p_brand) as title, cast(sum(l.l_quantity) as bigint) as views,
        cast(sum(case when l.l_returnflag = 'R' then 1 else 0 end) as bigint) as subscribers, p.p_size as duration_s, p.p_brand as channel
        from {part} p join {lineitem} l on l.l_partkey = p.p_partkey group by p.p_partkey, p.p_name, p.p_brand, p.p_size having sum(l.l_quantity) > 0""",
    "content_raw": """select case when p_partkey % 31 = 0 then 'Total' else cast(p_partkey as string) end as content_id, p_name as title,
        case p_partkey % 11 when 0 then '1,200' when 1 then '' when 2 then '12.5' when 3 then ' 13 ' when 4 then '0' else cast(p_size as string) end as views,
        case p_partkey % 7 when 0 then '' when 1 then 'x' else cast(p_size as string) end as subscribers, case p_partkey % 5 when 0 then '' else '20' end as duration_s from {part}""",
    "words": (
        """select conv_id as script_id, turn as seg_idx, cast(p.pos as bigint) as word_idx, p.word as word, round(p.pos * cast(37 as double) / 100, 3) as start, round(p.pos * cast(37 as double) / 100 + cast(3 as double) / 10, 3) as `end`
        from {conversations} lateral view posexplode(split(text, ' ')) p as pos, word""",
        """select script_id, seg_idx, word_idx, word, round(word_idx * cast(37 as double) / 100, 3) as start, round(word_idx * cast(37 as double) / 100 + cast(3 as double) / 10, 3) as "end" from
        (select conv_id as script_id, turn as seg_idx, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as word_idx from {conversations})""",
    ),
    "tasks": """select user_id as task_id, event_id, ts, case event_type when 'error' then -1 when 'purchase' then 1 else 4 end as state, value as progress, event_type as stage,
        cast(floor(user_id / 10) as bigint) as job from {events}""",
    "series": (
        """select event_type as track, cast(unix_timestamp(date_trunc('HOUR', ts)) / 3600 as bigint) - 473352 as idx, round(sum(value), 2) as v,
        (cast(unix_timestamp(date_trunc('HOUR', ts)) / 3600 as bigint) - 473352) / cast(10 as double) as t from {events} group by 1, 2, 4""",
        """select event_type as track, cast(epoch(date_trunc('hour', ts)) / 3600 as bigint) - 473352 as idx, round(sum(value), 2) as v,
        (cast(epoch(date_trunc('hour', ts)) / 3600 as bigint) - 473352) / cast(10 as double) as t from {events} group by 1, 2, 4""",
    ),
    "candidates": """select page_id, url, cast(floor(page_id / 50) as bigint) as pool, regexp_extract(url, '//([^/]+)', 1) as term, cast(page_id % 3 as bigint) as term_ord, page_id as hit_ord,
        case when page_id % 3 = 0 then 'video' else 'image' end as kind, cast(2 + page_id % 17 as double) as duration,
        cast(300 + (page_id * 37) % 1500 as bigint) as width, cast(300 + (page_id * 53) % 1700 as bigint) as height,
        concat('/cache/', concat('Video', concat(cast(page_id % 40 as string), concat('_c', concat(cast(page_id % 5 as string), case when page_id % 2 = 0 then '.mp4.seg.mp4' else '.jpg' end))))) as path,
        cast((page_id * 7) % 256 as double) as brightness, cast((page_id * 3) % 40 as double) as contrast, cast((page_id * 5) % 50 as double) / 10 as edge_detail,
        cast((page_id * 11) % 100 as double) / 100 as dominant_share, cast((page_id * 13) % 60 as bigint) as n_colours, cast((page_id * 17) % 100 as double) / 100 as dark_border,
        cast((page_id * 19) % 120 as double) / 10 as detail, cast(500 + (page_id * 211) % 90000 as bigint) as bytes from {pages}""",
    "pools": "select distinct pool, cast(30 + pool % 10 * 5 as double) as audio_s from {candidates}",
    "lines": (
        "select doc_id as script_id, cast(p.pos as bigint) as line_idx, p.line as line from {documents} lateral view posexplode(split(text, chr(10))) p as pos, line where trim(p.line) <> ''",
        "select script_id, line_idx, line from (select doc_id as script_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_idx from {documents}) where trim(line) <> ''",
    ),
    # scripts of 10 segments and 40 media: as many as the vectors make
    "segments": "select cast(floor(vec_id / 50) as bigint) as script_id, cast(vec_id % 50 as bigint) as seg_idx, embedding from {embeddings} where vec_id % 50 < 10",
    "media": "select cast(floor(vec_id / 50) as bigint) as script_id, vec_id as media_idx, embedding, cast(label as string) as source, vec_id % 2 = 0 as is_video from {embeddings} where vec_id % 50 >= 10",
    "requests": """select o.o_orderkey as task_id, cast(o.o_custkey % 50 as bigint) as batch, d.text as script, case when o.o_orderkey % 9 = 0 then null else c.c_name end as subject,
        cast(o.o_orderkey % 4 as double) / 2 as voice_rate, case when o.o_orderkey % 13 = 0 then 2 else 1 end as video_count, case when o.o_orderkey % 17 = 0 then '16:9' else '9:16' end as aspect,
        case o.o_orderkey % 3 when 0 then 'azure:neural:en-US-GuyNeural-Male' when 1 then 'fr-FR-DeniseNeural-V2-Female' else 'en-GB-RyanNeural-Male' end as voice_name,
        case when o.o_orderkey % 5 = 0 then '' else 'He never lost a final' end as hook_text, case when o.o_orderkey % 6 = 0 then null else 'cover' end as hook_cover,
        case when o.o_orderkey % 4 = 0 then 'Follow for more' else 'What would you do?' end as cta_text, o.o_orderkey % 2 = 0 as loop_follow_tag, o.o_orderkey % 8 = 0 as comparison_mode,
        cast(o.o_orderkey % 4 as int) as comparison_clips, case o.o_orderstatus when 'F' then 'complete' when 'O' then 'failed' else 'pending' end as status, case when o.o_orderkey % 7 = 0 then 'search_images' else 'search' end as source,
        case o.o_orderkey % 19 when 3 then false when 4 then null else true end as enable_hook_card, o.o_orderkey % 16 <> 4 as enable_cta, case o.o_orderkey % 18 when 6 then '/pins/a.jpg' when 12 then ' ' end as hook_image_path,
        cast(case o.o_orderkey % 5 when 1 then 60 when 2 then 0 when 3 then null else 150 end as int) as max_words, cast(case o.o_orderkey % 7 when 1 then 30 when 2 then 0 when 3 then null else 70 end as double) as max_seconds,
        case o.o_orderkey % 3 when 0 then 'semantic' when 1 then 'sequential' else 'random' end as order_mode, o.o_totalprice / 5000 as audio_s
        from {orders} o join {customer} c on c.c_custkey = o.o_custkey join {documents} d on d.doc_id = o.o_orderkey % (select count(*) from {documents})""",
}


def _render(sql: str, dialect: int, table) -> str:
    def put(m: re.Match) -> str:
        name = m[1]
        if name in VIEWS:
            inner = VIEWS[name]
            return "(" + _render(inner if isinstance(inner, str) else inner[dialect], dialect, table) + ")"
        return table(name)

    return re.sub(r"\{(\w+)\}", put, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a domain view as a DataFrame; the scan gets the view's columns and filters by Catalyst."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_render("select * from {" + name + "}", 0, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def oracle(sql: str) -> str:
    return _render(sql, 1, lambda t: t)
