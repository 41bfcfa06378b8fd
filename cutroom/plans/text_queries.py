"""Queries of text segmentation, captions and captured replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutroom.functions import text as x
from cutroom.sources import readers, writers

from .catalog import query


def _docs(get):
    return get("documents").select("doc_id", "text")


def _units(get):
    """Lines of a script as captions: (script_id, line_idx, text, start, end)."""
    return get("lines").select("script_id", F.col("line_idx").alias("cue_idx"), F.col("line").alias("text"), (F.col("line_idx") * 2.0).alias("start"), (F.col("line_idx") * 2.0 + 1.5).alias("end"))


def _fold(rows: str, first: str, over: str, step: str = "concat(a.open, ' ', s.v)", keys: str = "doc_id") -> str:
    """SQL that joins the values v of ``rows`` (keys, i from 1, v) in order into groups numbered from 0: at each value ``over``
    says whether a new group (``first``) begins, else ``step`` goes on; (keys, g, open) with the last state of each group."""
    on = " and ".join(f"s.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""(with recursive v as materialized ({rows}), f as (select {keys}, i, {first} as open, 0 as g from v s where i = 1
        union all select {mine}, s.i, case when {over} then {first} else {step} end as open, a.g + cast({over} as int) as g from f a join v s on {on} and s.i = a.i + 1)
        select {keys}, g, arg_max(open, i) as open from f group by {keys}, g)"""


#: Sentences of a text that keep their marks, numbered from 1.
_MARKED = r"""select doc_id, generate_subscripts(l, 1) as i, unnest(l) as v from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as l from {documents})"""
_N_WORDS = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> ''))"


@query("split_sentences", r"""select doc_id, cast(generate_subscripts(l, 1) - 1 as int) as pos, unnest(l) as sentence from (select doc_id, case when len(l) = 0 then [text] else l end as l from
    (select doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '') as l from {documents}))""")
def _(get):
    return x.split_sentences(_docs(get)).select("doc_id", "pos", "sentence")


_SENTENCES = r"""select doc_id, generate_subscripts(l, 1) as i, unnest(l) as v from (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '') as l from {documents})"""


@query("split_sentences_merged", f"""with g as {_fold(_SENTENCES, "s.v", "length(a.open) >= 30")}, m as (select doc_id, case when g > 0 and length(open) < 30 then g - 1 else g end as pos, g, open from g)
    select doc_id, cast(pos as int) as pos, string_agg(open, ' ' order by g) as sentence from m group by doc_id, pos union all select doc_id, cast(0 as int), text from {{documents}} where doc_id not in (select doc_id from g)""")
def _(get):
    return x.split_sentences(_docs(get), min_len=30).select("doc_id", "pos", "sentence")


@query("segment_script")
def _(get):
    return x.segment_script(_docs(get)).select("doc_id", "pos", "segment")


@query("split_on_punctuation", r"""select doc_id, cast(generate_subscripts(l, 1) - 1 as int) as pos, unnest(l) as unit from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '[\n.?,、;:!…？，。；：！]'),
    lambda s: replace(trim(s), chr(1), '.')), lambda s: s <> '') as l from {documents})""")
def _(get):
    # the point at a number's end: this table's texts have digits on both sides of a point or on none
    return x.split_on_punctuation(_docs(get)).select("doc_id", "pos", "unit")


@query("chunk_by_words", f"""select doc_id, cast(g as int) as pos, open as chunk, cast({_N_WORDS.format(c='open')} as int) as words, round({_N_WORDS.format(c='open')} / cast(130 as double), 3) as minutes from {_fold(_MARKED, "s.v", _N_WORDS.format(c="concat(a.open, ' ', s.v)") + " > 130")}""")
def _(get):
    return x.chunk_by_words(_docs(get)).select("doc_id", "pos", "chunk", "words", "minutes")


@query("chunk_by_chars", f"""select doc_id, cast(g as int) as pos, open as chunk from {_fold(_MARKED + " where doc_id in (select doc_id from {documents} where length(text) > 300)", "s.v", "length(concat(a.open, ' ', s.v)) > 300")} union all select doc_id, cast(0 as int), text from {{documents}} where length(text) <= 300""")
def _(get):
    return x.chunk_by_chars(_docs(get)).select("doc_id", "pos", "chunk")


_TIMED = "select script_id, seg_idx, row_number() over (partition by script_id, seg_idx order by word_idx) as i, trim(word) as v, word, start, \"end\" from {words} where trim(word) <> ''"
_FULL = "len(a.open.x) >= 4 or list_sum(list_transform(a.open.x, lambda w: length(w) + 1)) > 80 or regexp_matches(a.open.x[-1], '[?,.、;:!…？，。；：！]')"


@query("caption_groups", f"""select g.script_id, g.seg_idx, cast(g.g as int) as "group", round(a.start, 3) as start, round(z."end", 3) as "end", open.t as text from
    {_fold(_TIMED, "{x: [s.v], t: s.word, b: s.i, e: s.i}", _FULL, "{x: list_append(a.open.x, s.v), t: concat(a.open.t, ' ', s.word), b: a.open.b, e: s.i}", "script_id, seg_idx")} g
    join ({_TIMED}) a on a.script_id = g.script_id and a.seg_idx = g.seg_idx and a.i = g.open.b join ({_TIMED}) z on z.script_id = g.script_id and z.seg_idx = g.seg_idx and z.i = g.open.e""")
def _(get):
    return x.caption_groups(get("words"), ["script_id", "seg_idx"], "word_idx")


_SPOKEN = "select conv_id, turn, generate_subscripts(l, 1) as i, unnest(l) as v, len(array_to_string(l, '')) / len(l) >= 15 as long from (select conv_id, turn, string_split(text, ' ') as l from {conversations})"
_ENDED = r"s.long or regexp_matches(rtrim(a.open[-1]), '[.!?。！？]$') or len(a.open) >= 8 or (len(a.open) >= 4 and regexp_matches(rtrim(a.open[-1]), '[,，]$'))"


@query("phrase_groups", rf"""select conv_id, turn, cast(g as int) as pos, case when len(open) = 1 and conv_id * 1000 + turn in (select conv_id * 1000 + turn from ({_SPOKEN}) where long) then open[1] else regexp_replace(trim(array_to_string(open, ' ')), '\s+([,.!?。，！？])', '\1', 'g') end as phrase
    from {_fold(_SPOKEN, "[s.v]", _ENDED, "list_append(a.open, s.v)", "conv_id, turn")}""")
def _(get):
    return x.phrase_groups(get("conversations").select("conv_id", "turn", F.split("text", " ").alias("units"))).select("conv_id", "turn", "pos", "phrase")


#: Words with their own blanks; marks within a word, words of one mark, cues that the drop leaves empty, at the begin too.
_HEARD = "case when (word_idx + script_id) % 9 = 0 then ',' when word_idx % 7 = 3 then ' 3.5m' when word_idx % 13 = 5 then ' ,' else concat(' ', word) end"


@query("recognised_segments_to_cues", rf"""with h as (select script_id, seg_idx, word_idx, start, "end", {_HEARD} as word from {{words}}),
    w as (select *, coalesce(sum(b) over (partition by script_id, seg_idx order by word_idx rows between unbounded preceding and 1 preceding), 0) as cue from (select *, cast(regexp_matches(word, '[?,.、;:!…？，。；：！]') as int) as b from h)),
    c as (select script_id, seg_idx, cue, arg_min(start, word_idx) as s, arg_max("end", word_idx) as e, string_agg(word, '' order by word_idx) as t, max(b) as b, count(*) as n from w group by 1, 2, 3), d as (select *, case when b = 1 then left(t, length(t) - 1) else t end as t2 from c),
    f as (select *, first_value(s) over (partition by script_id, seg_idx, p order by cue) as s2 from (select *, coalesce(sum(case when t2 <> '' then 1 else 0 end) over (partition by script_id, seg_idx order by cue rows between unbounded preceding and 1 preceding), 0) as p from d))
    select script_id, seg_idx, cast(row_number() over (partition by script_id, seg_idx order by cue) as int) as cue_idx, round(case when p = 0 and (n > 1 or b = 0) then s else s2 end, 3) as start, round(e, 3) as "end", regexp_replace(t2, '^\s+|\s+$', '', 'g') as text from f where trim(t2) <> ''""")
def _(get):
    return x.recognised_segments_to_cues(get("words").withColumn("word", F.expr(_HEARD)), ["script_id", "seg_idx"], "word_idx")


@query("parse_terms", """select doc_id, case doc_id % 4 when 0 then concat(w[1], '|', w[2], ' ', w[3]) when 1 then concat(w[3], '|', w[1]) when 2 then concat(w[2], '|', w[3]) else concat('subject ', doc_id) end as terms
    from (select doc_id, list_concat(regexp_extract_all(text, '[a-zA-Z]+'), ['a', 'b', 'c']) as w from {documents})""")
def _(get):
    w = F.concat(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    reply = "case doc_id % 4 when 0 then concat('[\"', w[0], '\", \"', w[1], ' ', w[2], '\"]') when 1 then concat('Here: [\"', w[2], '\", \"', w[0], '\"] ok') when 2 then concat(' ', w[1], '， ', w[2], ',') else '' end as reply"
    rows = get("documents").select("doc_id", w.alias("w")).selectExpr("doc_id", reply, "concat('subject ', doc_id) as subject")
    return x.parse_terms(rows).select("doc_id", F.array_join("terms", "|").alias("terms"))


@query("clean_script", r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[*#]', '', 'g'), '\[.*\]', '', 'g'), '\(.*\)', '', 'g') as clean from {documents}""")
def _(get):
    return x.clean_script(_docs(get)).select("doc_id", "clean")


# Replies as they come: errors, quotes and line feeds around the hook; the subject is the text's begin.
@query("hook_validity", r"""with r as (select doc_id, left(text, 90) as subject, case doc_id % 5 when 0 then concat('Error: ', text) when 1 then concat(chr(10), '"', text, '"') when 2 then concat('  ''"', text) when 3 then concat(chr(39), text, chr(39)) else text end as reply from {documents}),
    b as (select doc_id, subject, regexp_replace(regexp_replace(case when starts_with(reply, 'Error:') then '' else regexp_replace(reply, '^\s+|\s+$', '', 'g') end, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') as reply from r),
    l as (select doc_id, subject, trim(string_split(reply, chr(10))[1]) as term, replace(upper(trim(string_split(reply, chr(10))[1])), 'ẞ', 'SS') as h from b),
    n as (select *, len(list_filter(regexp_split_to_array(term, '\s+'), lambda w: w <> '')) as n from l)
    select doc_id, case when length(h) between 10 and 80 then h else replace(upper(array_to_string(list_filter(regexp_split_to_array(subject, '\s+'), lambda w: w <> '')[1:5], ' ')), 'ẞ', 'SS') end as hook_text, length(h) between 10 and 80 as from_reply,
    case when n between 3 and 12 then term else regexp_replace(subject, '^\s+|\s+$', '', 'g') end as phrase, n between 3 and 12 as phrase_ok from n""")
def _(get):
    rows, reply = get("documents").selectExpr("doc_id", "left(text, 90) as subject", "text"), F.col("text")
    for k, (before, behind) in enumerate((("Error: ", ""), ('\n"', '"'), ("  '\"", ""), ("'", "'"))):
        reply = F.when(F.col("doc_id") % 5 == k, F.concat(F.lit(before), "text", F.lit(behind))).otherwise(reply)
    return x.hook_validity(rows.withColumn("reply", reply), "reply", "subject").select("doc_id", "hook_text", "from_reply", "phrase", "phrase_ok")


def _speech_sql() -> str:
    """The dictionaries one after the other, as replacements over the whole text; then marks and long sentences."""
    t = r"trim(regexp_replace(concat(text, ' You''re ', doc_id % 7, ', not 75-150; 150-300 or 5!! Vigorous cardio, METABOLISM... it''s 6-7 World  Health Organization bands??'), '\s+', ' ', 'g'))"
    for term, spoken in x.SPOKEN_TERMS:
        t = f"regexp_replace({t}, '\\b{term.replace(chr(39), 2 * chr(39))}\\b', '{spoken}', 'gi')"
    t = rf"regexp_replace(regexp_replace(regexp_replace({t}, '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '.', 'g')"
    cut = "case when length(b) > 120 and m <> '' and contains(b, ', ') then concat(array_to_string(list_transform(string_split(b, ', ')[1:len(string_split(b, ', ')) - 1], lambda p: concat(trim(p), '.')), ' '), ' ', string_split(b, ', ')[-1], m) else s end"
    return rf"""with t as (select doc_id, {t} as t from {{documents}}), s as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as s from (select doc_id, regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+') as l from t)),
        b as (select doc_id, i, s, regexp_replace(s, '[.!?]$', '') as b, regexp_extract(s, '[.!?]$') as m from s)
        select doc_id, trim(regexp_replace(string_agg({cut}, ' ' order by i), '\s+', ' ', 'g')) as spoken from b group by doc_id"""


@query("normalise_for_speech", _speech_sql())
def _(get):
    tail = F.concat(F.lit(" You're "), F.col("doc_id") % 7, F.lit(", not 75-150; 150-300 or 5!! Vigorous cardio, METABOLISM... it's 6-7 World  Health Organization bands??"))
    return x.normalise_for_speech(_docs(get).withColumn("text", F.concat("text", tail))).select("doc_id", "spoken")


def _spoken(n: str) -> str:
    """SQL of a number below a thousand in words."""
    below = f"case when {n} % 100 < 20 then {x.SMALL_NUMBERS}[{n} % 100 + 1] else concat({x.TENS}[{n} % 100 // 10 - 1], case when {n} % 10 > 0 then concat('-', {x.SMALL_NUMBERS}[{n} % 10 + 1]) else '' end) end"
    return f"case when {n} < 100 then {below} else concat({x.SMALL_NUMBERS}[{n} // 100 + 1], ' hundred', case when {n} % 100 > 0 then concat(' ', {below}) else '' end) end"


_NUMBER = "case when {n} < 1000 then {s} else cast({n} as string) end"


@query("spell_numbers", f"""select event_id, concat('play ', {_NUMBER.format(n='n', s=_spoken('n'))}, ' now, ', {_NUMBER.format(n='user_id', s=_spoken('user_id'))}, '. v', n, ' ', {_NUMBER.format(n='n', s=_spoken('n'))}, '-', {_spoken('(n % 10)')}, 'x') as spelled
    from (select event_id, user_id, event_id * 7 % 1200 as n from {{events}})""".replace(", 'x')", ", ' 4x')"))
def _(get):
    text = "concat('play ', event_id * 7 % 1200, ' now, ', user_id, '. v', event_id * 7 % 1200, ' 00', event_id * 7 % 1200, '-', event_id * 7 % 1200 % 10, ' 4x') as text"
    return x.spell_numbers(get("events").selectExpr("event_id", text)).select("event_id", "spelled")


@query("wrap_lines")
def _(get):
    return x.wrap_lines(get("lines").select("script_id", "line_idx", F.col("line").alias("text"))).select("script_id", "line_idx", "pos", "line")


@query("bracket_strip", "select doc_id, trim(translate(text, '[](){}', '      ')) as bare from {documents}")
def _(get):
    return x.bracket_strip(_docs(get)).select("doc_id", "bare")


@query("time_format", """select event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as t, ms as back from (select event_id, cast(floor(round(value * 100 * 1000, 6)) as bigint) as ms from {events})""")
def _(get):
    t = x.format_time(F.col("value") * 100)
    return get("events").select("event_id", t.alias("t"), x.parse_time(t).alias("back"))


@query("transcript_overlap", r"""select conv_id, turn, round(s, 6) as overlap, case when s < 0.1 then 'fail' when s < 0.3 then 'warn' else 'ok' end as verdict from (select conv_id, turn, len(list_distinct(list_intersect(a, b))) / cast(greatest(1, len(a)) as double) as s from
    (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') as a, list_filter(regexp_split_to_array(lower(coalesce(lag(text) over (partition by conv_id order by turn), '')), '\s+'), lambda w: w <> '') as b from {conversations}))""")
def _(get):
    from pyspark.sql import Window

    rows = get("conversations").withColumn("heard", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return x.transcript_overlap(rows, "text", "heard").select("conv_id", "turn", "overlap", "verdict")


#: DuckDB's distance counts bytes: the letters beyond ASCII that the table has become one byte each.
_BYTES = "translate(lower({c}), 'éóèñçüêäößí', concat(" + ", ".join(f"chr({n})" for n in (1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16)) + "))"
_ALIKE = f"round(1 - levenshtein({_BYTES.format(c='a')}, {_BYTES.format(c='b')}) / cast(greatest(length(a), length(b)) as double), 6)"


@query("levenshtein_similarity", f"select script_id, line_idx, {_ALIKE} as similarity from (select script_id, line_idx, line as a, lead(line) over (partition by script_id order by line_idx) as b from {{lines}}) where b is not null")
def _(get):
    """Whole adjacent lines of every document."""
    from pyspark.sql import Window

    rows = get("lines").withColumn("next", F.lead("line").over(Window.partitionBy("script_id").orderBy("line_idx"))).where("next is not null")
    return x.levenshtein_similarity(rows, "line", "next").select("script_id", "line_idx", "similarity")


@query("best_fuzzy_match", f"""select doc_id, a, arg_max(b, (s, b)) as b, max(s) as similarity from (select l.doc_id, a, b, {_ALIKE} as s from
    (select script_id as doc_id, line as a from {{lines}} where line_idx = 0) l left join (select script_id as doc_id, line as b from {{lines}} where line_idx > 0) r on l.doc_id = r.doc_id) group by 1, 2""")
def _(get):
    left = get("lines").where("line_idx = 0").select(F.col("script_id").alias("doc_id"), F.col("line").alias("a"))
    right = get("lines").where("line_idx > 0").select(F.col("script_id").alias("doc_id"), F.col("line").alias("b"))
    return x.best_fuzzy_match(left, right, "doc_id", "a", "b")


@query("lexicon_tag_words", r"""select script_id, seg_idx, word_idx, sticker, w in ('idiot', 'the') as is_shock from (select *, lower(regexp_replace(word, '[^\p{L}]', '', 'g')) as w from {words}) left join (values ('the', 'S1'), ('and', 'S2'), ('of', 'S3')) as l(k, sticker) on k = w""")
def _(get):
    words = get("words")
    lexicon = words.sparkSession.createDataFrame([("the", "S1", 0), ("And", "S2", 1), ("of", "S3", 2), ("of", "S9", 7)], "key string, sticker string, ord int")
    return x.lexicon_tag_words(words, lexicon, ["idiot", "the"]).select("script_id", "seg_idx", "word_idx", "sticker", "is_shock")


@query("fragment_to_sentence", r"""with f as (select script_id, line_idx as frag_idx, line as fragment, len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> '')) as n from {lines}), g as (select *, sum(n) over (partition by script_id order by frag_idx) - n / 2.0 as mid from f),
    s as (select script_id, frag_idx // 2 as sent_idx, string_agg(fragment, ' ' order by frag_idx) as sentence, cast(sum(n) as bigint) as n from f group by 1, 2), e as (select *, sum(n) over (partition by script_id order by sent_idx) as upto, sum(n) over (partition by script_id) as total from s)
    select script_id, frag_idx, sent_idx, case when sent_idx % 3 = 0 then 'prompt' else sentence end as evidence from (select g.script_id, frag_idx, e.sent_idx, e.sentence, row_number() over (partition by g.script_id, frag_idx order by e.sent_idx) as rn from g join e on g.script_id = e.script_id and g.mid <= e.upto) where rn = 1""")
def _(get):
    lines = get("lines")
    sentences = lines.withColumn("sent_idx", F.floor(F.col("line_idx") / 2)).groupBy("script_id", "sent_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda s: s["line"]), " ").alias("sentence"))
    sentences = sentences.withColumn("prompt", F.when(F.col("sent_idx") % 3 == 0, F.lit("prompt")).otherwise(F.lit(" ")))
    return x.fragment_to_sentence(lines.select("script_id", F.col("line_idx").alias("frag_idx"), F.col("line").alias("fragment")), sentences, "script_id").select("script_id", "frag_idx", "sent_idx", "evidence")


@query("caption_line_match", r"""select script_id, line_idx, cast(line_idx * 2 as double) as start, cast(line_idx * 2 as double) + 1.5 as "end", trim(line) as text from {lines}""")
def _(get):
    lines = get("lines")
    units = lines.select("script_id", F.col("line_idx").alias("unit_idx"), F.col("line").alias("unit"), (F.col("line_idx") * 2.0).alias("start"), (F.col("line_idx") * 2.0 + 1.5).alias("end"))
    return x.caption_line_match(units, lines, "script_id")


@query("caption_correction")
def _(get):
    cues = _units(get).withColumn("text", F.regexp_replace("text", "[.,]", ""))
    return x.caption_correction(cues, get("lines"), "script_id")


@query("caption_word_layout")
def _(get):
    rows = get("conversations").select("conv_id", "turn", F.split("text", " ").alias("words"), F.split("text", "\n").alias("lines"))
    return x.caption_word_layout(rows)


_SRT = "concat(row_number() over (partition by script_id order by line_idx), chr(10), {t0}, ' --> ', {t1}, chr(10), line, chr(10), chr(10))"
_TIME = "printf('%02d:%02d:%02d,%03d', ({e}) // 3600000, ({e}) // 60000 % 60, ({e}) // 1000 % 60, ({e}) % 1000)"


@query("srt_texts", "select script_id, string_agg(b, '' order by line_idx) as srt from (select script_id, line_idx, " + _SRT.format(t0=_TIME.format(e="line_idx * 2000"), t1=_TIME.format(e="line_idx * 2000 + 1500")) + " as b from {lines}) group by script_id")
def _(get):
    return writers.srt_texts(_units(get), "script_id")


@query("read_srt", "select script_id, cast(row_number() over (partition by script_id order by line_idx) - 1 as int) as cue_idx, line_idx * 2000 as start_ms, line_idx * 2000 + 1500 as end_ms, rtrim(line) as text from {lines}")
def _(get):
    return readers.read_srt(writers.srt_texts(_units(get), "script_id"), "script_id")


@query("read_voice_catalog", "select distinct concat('en-V', p_partkey, '-', case when p_partkey % 2 = 0 then 'Male' else 'Female' end) as voice from {part} where p_partkey % 3 = 0")
def _(get):
    text = F.concat(F.lit("Name: "), F.when(F.col("p_partkey") % 3 == 0, "en").otherwise("fr"), F.lit("-V"), F.col("p_partkey"), F.lit("\nGender: "), F.when(F.col("p_partkey") % 2 == 0, "Male").otherwise("Female"), F.lit("\n"))
    return readers.read_voice_catalog(get("part").select(text.alias("value")), locales=["EN-"])


def _hits(get, body: str):
    return get("pages").selectExpr("page_id as pool", "concat('t', page_id) as term", "cast(page_id % 5 as int) as term_ord", f"{body} as body")


@query("normalize_video_hits", "select concat('t', page_id) as term, concat('v', page_id) as url, cast(5 + page_id % 20 as int) as duration from {pages}")
def _(get):
    body = """concat('{"videos":[{"duration":3,"video_files":[{"link":"short","width":1080,"height":1920}]},{"duration":', 5 + page_id % 20, ',"image":"i","video_files":[{"link":"small","width":540,"height":960},{"link":"v', page_id, '","width":1080,"height":1920},{"link":"late","width":1080,"height":1920}],"video_pictures":[{"picture":"p"}]}]}')"""
    return readers.normalize_video_hits(_hits(get, body), "files").select("term", "url", "duration")


@query("normalize_video_renditions", "select concat('t', page_id) as term, concat('b', page_id) as url, 9 as duration from {pages} where page_id % 2 = 0")
def _(get):
    body = """concat('{"hits":[{"duration":9,"videos":{"large":{"url":"","width":', 100, '},"medium":{"url":"b', page_id, '","width":', case when page_id % 2 = 0 then 1280 else 640 end, '},"small":{"url":"s","width":1080}}}]}')"""
    rows = readers.normalize_video_hits(_hits(get, body), "renditions")
    return rows.where("url <> 's'").select("term", "url", "duration")


@query("normalize_image_hits", """select concat('t', page_id) as term, case when page_id % 2 = 0 then concat('L', page_id) else concat('o', page_id) end as url, 5 as duration from {pages}
    union all select concat('t', page_id), concat('ok', page_id, '.png'), 5 from {pages} union all select concat('t', page_id), case when page_id % 3 = 0 then concat('big', page_id) else concat('web', page_id) end, 5 from {pages}""")
def _(get):
    sized = """concat('{"photos":[{"src":{"large2x":"', case when page_id % 2 = 0 then concat('L', page_id) else '' end, '","original":"o', page_id, '"}}]}')"""
    wiki = """concat('{"pages":[{"url":"x', page_id, '.svg","mime":"image/svg"},{"url":"ok', page_id, '.png","mime":"image/png"}]}')"""
    web = """concat('{"hits":[{"largeImageURL":"', case when page_id % 3 = 0 then concat('big', page_id) else '' end, '","webformatURL":"web', page_id, '"}]}')"""
    parts = [readers.normalize_image_hits(_hits(get, b), p) for p, b in (("sized", sized), ("wiki", wiki), ("web", web))]
    return readers.concat_hits(*parts).select("term", "url", "duration")


@query("normalize_short_clip_hits", "select concat('t', page_id) as term, concat('wide', page_id) as url, cast(1280 + page_id % 500 as int) as width from {pages} where page_id % 50 <= 7")
def _(get):
    body = """concat('{"clips":[{"duration":40,"files":[{"width":1920,"height":1080,"url":"long"}]},{"duration":', 5 + page_id % 50, ',"files":[{"width":640,"height":480,"url":"narrow"},{"width":', 1280 + page_id % 500, ',"height":720,"url":"wide', page_id, '"},{"width":2000,"height":100,"url":"flat"}]}]}')"""
    return readers.normalize_short_clip_hits(_hits(get, body)).select("term", "url", "width")


@query("normalize_footage_hits", """select cast(page_id // 10 as bigint) as pool, concat('t', page_id) as term, concat('low-', page_id) as url, cast(60 + page_id % 30 as double) as duration, 5 as clips from {pages} where page_id % 10 < 3
    union all select page_id // 10, concat('t', page_id), case page_id % 3 when 0 then concat('only-', page_id) when 1 then concat('vp-', page_id) else concat('loud-', page_id) end, cast(100 as double), case when page_id % 10 = 2 then 3 else 5 end from {pages} where page_id % 10 < 3""")
def _(get):
    """Ten queries a script: 720 avc1 beside 1080 vp9, only 2160, only vp9, only with sound; a third hit and long and short ones go."""
    first = """'{"url":"a","duration":', 60 + page_id % 30, ',"formats":[{"height":720,"codec":"avc1.64","url":"low-', page_id, '"},{"height":1080,"codec":"vp9","url":"vp"},{"height":2160,"codec":"avc1.64","url":"big"}]}'"""
    second = """'{"url":"b","duration":100,"formats":[', case page_id % 3 when 0 then concat('{"height":2160,"codec":"avc1","url":"only-', page_id, '"}') when 1 then concat('{"height":480,"codec":"vp9","url":"less"},{"height":720,"codec":"vp9","url":"vp-', page_id, '"}')
        else concat('{"height":1440,"codec":"avc1","url":"quiet","muxed":false},{"height":360,"codec":"avc1","url":"loud-', page_id, '","muxed":true}') end, ']}'"""
    body = f"""concat('{{"entries":[', {first}, ',{{"url":"c","duration":5,"formats":[]}},{{"url":"e","duration":1200,"formats":[]}},', {second}, ',{{"url":"d","duration":100,"formats":[{{"height":720,"codec":"avc1","url":"third"}}]}}]}}')"""
    hits = get("pages").selectExpr("cast(floor(page_id / 10) as bigint) as pool", "concat('t', page_id) as term", "cast(page_id % 10 as int) as term_ord", f"{body} as body")
    return readers.normalize_footage_hits(hits, "pool", clips_per_video=5, max_clips=28).select("pool", "term", "url", "duration", "clips")
