"""Golden cases, independent replays of the folds, sources, sinks and streams."""

import json
import random
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cutroom.functions import text as x
from cutroom.operators import candidates, content, match, requests, tasks, timeline
from cutroom.sources import readers, writers
from cutroom.streaming import tasks as streams


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# --- content

CSV = "﻿Content,Video title,Video publish time,Duration,Views,Watch time (hours),Subscribers,Impressions,Impressions click-through rate (%)\n"
BODY = "Total,,,,11000,,12,,\nreach,Haaland controversy,,13,10000,,1,,\nloyalty,Thank You Ronaldo,,40,1000,,11,,\nbad,x,,1,12.5,,1,,\nblank,x,,1,,,1,,\nzero,x,,1,0,,1,,\npad,Mbappé and Messi,, 13 , 13 ,,,,\n"


@pytest.mark.parametrize("packed", [False, True])
def test_export_to_roles(spark, tmp_path, packed):
    if packed:
        path = str(tmp_path / "export.zip")
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("Table data.csv", CSV + BODY)
            z.writestr("Chart data.csv", "x")
    else:
        (tmp_path / "Table data.csv").write_text(CSV + BODY)
        path = str(tmp_path)
    clean = content.clean_content_rows(readers.read_analytics_export(spark, path)).withColumn("channel", F.lit("c"))
    assert rows(clean, "content_id", "views", "subscribers", "duration_s") == [("loyalty", 1000, 11, 40), ("pad", 13, 0, 13), ("reach", 10000, 1, 13)]
    two = clean.where("content_id <> 'pad'")
    role = {r["content_id"]: r["role"] for r in content.reach_conversion_role(two).collect()}
    assert role == {"reach": "reach_winner", "loyalty": "loyalty_winner"}
    assert rows(content.topic_cluster(clean), "content_id", "topic") == [("loyalty", "ronaldo"), ("pad", "messi"), ("reach", "haaland")]
    report = content.strategy_report(two).collect()[0]
    assert [t["content_id"] for t in report["top_reach"]] == ["reach", "loyalty"] and report["top_conversion"][0]["content_id"] == "loyalty"
    writers.write_strategy_report(content.strategy_report(two), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_median_is_exact_and_empty_is_empty(spark):
    df = spark.createDataFrame([("a", "c", v, 0) for v in (1, 2, 3, 10)], "content_id string, channel string, views bigint, subscribers bigint")
    assert content.channel_summary(df).collect()[0]["median_views"] == 2.5
    assert content.reach_conversion_role(df.limit(0)).count() == 0


# --- requests


def request(**changes):
    base = dict(task_id="t", subject="s", script="one two three four five six seven eight nine ten eleven twelve thirteen", terms=["a"], aspect="9:16", voice_name="v", voice_rate=1.0, video_count=1, hook_text="a b c", hook_cover="x", cta_text="Why?", loop_follow_tag=False, comparison_mode=False, comparison_clips=0, negative_terms=["n"], source="search", hook_require_video=True)
    return base | changes


SCHEMA = "task_id string, subject string, script string, terms array<string>, aspect string, voice_name string, voice_rate double, video_count int, hook_text string, hook_cover string, cta_text string, loop_follow_tag boolean, comparison_mode boolean, comparison_clips int, negative_terms array<string>, source string, hook_require_video boolean"


def test_preflight(spark):
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    cases = [request(), request(task_id="no script", script=""), request(task_id="two", video_count=2), request(task_id="slow", voice_rate=0.1, script=" ".join(["w"] * 100))]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cases], SCHEMA)
    got = {r["task_id"]: r for r in requests.preflight_report(df, 120, 60.0).collect()}
    assert got["t"]["ok"] and not got["t"]["errors"]
    assert got["no script"]["errors"] == ["video_script must be supplied"]
    assert got["two"]["errors"] == ["video_count=1 is required"]
    assert got["slow"]["errors"] == ["narration is too long"] and got["slow"]["estimated_s"] == pytest.approx(100 / (2.65 * 0.5), abs=1e-3)
    assert all(len(r["fingerprint"]) == 64 for r in requests.request_fingerprint(df, ["script", "subject"]).collect())
    tagged = spark.createDataFrame([tuple(request(loop_follow_tag=True, cta_text="Follow for more")[n] for n in names)], SCHEMA)
    assert len(requests.apply_growth_profile(tagged).collect()[0]["changes"]) == 2
    assert requests.narration_estimate(spark.createDataFrame([("l’été don't mid-air x", 1.0)], "script string, voice_rate double")).collect()[0]["words"] == 4


def test_preflight_switches_and_limits(spark):
    schema = SCHEMA + ", enable_hook_card boolean, enable_cta boolean, hook_image_path string, max_words int, max_seconds double"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    on = dict(enable_hook_card=None, enable_cta=None, hook_image_path=None, max_words=None, max_seconds=None)
    bare = dict(hook_text="", hook_cover=None, negative_terms=[], cta_text="Subscribe for more")
    cases = {
        "on": request(**on | bare), "hook off": request(**on | bare | {"enable_hook_card": False}), "cta off": request(**on | bare | {"enable_cta": False}),
        "image": request(**on | {"hook_cover": " ", "hook_image_path": "/a.jpg"}), "no image": request(**on | {"hook_cover": " ", "hook_image_path": " "}), "own words": request(**on | {"max_words": 12}),
        "own seconds": request(**on | {"max_seconds": 2.0}), "zero is none": request(**on | {"max_words": 0, "max_seconds": 0.0, "voice_rate": 0.0, "video_count": 0}), "compared": request(**on | bare | {"comparison_mode": True, "comparison_clips": 2}),
    }
    df = spark.createDataFrame([tuple(({**c, "task_id": k})[n] for n in names) for k, c in cases.items()], schema)
    got = {r["task_id"]: (r["errors"], r["warnings"]) for r in requests.preflight_report(df).collect()}
    hook, cover = "hook_text must be supplied", "hook_cover_term or hook_image_path must be supplied"
    assert got["on"] == ([hook, cover], ["no contrasting negatives", "generic call to action"])
    assert got["hook off"] == ([], ["generic call to action"]) and got["cta off"] == ([hook, cover], ["no contrasting negatives"])
    assert got["image"] == ([], []) and got["no image"] == ([cover], [])
    assert got["own words"][0] == ["script is too long"] and got["own seconds"][0] == ["narration is too long"]
    assert got["zero is none"] == ([], []) and got["compared"] == ([], [])


def test_media_plan_counts_stills_and_names_every_reason(spark):
    schema = "plan_id string, source string, bytes long, is_image boolean, width int, height int, duration double, brightness double, contrast double, edge_detail double, frame_signature string"
    clip = lambda plan, n, **c: tuple(({**dict(plan_id=plan, source=f"s{n % 2}", bytes=5000, is_image=False, width=720, height=1280, duration=3.0, brightness=90.0, contrast=30.0, edge_detail=9.0, frame_signature=f"f{n}"), **c})[f.split(" ")[0]] for f in schema.split(", "))
    still = dict(is_image=True, width=1280, height=720, duration=0.04)
    clips = [clip("mixed", 0), clip("mixed", 1, **still), clip("mixed", 2, **still)]
    clips += [clip("torn", 0, **still | {"width": None}), clip("torn", 1, width=None, height=None, duration=None), clip("torn", 2, height=720), clip("torn", 3, duration=0.3), clip("torn", 4, bytes=None)]
    plans = spark.createDataFrame([("mixed", 7.1), ("torn", 6.0), ("none", 1.0)], "plan_id string, audio_s double")
    rows_ = spark.createDataFrame(clips, schema)
    got = {r["plan_id"]: r["failures"] for r in candidates.media_plan_verdict(rows_, plans).collect()}
    assert got == {"mixed": [], "torn": ["file too small", "no video stream", "unreadable image", "clip too short", "not portrait"], "none": ["too few clips", "shorter than the audio"]}
    strict = {r["plan_id"]: r["failures"] for r in candidates.media_plan_verdict(rows_, plans, min_sources=3, image_seconds=1.0).collect()}
    assert strict["mixed"] == ["too few sources", "shorter than the audio"]


def test_batch_files(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"b{n}.json").write_text(json.dumps({"defaults": {"voice": "d", "subject": "f"}, "videos": [{"subject": None, "n": n}, {"voice": "own"}]}))
    raw = readers.read_batch_requests(spark, str(tmp_path / "*.json"))
    got = requests.overlay_defaults(raw, ["voice", "subject"])
    assert rows(got, "ordinal", "voice", "subject") == sorted([(0, "d", None), (1, "own", "f")] * 2, key=repr)
    (tmp_path / "empty.json").write_text('{"videos": []}')
    with pytest.raises(Exception, match="no videos"):
        readers.read_batch_requests(spark, str(tmp_path / "empty.json")).collect()


# --- candidates


def test_source_key(spark):
    df = spark.createDataFrame([("/cache/clips/video123_c0.mp4.seg0.mp4",), ("/cache/clips/video123_c4.mp4.seg8.mp4",), ("/cache/clips/video999_c0.mp4",), ("/x/Plain.MP4",)], "path string")
    assert [r["source"] for r in candidates.source_key(df).collect()] == ["video123", "video123", "video999", "plain.mp4"]


def test_hook_candidate(spark):
    df = spark.createDataFrame([("a", 0, 0.34, 90.0, [0.39, 0.21]), ("a", 1, 0.31, 70.0, [0.20, 0.18]), ("b", 0, 0.30, 80.0, [0.35]), ("b", 1, 0.29, 60.0, [0.31])], "pool string, idx int, pos double, sharpness double, negs array<double>")
    assert rows(match.hook_candidate(df, "pool", 0.25, 0.0), "pool", "idx") == [("a", 1), ("b", None)]


def assign_replay(sims, media, n, reuse_penalty=0.12, source_penalty=0.08, cap=0, source_cap=0, bonus=0.0, fraction=0.0):
    """The rules without pruning, over all media."""
    info = {m: (s, v) for m, s, v in media}
    import numpy as np

    best = sorted(((max([sims[s, m] for m in info if info[m][1]], default=None), -s) for s in range(n)), key=lambda t: (t[0] is not None, t), reverse=True)
    forced = {-s for b, s in best[: int(np.rint(fraction * n))] if b is not None}
    uses, sources, last, out = {}, {}, None, []
    for s in range(n):
        pool = [m for m in info if fraction <= 0 or info[m][1] == (s in forced)] or list(info)
        ok = [m for m in pool if m != last and (not cap or uses.get(m, 0) < cap) and (not source_cap or sources.get(info[m][0], 0) < source_cap)]
        ok = ok or [m for m in pool if m != last] or pool
        ok = [m for m in ok if last is None or info[m][0] != info[last][0]] or ok
        last = max(ok, key=lambda m: (sims[s, m] - reuse_penalty * uses.get(m, 0) - source_penalty * sources.get(info[m][0], 0) + (bonus if info[m][1] else 0), -m))
        uses[last] = uses.get(last, 0) + 1
        sources[info[last][0]] = sources.get(info[last][0], 0) + 1
        out.append(last)
    return out


def test_assignment_equals_replay_without_pruning(spark):
    rng = random.Random(1)
    cells, media, want = [], [], {}
    options = dict(reuse_penalty=0.2, source_penalty=0.1, bonus=0.05, fraction=0.4, cap=2, source_cap=3)
    for script in range(25):
        n, m = rng.randrange(2, 6), rng.randrange(8, 30)
        own = [(i, f"s{rng.randrange(max(3, m // 2))}", rng.random() < 0.5) for i in range(m)]
        sims = {(s, i): round(rng.random(), 6) for s in range(n) for i in range(m)}
        media += [(script, *x) for x in own]
        cells += [(script, s, i, v) for (s, i), v in sims.items()]
        want[script] = assign_replay(sims, own, n, **options)
    sims_df, media_df = spark.createDataFrame(cells, "script long, seg_idx int, media_idx int, sim double"), spark.createDataFrame(media, "script long, media_idx int, source string, is_video boolean")
    got = {}
    for r in match.assign_media_to_segments(sims_df, media_df, "script", 0.2, 0.1, 2, 3, 0.05, 0.4).orderBy("seg_idx").collect():
        got.setdefault(r["script"], []).append(r["media_idx"])
    assert got == want
    ranked = match.rank_media_for_script(sims_df, "script").groupBy("script").agg(F.count("*").alias("n"), F.count_distinct("media_idx").alias("d"), F.max("pos").alias("top")).collect()
    assert all(r["n"] == r["top"] + 1 and r["d"] == len([m for m in media if m[0] == r["script"]]) for r in ranked)


def test_assignment_caps_and_alternates(spark):
    media = spark.createDataFrame([(0, i, "abc"[i // 2], False) for i in range(6)], "script long, media_idx int, source string, is_video boolean")
    sims = spark.createDataFrame([(0, s, i, 1.0) for s in range(6) for i in range(6)], "script long, seg_idx int, media_idx int, sim double")
    got = [r["media_idx"] for r in match.assign_media_to_segments(sims, media, "script", max_media_reuse=1, max_source_reuse=2).orderBy("seg_idx").collect()]
    assert sorted(got) == list(range(6)) and all(a // 2 != b // 2 for a, b in zip(got, got[1:]))
    assert match.assign_media_to_segments(sims, media, "script", max_media_reuse=1, min_score=2.0, strict=True).count() == 0


def test_clips_respect_reuse(spark):
    sims = spark.createDataFrame([(0, s, i, 0.9 - 0.01 * i) for s in range(3) for i in range(4)], "script long, seg_idx int, media_idx int, sim double")
    audio = spark.createDataFrame([(0, 40.0)], "script long, audio_s double")
    got = match.select_clips_for_script(sims, audio, "script", 4.0, max_reuse=2).collect()
    assert len(got) == 10 and {r["seconds"] for r in got} == {4.0}
    assert [r["seg_idx"] for r in sorted(got, key=lambda r: r["clip"])] == [i % 3 for i in range(10)]


# --- text


def test_segments_lose_no_words():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["word ", "ab ", ", ", ". ", "! ", "longerword "]) for _ in range(rng.randrange(60)))
        joined = re.findall(r"\w+", " ".join(x.segment_list(t)))
        assert joined == re.findall(r"\w+", t)
        rest = iter(re.findall(r"\w+", t))  # lines hold words of the text, in order
        assert all(any(w == v for v in rest) for w in re.findall(r"\w+", " ".join(x.wrap_list(t))))


def test_split_on_punctuation_replay(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("a1.,?! \n、") for _ in range(20))) for i in range(200)]

    def replay(t):
        out, held = [], ""
        for i, c in enumerate(t):
            inner = c == "." and 0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit()
            if (c in "?,.、;:!…？，。；：！\n") and not inner:
                out.append(held.strip())
                held = ""
            else:
                held += c
        return [w for w in [*out, held.strip()] if w]

    got = {}
    for r in x.split_on_punctuation(spark.createDataFrame(texts, "id long, text string")).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["unit"])
    assert got == {i: replay(t) for i, t in texts if replay(t)}


def test_srt_round_trip_and_lost_last_cue(spark):
    cues = spark.createDataFrame([(1, i, i * 1.5, i * 1.5 + 1, f"line {i}\nmore") for i in range(3)], "doc long, cue_idx int, start double, end double, text string")
    srt = writers.srt_texts(cues, "doc")
    assert rows(readers.read_srt(srt, "doc"), "cue_idx", "start_ms", "text") == [(i, i * 1500, f"line {i}\nmore") for i in range(3)]
    cut = srt.withColumn("srt", F.expr("left(srt, char_length(srt) - 1)"))
    assert readers.read_srt(cut, "doc").count() == 2 and readers.read_srt(cut, "doc", keep_last=True).count() == 3


def test_caption_correction(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "hello wrld"), (1, 1, 1.0, 2.0, "this is"), (1, 2, 2.0, 3.0, "the end")], "doc long, cue_idx int, start double, end double, text string")
    lines = spark.createDataFrame([(1, 0, "hello world"), (1, 1, "this is the end"), (1, 2, "extra")], "doc long, line_idx int, line string")
    got = x.caption_correction(cues, lines, "doc").orderBy("line_idx").collect()
    assert [(r["text"], r["end"], r["verdict"]) for r in got] == [("hello world", 1.0, "corrected"), ("this is the end", 3.0, "exact"), ("extra", 0.0, "extra")]


def test_caption_lines_must_all_match(spark):
    units = spark.createDataFrame([(1, 0, "Hello ", 0.0, 1.0), (1, 1, "world", 1.0, 2.0), (1, 2, "Bye", 2.0, 3.0), (2, 0, "Hello", 0.0, 1.0)], "doc long, unit_idx int, unit string, start double, end double")
    lines = spark.createDataFrame([(1, 0, "Hello world!"), (1, 1, "bye."), (2, 0, "Hello"), (2, 1, "missing")], "doc long, line_idx int, line string")
    got = x.caption_line_match(units, lines, "doc").orderBy("line_idx").collect()
    assert [(r["doc"], r["start"], r["end"], r["text"]) for r in got] == [(1, 0.0, 2.0, "Hello world"), (1, 2.0, 3.0, "bye.")]


def test_fragments_to_sentences(spark):
    f = spark.createDataFrame([(1, i, w) for i, w in enumerate(["one two", "three", "four five", "six"])], "doc long, frag_idx int, fragment string")
    s = spark.createDataFrame([(1, 0, "one two three", "p0"), (1, 1, "four five six", " ")], "doc long, sent_idx int, sentence string, prompt string")
    assert rows(x.fragment_to_sentence(f, s, "doc"), "frag_idx", "evidence") == [(0, "p0"), (1, "p0"), (2, "four five six"), (3, "four five six")]


# --- timelines


def test_period_drop_and_peaks(spark):
    series = [("a", i, i / 10, float(i % 5 == 0) * 10 + (i >= 50) * 100) for i in range(120)]
    df = spark.createDataFrame(series, "k string, idx long, t double, v double")
    assert timeline.energy_drop(df, "k", energy="v").collect()[0]["drop_time"] == pytest.approx(5.0, abs=0.11)
    pulses = df.withColumn("v", F.expr("case when idx % 5 = 0 then 10.0 else 0.0 end"))
    assert timeline.dominant_period(pulses, "k", onset="v").collect()[0]["bpm"] == 120.0
    got = [r["t"] for r in timeline.onset_peaks(pulses, "k", onset="v").orderBy("t").collect()]
    assert got == [pytest.approx(i / 10) for i in range(5, 120, 5)]
    far = [r["t"] for r in timeline.onset_peaks(pulses, "k", onset="v", min_gap=0.6).orderBy("t").collect()]
    assert all(b - a >= 0.6 for a, b in zip(far, far[1:])) and len(far) < len(got)


def test_stickers_and_snaps(spark):
    df = spark.createDataFrame([("s", t) for t in (0.0, 0.5, 1.2, 1.3, 2.5)], "k string, t double")
    assert [r["t"] for r in timeline.sticker_spacing(df, "k").orderBy("t").collect()] == [0.0, 1.2, 2.5]
    points, beats = spark.createDataFrame([("a", 1.5), ("a", 9.0), ("b", 3.0)], "k string, t double"), spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, beat double")
    assert rows(timeline.nearest_event_snap(points, beats, "k"), "t", "snapped") == [(1.5, 1.0), (3.0, 3.0), (9.0, 2.0)]


# --- tasks and streams


def test_ledger_and_resume(spark):
    rows_ = [("a", 1, "reserve", None, None, None, "f"), ("a", 2, "claim", "voice_generation", None, None, None), ("a", 3, "finish", None, "failed", "above the 12.60s retention ceiling", None),
             ("b", 1, "reserve", None, None, None, "f"), ("b", 3, "finish", None, "failed", "network unavailable", None)]
    ledger = spark.createDataFrame(rows_, "task_id string, ts long, kind string, stage string, status string, error string, fingerprint string")
    resumes = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f")], "task_id string, fingerprint string")
    got = {r["task_id"]: (r["eligible"], r["reason"]) for r in tasks.resume_eligibility(ledger, resumes).collect()}
    assert got["a"] == (True, None) and got["b"][1] == "other stages were claimed" and got["c"][1] == "no reservation"


def test_overlaps(spark):
    runs = spark.createDataFrame([("s", 1, 0.0, 10.0), ("s", 2, 5.0, 8.0), ("s", 3, 9.0, 20.0), ("s", 4, 10.0, 4000.0)], "slot string, run_id int, start_s double, end_s double")
    assert rows(tasks.overlap_and_stale_runs(runs, "slot"), "run_id", "accepted", "stale") == [(1, True, False), (2, False, False), (3, False, False), (4, True, True)]


def test_overlaps_equal_a_replay(spark):
    rng = random.Random(6)
    runs = [(f"s{rng.randrange(4)}", i, float(rng.randrange(3000)), 0.0) for i in range(300)]
    runs = [(s, i, a, a + rng.choice([0, 5, 20, 60, 2000 if i % 40 == 0 else 1])) for s, i, a, _ in runs] + [("gap", 900, 1.0, 2.0), ("gap", 901, 2.0, 2.0), ("gap", 902, 2.0, 9.0)]
    want = []
    for slot in {r[0] for r in runs}:
        free = float("-inf")
        for _, i, a, z in sorted((r for r in runs if r[0] == slot), key=lambda r: (r[2], r[1])):
            ok = a >= free
            free = z if ok else free
            want.append((slot, i, ok, ok and z - a > 1800))
    got = tasks.overlap_and_stale_runs(spark.createDataFrame(runs, "slot string, run_id int, start_s double, end_s double"), "slot")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_accepted_claims_stay_once_only(spark, tmp_path):
    """The same claim days later, with other events in between that move the time on, is no second claim."""
    schema = "event_id long, task_id string, ts timestamp, stage string"
    for n, (task, day) in enumerate([("a", 1), ("b", 3), ("a", 5), ("c", 9), ("a", 9)]):
        spark.createDataFrame([(n, task, pd.Timestamp(f"2024-01-0{day}").to_pydatetime(), "render")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r["task_id"] for r in drained(spark, streams.accepted_claims(source()), "append", "once", tmp_path).collect()) == ["a", "b", "c"]
    within = drained(spark, streams.accepted_claims(source(), horizon="1 hour"), "append", "within", tmp_path)
    assert within.count() > 3


def drained(spark, stream, mode, name, where):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(where / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(4)
    events = [(i, f"t{rng.randrange(6)}", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime(), rng.choice(["voice", "render"]), rng.choice([-1, 1, 4]), float(rng.randrange(130))) for i in range(60)]
    df = spark.createDataFrame(events, "event_id long, task_id string, ts timestamp, stage string, state int, progress double")
    for part in range(3):
        df.where(F.floor(F.col("event_id") / 20) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = drained(spark, streams.latest_task_state(source()), "complete", "latest", tmp_path)
    assert rows(state) == rows(tasks.latest_task_state(df))
    verdicts = drained(spark, streams.claim_once_ledger(source()), "append", "ledger", tmp_path)
    assert rows(verdicts, "event_id", "accepted") == rows(tasks.claim_once_ledger(df), "event_id", "accepted")
    accepted = drained(spark, streams.accepted_claims(source()), "append", "accepted", tmp_path)
    assert rows(accepted, "event_id") == rows(tasks.claim_once_ledger(df).where("accepted"), "event_id")
    windows = drained(spark, streams.progress_windows(source(), "stage"), "complete", "windows", tmp_path)
    assert sum(r["completed"] + r["failed"] + r["running"] for r in windows.collect()) == 60
    drained(spark, streams.stale_runs(source().withColumnRenamed("stage", "slot")), "append", "stale", tmp_path)


# --- sinks and captured replies


def test_reports_replace_their_own_partition(spark, tmp_path):
    path = str(tmp_path / "reports")
    writers.write_quality_reports(spark.createDataFrame([("a", 1), ("b", 1)], "task string, ok int"), "task", path)
    writers.write_quality_reports(spark.createDataFrame([("b", 2)], "task string, ok int"), "task", path)
    assert rows(spark.read.json(path), "task", "ok") == [("a", 1), ("b", 2)]
    writers.write_caption_json(spark.createDataFrame([(1, "x")], "cap int, text string"), str(tmp_path / "caps"))
    assert spark.read.json(str(tmp_path / "caps")).count() == 1
    writers.write_srt(spark.createDataFrame([(1, 0, 0.0, 1.0, "x")], "doc int, cue_idx int, start double, end double, text string"), "doc", str(tmp_path / "srt"))
    assert spark.read.text(str(tmp_path / "srt")).count() >= 3


def test_manifests(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "script.json").write_text(json.dumps({"script": "s", "search_terms": "a, b", "params": {"k": 1}}))
    got = readers.read_task_manifests(spark, str(tmp_path / "t1" / "script.json")).collect()[0]
    assert got["task_id"] == "t1" and got["terms"] == ["a", "b"] and json.loads(got["params"]) == {"k": 1}
