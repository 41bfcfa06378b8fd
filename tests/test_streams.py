"""Streams give the batch forms' answers, also when a batch is repeated; caches, sketches, seeded orders and blocked products."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cutroom.operators import cache, candidates, content, match, tasks
from cutroom.streaming import tasks as streams


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def at(seconds):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=seconds)).to_pydatetime()


def fed(spark, data, schema, where):
    """A stream of one file after the other."""
    for part in data:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(where / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where / "in"))


def drained(spark, stream, name, where):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(where / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


UPDATES = "event_id long, task_id string, ts timestamp, state int, progress double"


def test_upserts_survive_a_repeated_batch(spark, tmp_path):
    rng = random.Random(1)
    parts = [[(b * 20 + i, f"t{rng.randrange(25)}", at(rng.randrange(5000)), rng.choice([-1, 1, 4, None]), float(rng.randrange(130))) for i in range(20)] for b in range(5)]
    write, path = streams.upsert_states(str(tmp_path / "table"), buckets=4), str(tmp_path / "table")
    frames = [spark.createDataFrame(p, UPDATES) for p in parts]
    for n, frame in enumerate(frames):
        write(frame, n)
        if n in (0, 2, 4):
            write(frame, n)  # once more, as after a failure
        seen = frames[0]
        for f in frames[1 : n + 1]:
            seen = seen.unionByName(f)
        assert rows(tasks.latest_task_state(streams.states(spark, path).drop("bucket", "version"))) == rows(tasks.latest_task_state(seen))
    assert spark.read.parquet(path).select("bucket", "version").distinct().groupBy("bucket").count().where("count > 2").count() == 0
    write(frames[0].limit(0), 9)
    assert streams.states(spark, path).count() == len({r[1] for p in parts for r in p})


def test_upserts_as_a_sink(spark, tmp_path):
    parts = [[(b * 3 + i, f"t{i}", at(b * 100 + i), b, float(b)) for i in range(3)] for b in range(3)]
    stream = fed(spark, parts, UPDATES, tmp_path)
    q = stream.writeStream.foreachBatch(streams.upsert_states(str(tmp_path / "table"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(streams.states(spark, str(tmp_path / "table")), "task_id", "state") == [("t0", 2), ("t1", 2), ("t2", 2)]


def test_judged_runs_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    runs = [(f"s{rng.randrange(3)}", i, float(i * 60 + rng.randrange(50)), 0.0) for i in range(60)]
    runs = [(s, i, a, a + rng.choice([5.0, 70.0, 200.0, 2500.0 if i % 20 == 0 else 30.0])) for s, i, a, _ in runs]
    late = [runs[n] for n in sorted(range(60), key=lambda n: n + rng.randrange(4))]  # up to some minutes out of order
    schema = "slot string, run_id int, start_s double, end_s double, ts timestamp"
    timed = [(*r, at(r[2])) for r in late]
    stream = fed(spark, [timed[i : i + 12] for i in range(0, 60, 12)] + [[("end", 99, 1e6, 1e6, at(1e6))]], schema, tmp_path)
    got = drained(spark, streams.judged_runs(stream), "runs", tmp_path)
    want = tasks.overlap_and_stale_runs(spark.createDataFrame(runs, "slot string, run_id int, start_s double, end_s double"), "slot")
    assert rows(got.where("slot <> 'end'")) == rows(want)
    assert {r["accepted"] for r in got.collect()} == {True, False}


def test_judged_resumes_equal_the_batch(spark, tmp_path):
    ceiling = "above the 12.60s Retention Ceiling"
    plans = {
        "good": [("reserve", None, None, None, "f"), ("claim", "voice_generation", None, None, None), ("finish", None, "failed", ceiling, None)], "none": [], "ran": [("reserve", None, None, None, "f"), ("claim", "voice_generation", None, None, None), ("finish", None, "complete", None, None)],
        "more": [("reserve", None, None, None, "f"), ("claim", "voice_generation", None, None, None), ("claim", "render", None, None, None), ("finish", None, "failed", ceiling, None)], "other": [("reserve", None, None, None, "f"), ("claim", "voice_generation", None, None, None), ("finish", None, "failed", "network", None)],
        "changed": [("reserve", None, None, None, "g"), ("reserve", None, None, None, "f"), ("claim", "voice_generation", None, None, None), ("finish", None, "failed", ceiling, None)], "early": [("reserve", None, None, None, "f"), ("finish", None, "failed", ceiling, None)],
    }
    ledger = [(task, at(10 * n), *event) for task, events in plans.items() for n, event in enumerate(events)]
    resumes = [(task, at(500), "resume", None, None, None, "f") for task in plans]
    schema = "task_id string, ts timestamp, kind string, stage string, status string, error string, fingerprint string"
    both = sorted(ledger + resumes, key=lambda r: (r[1], r[0]))
    random.Random(3).shuffle(both)
    stream = fed(spark, [both[i::3] for i in range(3)] + [[("end", at(1e6), "claim", "x", None, None, None)]], schema, tmp_path)
    got = drained(spark, streams.judged_resumes(stream), "resumes", tmp_path)
    asked = spark.createDataFrame([(r[0], r[6]) for r in resumes], "task_id string, fingerprint string")
    want = tasks.resume_eligibility(spark.createDataFrame(ledger, schema), asked)
    assert rows(got, "task_id", "eligible", "reason") == rows(want, "task_id", "eligible", "reason")


# --- caches


def test_cache_computes_what_is_new(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def embed(x):
        calls.add(1)
        return f"<{x}>"

    path, schema = str(tmp_path / "cache"), "path string, modified int, file_size int, more string"
    first = [("a", 1, 5, "x"), ("a", 1, 5, "y"), ("b", 1, 5, "x"), (None, 1, 5, "x")]
    run = lambda data: rows(cache.media_probe(spark.createDataFrame(data, schema).coalesce(1), embed, path), "path", "modified", "probe")
    want = [("a", 1, "<a>"), ("a", 1, "<a>"), ("b", 1, "<b>"), (None, 1, "<None>")]
    assert run(first) == sorted(want, key=repr)
    spent = calls.value
    assert run(first[:3]) == want[:3] and calls.value == spent  # no known key is computed
    assert run([("a", 2, 5, "x"), ("b", 1, 5, "x")]) == [("a", 2, "<a>"), ("b", 1, "<b>")] and calls.value > spent
    assert run([]) == []
    vectors = cache.embed_cached(spark.createDataFrame(first, schema), ["path", "modified"], "path", lambda c: F.array(F.length(c).cast("float")), str(tmp_path / "other"))
    assert rows(vectors.where("path is not null"), "path", "embedding") == [("a", [1.0]), ("a", [1.0]), ("b", [1.0])]


# --- sketches and seeded orders


def test_sketches_merge_over_days(spark):
    rng = random.Random(4)
    data = [(i % 6000, f"c{i % 2}", i % 10, int(rng.lognormvariate(6, 2)), i % 3) for i in range(24_000)]
    df = spark.createDataFrame(data, "content_id long, channel string, day long, views long, subscribers long")
    daily = content.summary_sketches(df, ["channel", "day"])
    got = {r["channel"]: r for r in content.merged_summary(daily, ["channel"]).collect()}
    exact = {r["channel"]: r for r in content.channel_summary(df).collect()}
    assert set(got) == set(exact) == {"c0", "c1"}
    for channel, r in got.items():
        assert all(r[c] == exact[channel][c] for c in ("videos", "views", "subscribers", "baseline_per_1k"))
        views = np.array([v for _, c, _, v, _ in data if c == channel])
        assert abs((views <= r["median_views"]).mean() - 0.5) < 0.01
        assert r["different_videos"] == pytest.approx(3000, rel=0.02)
    assert content.merged_summary(daily.limit(0), ["channel"]).count() == 0


def test_merged_count_of_many_keys_is_close(spark):
    """Keys for which a sketch of 14 bits is off by 2.13 % and 2.002 %."""
    df = spark.range(48_000).selectExpr("id + 39264000 as content_id", "'a' as channel").union(spark.range(48_000).selectExpr("id + 5760000", "'b'"))
    df = df.selectExpr("*", "content_id % 7 as part", "1L as views", "0L as subscribers")
    got = {r["channel"]: r["different_videos"] for r in content.merged_summary(content.summary_sketches(df, ["channel", "part"]), ["channel"]).collect()}
    assert set(got) == {"a", "b"} and all(n == pytest.approx(48_000, rel=0.01) for n in got.values())


def test_seeded_orders(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("pool"), F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 7).cast("double").alias("duration"), F.lit("t").alias("term"), F.lit(5).alias("hit_ord"))
    order = lambda seed, n: rows(candidates.shuffled(df.repartition(n), ["pool"], ["url"], seed, "hit_ord"), "pool", "hit_ord", "url")
    assert order(1, 1) == order(1, 7) != order(2, 3)
    assert sorted({r[1] for r in order(1, 2)}) == list(range(100))
    audio = spark.createDataFrame([(p, 30.0) for p in range(3)], "pool long, audio_s double")
    taken = lambda seed, n: rows(candidates.per_term_cap(candidates.shuffled(df.repartition(n), ["pool"], ["url"], seed, "hit_ord"), audio, "pool", 3.0), "url")
    assert taken(5, 1) == taken(5, 6) and taken(5, 2) != taken(6, 2) and len(taken(5, 2)) == 33
    windows = lambda seed: rows(candidates.subclip_windows(df, 2.0, by=["pool"], keys=["url"], seed=seed), "pool", "ord", "url", "window")
    assert windows(1) == windows(1) != windows(2) and [r[:2] for r in windows(1)[:5]] == [(0, n) for n in (0, 1, 10, 100, 101)]
    assert "ord" not in candidates.subclip_windows(df, 2.0).columns and "ord" not in candidates.subclip_windows(df, 2.0, "sequential", ["pool"], ["url"], 1).columns
    twice = df.unionByName(df)  # equal rows
    assert sorted(r["ord"] for r in candidates.seeded_order(twice, ["pool"], ["url"], 1).where("pool = 0").collect()) == list(range(200))


# --- blocked products


def matched(spark, rng, pools, n_media, n_segments, sources):
    unit = lambda: (lambda v: [float(x) for x in np.round(v / np.linalg.norm(v), 2)])(np.array([rng.gauss(0, 1) for _ in range(6)]))
    media = [(p, m, unit(), f"s{rng.choice([0, 0, 0, *range(sources)])}", rng.random() < 0.4) for p in range(pools) for m in range(n_media)]
    segments = [(p, s, unit()) for p in range(pools + 1) for s in range(n_segments)]
    return spark.createDataFrame(segments, "k int, seg_idx int, embedding array<float>"), spark.createDataFrame(media, "k int, media_idx int, embedding array<float>, source string, is_video boolean")


@pytest.mark.parametrize("at_once", [3, 7, 5000])
def test_blocks_give_what_all_pairs_give(spark, at_once):
    segments, media = matched(spark, random.Random(at_once), 3, 40, 4, 12)
    sims = match.segment_media_similarity(segments, media, "k")
    before = match.MEDIA_AT_ONCE, match.SEGMENTS_AT_ONCE
    match.MEDIA_AT_ONCE, match.SEGMENTS_AT_ONCE = at_once, max(2, at_once // 3)
    try:
        assert rows(match.top_media(segments, media, "k"), "k", "seg_idx", "media_idx", "sim") == rows(match.best_media(sims, "k"), "k", "seg_idx", "media_idx", "sim")
        three = match.top_media(segments, media, "k", 3)
        every = {}
        for r in sims.collect():
            every.setdefault((r["k"], r["seg_idx"]), []).append((-r["sim"], r["media_idx"]))
        assert rows(three, "k", "seg_idx", "media_idx") == sorted(((*key, m) for key, found in every.items() for _, m in sorted(found)[:3]), key=repr)
        few = match.assignment_similarity(segments, media, "k", 0.05)
        pruned = lambda s: rows(match.prune_for_assignment(s, media, "k", 0.05))
        assert pruned(few) == pruned(sims) and few.count() <= sims.count()
        assign = lambda s: rows(match.assign_media_to_segments(s, media, "k", 0.2, 0.1, 2, 3, 0.05, 0.4))
        assert assign(few) == assign(sims)
    finally:
        match.MEDIA_AT_ONCE, match.SEGMENTS_AT_ONCE = before


def test_representative_images(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 1), ("b", 3), ("c", 8), ("d", 4)) for i in range(n)], "item string, pos int")
    for most in (1, 3, 5):
        got = rows(match.representative_images(df, ["item"], "pos", most))
        assert got == sorted((k, i) for k, n in (("a", 1), ("b", 3), ("c", 8), ("d", 4)) for i in (range(n) if n <= most else sorted({i * n // most for i in range(most)})))
