"""Media candidates: identity, filters, quotas and budgets, quality gates and plan verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIDEO_EXTENSIONS = ("mp4", "mov", "webm", "mkv", "avi")


def media_url_key(df: DataFrame, url: str = "url", out: str = "url_key") -> DataFrame:
    """P-11. MD5 of the address without its query."""
    return df.withColumn(out, F.md5(F.substring_index(F.col(url), "?", 1).cast("binary")))


def source_key(df: DataFrame, path: str = "path", out: str = "source") -> DataFrame:
    """P-12. Lower-cased base name up to its cut mark, so that cuts of one upload share a key."""
    name = F.lower(F.regexp_extract(F.col(path), r"([^/]*)$", 1))
    return df.withColumn(out, F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+?)_c\d+(?:\.|$)", 1), F.lit("")), name))


def watermark_domain_filter(df: DataFrame, domains: list[str], columns: tuple[str, ...] = ("url",)) -> DataFrame:
    """P-13. Rows none of whose address columns holds a listed domain part."""
    bad = F.lit(False)
    for c in columns:
        for d in domains:
            bad = bad | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(d.lower())
    return df.where(~bad)


def resolution_gate(df: DataFrame, least: int = 480) -> DataFrame:
    """P-14. Media with both sides long enough."""
    return df.where((F.col("width") >= least) & (F.col("height") >= least))


def frame_fill_decision(df: DataFrame, width: int = 1080, height: int = 1920, min_keep: float = 0.6) -> DataFrame:
    """P-15. Cover the frame if a centred crop keeps enough of the image, else fit the whole of it."""
    scale = F.greatest(width / F.col("width"), height / F.col("height"))
    keep = F.least(width / (F.col("width") * scale), height / (F.col("height") * scale))
    shape = F.when(F.col("width") > F.col("height"), "landscape").when(F.col("width") < F.col("height"), "portrait").otherwise("square")
    return df.withColumns({"crop_keep": F.round(keep, 6), "orientation": shape, "fill": F.when(keep >= min_keep, "cover").otherwise("fit")})


def media_kind(df: DataFrame, path: str = "path", out: str = "kind") -> DataFrame:
    """P-17. "video" by the file's extension, else "image"."""
    return df.withColumn(out, F.when(F.lower(F.col(path)).rlike(r"\.(" + "|".join(VIDEO_EXTENSIONS) + ")$"), "video").otherwise("image"))


def graphic_frame_gate(frames: DataFrame) -> DataFrame:
    """P-19. Adds is_graphic: flat colours, few colours, dark borders or little detail tell a graphic from a photo."""
    bad = (F.col("dominant_share") >= 0.45) | (F.col("n_colours") <= 12) | (F.col("dark_border") >= 0.70) | (F.col("detail") < 3.5) | ((F.col("dark_border") >= 0.45) & (F.col("dominant_share") >= 0.30))
    return frames.withColumn("is_graphic", bad)


def frame_quality_flag(frames: DataFrame) -> DataFrame:
    """P-20. Adds unusable: too dark, too bright, flat or blurred."""
    return frames.withColumn("unusable", (F.col("brightness") < 8) | (F.col("brightness") > 247) | (F.col("contrast") < 4) | (F.col("edge_detail") < 1.5))


def first_wins_dedupe(candidates: DataFrame, key: str = "url", by: list[str] = (), order: list[str] = ("term_ord", "hit_ord")) -> DataFrame:
    """W-1. The earliest row of each key stays and keeps its term.

    The winner is found by a partially aggregated minimum, so a key with very many hits doesn't meet in one task.
    """
    rest = [c for c in candidates.columns if c not in (*by, key, *order)]
    least = candidates.groupBy(*by, key).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return least.select(*by, key, "__first.*").select(*candidates.columns)


def per_term_cap(candidates: DataFrame, audio: DataFrame, by: str, max_clip: float) -> DataFrame:
    """W-2. Of each term at most max(1, int(audio / max_clip / terms) + 1) items, in hit order."""
    terms = candidates.groupBy(by).agg(F.count_distinct("term").alias("__terms"))
    cap = F.greatest(F.lit(1), F.floor(F.col("audio_s") / max_clip / F.col("__terms")) + 1)
    rows = candidates.join(terms.join(audio, by), by).withColumn("__rn", F.row_number().over(Window.partitionBy(by, "term").orderBy("hit_ord", "url")))
    return rows.where(F.col("__rn") <= cap).select(*candidates.columns)


def duration_budget(candidates: DataFrame, audio: DataFrame, by: str, order: list[str], max_clip: float) -> DataFrame:
    """W-3. Take in order, each at most max_clip long, up to and with the row that makes the sum exceed the audio."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.join(audio, by).withColumn("used_s", F.least(F.lit(max_clip), F.col("duration")))
    return rows.withColumn("__sum", F.coalesce(F.sum("used_s").over(before), F.lit(0.0))).where(F.col("__sum") <= F.col("audio_s")).drop("__sum", "audio_s")


def provider_quota(candidates: DataFrame, audio: DataFrame, by: str, clip_ratio: float, order: list[str]) -> DataFrame:
    """W-4. Clips and photos of each term within their quotas, while the seconds taken so far are below max(4 a, a + 30)."""
    clips = max(1, round(3 * clip_ratio)) if clip_ratio > 0 else 0
    photos = max(4, round(10 * (1 - clip_ratio)))
    rows = candidates.withColumn("__rn", F.row_number().over(Window.partitionBy(by, "term", "kind").orderBy(*order)))
    rows = rows.where(F.col("__rn") <= F.when(F.col("kind") == "video", clips).otherwise(photos)).join(audio, by)
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__sum", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))
    return rows.where(F.col("__sum") < F.greatest(4 * F.col("audio_s"), F.col("audio_s") + 30)).select(*candidates.columns)


def term_share(selection: DataFrame, by: str) -> DataFrame:
    """A-5. How many and what share of a pool's items each term gave, and how many terms are represented."""
    counts = selection.groupBy(by, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    return counts.withColumns({"share": F.round(100.0 * F.col("n") / F.sum("n").over(w), 3), "terms": F.count("*").over(w)})


def reuse_distribution(selection: DataFrame, by: str, media: str) -> DataFrame:
    """A-6. Uses, different media, diversity and its band of each script."""
    uses = selection.groupBy(by, media).agg(F.count("*").alias("uses"))
    out = uses.groupBy(by).agg(F.sum("uses").alias("total"), F.count("*").alias("unique_media"), F.max("uses").alias("most_used"), F.sum((F.col("uses") == 1).cast("bigint")).alias("used_once"))
    ratio = F.col("unique_media") / F.col("total")
    return out.withColumns({"diversity": F.round(ratio, 3), "band": F.when(ratio >= 0.8, "excellent").when(ratio >= 0.6, "good").when(ratio >= 0.4, "fair").otherwise("poor")})


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)), lambda x: x.isNotNull())


def media_plan_verdict(clips: DataFrame, plans: DataFrame, by: str = "plan_id", min_clips: int = 3, min_sources: int = 0, image_seconds: float = 2.0) -> DataFrame:
    """A-7. Every reason for which a plan's media fail (an empty list passes). Plans without clips fail too.

    A still has no length or shape of its own: it counts ``image_seconds`` and needs only to be readable. A clip without
    width, height and duration has no video stream. ``min_sources`` of 0 is no rule.
    """
    video = ~F.col("is_image")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    side = lambda c: F.coalesce(F.col(c), F.lit(0))
    seconds = F.coalesce(F.col("duration"), F.lit(0.0))
    no_stream = F.col("width").isNull() & F.col("height").isNull() & F.col("duration").isNull()
    shapeless = (side("width") == 0) | (side("height") == 0)
    got = clips.groupBy(by).agg(
        F.count("*").alias("n"), n(side("bytes") < 1024).alias("small"), n(no_stream).alias("silent"), n(~video & ~no_stream & shapeless).alias("unreadable"),
        n(video & ~no_stream & (seconds < 0.35)).alias("short"), n(video & ~no_stream & (shapeless | (F.col("height") <= F.col("width")))).alias("wide"),
        n((F.col("brightness") < 8) | (F.col("brightness") > 247) | (F.col("contrast") < 4) | (F.col("edge_detail") < 1.5)).alias("bad"),
        F.count_distinct("frame_signature").alias("frames"), F.count_distinct("source").alias("sources"), F.sum(F.when(video, seconds).otherwise(image_seconds)).alias("seconds"),
    )
    rows = plans.join(got, by, "left").fillna(0, ["n", "small", "silent", "unreadable", "short", "wide", "bad", "frames", "sources", "seconds"])
    failures = _reasons(
        (F.col("n") < min_clips, "too few clips"), (F.col("small") > 0, "file too small"), (F.col("silent") > 0, "no video stream"), (F.col("unreadable") > 0, "unreadable image"),
        (F.col("short") > 0, "clip too short"), (F.col("wide") > 0, "not portrait"), (F.col("bad") > F.greatest(F.lit(1), F.floor(F.col("n") / 3)), "too many unusable frames"),
        ((F.col("n") >= 5) & (F.col("frames") < F.greatest(F.lit(3), F.floor(F.col("n") * 0.4))), "too few different frames"),
        ((F.lit(min_sources) > 0) & (F.col("sources") < min_sources), "too few sources"), (F.col("seconds") + 0.2 < F.col("audio_s"), "shorter than the audio"),
    )
    return rows.select(by, F.col("n").alias("clips"), failures.alias("failures")).withColumn("ok", F.size("failures") == 0)


def dark_clip_gate(clips: DataFrame, samples: DataFrame, by: str) -> DataFrame:
    """A-8. Clips that aren't dark in their brightness samples; a clip without samples stays."""
    dark = samples.groupBy(by).agg(F.min("brightness").alias("lo"), F.max("brightness").alias("hi"), F.avg("brightness").alias("mean")).where("lo < 9 or hi < 22 or mean < 17.6")
    return clips.join(dark.select(by), by, "left_anti")


def render_verdict(probes: DataFrame, by: str, width: int = 1080, height: int = 1920) -> DataFrame:
    """A-10. Whether a rendered file has size, both streams, the exact frame and the expected duration."""
    is_video = F.col("kind") == "video"
    got = probes.groupBy(by).agg(
        F.max("bytes").alias("bytes"), F.bool_or(is_video).alias("has_video"), F.bool_or(F.col("kind") == "audio").alias("has_audio"),
        F.coalesce(F.bool_or(is_video & (F.col("width") == width) & (F.col("height") == height)), F.lit(False)).alias("frame_ok"), F.max(F.abs(F.col("duration") - F.col("expected"))).alias("off"),
    )
    ok = (F.col("bytes") >= 10_000) & F.col("has_video") & F.col("has_audio") & F.col("frame_ok") & (F.col("off") <= 1)
    return got.select(by, "has_video", "has_audio", "frame_ok", ok.alias("ok"))


def timestamp_validity(words: DataFrame, by: str) -> DataFrame:
    """A-11. Kept and dropped words of each text: a word needs text and a start before its end."""
    good = F.coalesce((F.trim("word") != "") & (F.col("start") < F.col("end")), F.lit(False))
    return words.groupBy(by).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def acquisition_counts(pool: DataFrame, by: str) -> DataFrame:
    """A-12. Clips and photos of each pool."""
    return pool.groupBy(by).agg(F.count_if(F.col("kind") == "video").alias("clips"), F.count_if(F.col("kind") != "video").alias("photos"))


def graphics_filter_with_floor(frames: DataFrame, by: str, min_keep: int, strict: bool) -> DataFrame:
    """T-7. Without graphics; if too few are left, strict keeps those few and otherwise all rows stay."""
    rows = graphic_frame_gate(frames).withColumn("__left", F.count_if(~F.col("is_graphic")).over(Window.partitionBy(by)))
    stays = ~F.col("is_graphic") if strict else ~F.col("is_graphic") | (F.col("__left") < min_keep)
    return rows.where(stays).drop("__left")


def sidecar_default_join(media: DataFrame, sidecars: DataFrame, key: str = "path") -> DataFrame:
    """J-1. Media with their sidecar's search term; without one the file's stem is the term."""
    stem = F.regexp_extract(F.col(key), r"([^/]*?)(?:\.[^./]*)?$", 1)
    return media.join(sidecars.select(key, F.col("search_term").alias("__term")), key, "left").withColumn("search_term", F.coalesce("__term", stem)).drop("__term")


def pool_union(*pools: DataFrame, order: str = "ord") -> DataFrame:
    """U-1. Pools one after the other: (priority, ord) is the order of the result."""
    out = None
    for n, pool in enumerate(pools):
        part = pool.withColumn("priority", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pin_restore(pool: DataFrame, pins: DataFrame, keys: list[str]) -> DataFrame:
    """U-2. Pins that a gate took out of the pool, in front of it."""
    return pool_union(pins.join(pool.select(*keys), keys, "left_anti"), pool)


def seeded_order(df: DataFrame, by: list[str], keys: list[str], seed: int, out: str = "ord") -> DataFrame:
    """A random order of each group's rows, numbered from 0, by a hash of the seed and the keys.

    It depends on the seed and the rows alone: the same at any number of partitions and in any run, another one for another
    seed. Rows with equal keys come in the order of their hash of all columns.
    """
    draw = F.xxhash64(F.lit(seed), *keys)
    w = Window.partitionBy(*by).orderBy(draw, *keys, F.xxhash64(*df.columns))
    return df.withColumn(out, F.row_number().over(w).cast("long") - 1)


def shuffled(df: DataFrame, by: list[str], keys: list[str], seed: int, order: str) -> DataFrame:
    """``df`` with its order column replaced by a seeded one, so that caps, quotas and budgets behind it (W-2, W-3, W-4) take a random choice."""
    return seeded_order(df.drop(order), by, keys, seed, order)


def subclip_windows(clips: DataFrame, max_clip: float, mode: str = "random", by: list[str] = (), keys: list[str] = (), seed: int | None = None) -> DataFrame:
    """E-1. Windows of max_clip seconds of each clip: full ones and always the first; sequential keeps the first only.

    With a ``seed``, random windows have an order (ord) of their own in each group ``by``, by the clips' ``keys`` and the window.
    """
    starts = F.when(F.col("duration") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("duration") / max_clip).cast("int") - 1))) if mode != "sequential" else F.array(F.lit(0))
    rows = clips.select("*", F.explode(starts).alias("window"))
    rows = rows.withColumns({"start": F.col("window") * F.lit(float(max_clip)), "end": F.least(F.col("duration"), (F.col("window") + 1) * F.lit(float(max_clip)))})
    rows = rows.where((F.col("window") == 0) | (F.col("end") - F.col("start") >= max_clip))
    return rows if seed is None or mode == "sequential" else seeded_order(rows, list(by), [*keys, "window"], seed)


def even_cut_offsets(sources: DataFrame, clip_len: float, n: int, head_skip: float = 6, tail_skip: float = 4) -> DataFrame:
    """E-2. Up to n offsets spread over the usable span of a source; a span no longer than a clip gives one."""
    span = F.col("duration") - head_skip - tail_skip
    step = F.greatest(F.lit(float(clip_len)), span / n)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(float(head_skip)) + k * step)
    fits = F.filter(at, lambda x: x + clip_len <= F.col("duration") - tail_skip)
    return sources.select("*", F.posexplode(F.when(span <= clip_len, F.array(F.lit(float(head_skip)))).otherwise(fits)).alias("cut", "offset"))


def sample_times(clips: DataFrame, n: int = 6, fractions: list[float] | None = None) -> DataFrame:
    """E-3. n evenly spaced instants of each clip, or those at fixed fractions."""
    shares = F.array(*map(F.lit, fractions)) if fractions else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k + 0.5) / n)
    return clips.select("*", F.posexplode(shares).alias("sample", "share")).withColumn("t", F.round(F.col("duration") * F.col("share"), 6)).drop("share")


def segment_cycle(segments: DataFrame, needed: DataFrame, by: str) -> DataFrame:
    """E-4. Clip i of a script uses its segment i mod n."""
    counts = segments.groupBy(by).agg(F.count("*").alias("__n")).join(needed, by)
    clips = counts.select(by, "__n", F.explode(F.sequence(F.lit(0), F.col("clips") - 1)).alias("clip")).withColumn("seg_idx", F.pmod("clip", "__n").cast("int"))
    return clips.drop("__n").join(segments, [by, "seg_idx"])
