"""Timelines: cut times, proportional timing, windows, beats, drops, snapping and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TICKS = 10_000_000


def _before(by: str, order: list[str]) -> Window:
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(by: str, order: list[str]) -> Window:
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cut_times(clips: DataFrame, by: str, order: str) -> DataFrame:
    """W-5. Running end of every clip but the last."""
    w = Window.partitionBy(by).orderBy(order)
    return clips.withColumns({"cut": F.round(F.sum("duration").over(_upto(by, [order])), 3), "__next": F.lead(order).over(w)}).where("__next is not null").select(by, order, "cut")


def proportional_timing(sentences: DataFrame, totals: DataFrame, by: str, order: str, text: str = "sentence", ticks_per_second: int = TICKS) -> DataFrame:
    """W-6. Share the total over sentences by characters, each share cut to whole ticks, then laid end to end."""
    rows = sentences.join(totals, by)
    ticks = F.floor(F.char_length(text) * F.floor(F.col("total_s") * ticks_per_second) / F.sum(F.char_length(text)).over(Window.partitionBy(by)))
    rows = rows.withColumn("__ticks", ticks)
    end = F.sum("__ticks").over(_upto(by, [order]))
    return rows.withColumns({"start_tick": end - F.col("__ticks"), "end_tick": end}).drop("__ticks", "total_s")


def chunk_offset_shift(words: DataFrame, by: str, chunk: str, order: str) -> DataFrame:
    """W-7. Words of later chunks move by the lengths of the chunks before, a chunk being as long as its last word's end."""
    ends = words.groupBy(by, chunk).agg(F.max_by("end", order).alias("__len")).withColumn("__off", F.coalesce(F.sum("__len").over(_before(by, [chunk])), F.lit(0.0)))
    rows = words.join(ends.drop("__len"), [by, chunk])
    return rows.withColumns({"start": F.round(F.col("start") + F.col("__off"), 3), "end": F.round(F.col("end") + F.col("__off"), 3)}).drop("__off")


def segment_windows(captions: DataFrame, audio: DataFrame, by: str, order: str, floor: float = 0.4, guard: float = 0.35) -> DataFrame:
    """W-8. Close gaps up to the next start; durations of at least ``floor``; the last takes what the audio leaves, plus a guard."""
    w = Window.partitionBy(by).orderBy(order)
    rows = captions.withColumn("__next", F.lead("start").over(w))
    rows = rows.withColumn("duration", F.greatest(F.lit(floor), F.coalesce("__next", "end") - F.col("start")))
    rows = rows.withColumn("__total", F.sum("duration").over(Window.partitionBy(by))).join(audio, by)
    extra = F.when(F.col("__next").isNull(), F.greatest(F.lit(0.0), F.col("audio_s") - F.col("__total")) + guard).otherwise(0.0)
    return rows.select(by, order, "start", F.round(F.col("duration") + extra, 3).alias("duration"))


def min_max_normalise(df: DataFrame, by: str, col: str, eps: float = 1e-6, out: str = "normal") -> DataFrame:
    """W-9. Place between the pool's smallest and largest value."""
    w = Window.partitionBy(by)
    return df.withColumn(out, (F.col(col) - F.min(col).over(w)) / (F.max(col).over(w) - F.min(col).over(w) + eps))


def energy_drop(series: DataFrame, by: str, t: str = "t", energy: str = "energy", search_max: float = 45.0) -> DataFrame:
    """W-10. Time of the largest rise of the 3-point mean in the first seconds; 0 without a rise; first of equal rises."""
    w = Window.partitionBy(by).orderBy(t)
    rows = series.withColumn("__m", F.sum(energy).over(w.rowsBetween(-1, 1)) / 3).withColumn("__d", F.round(F.col("__m") - F.lag("__m").over(w), 6)).where(F.col(t) <= search_max)
    top = rows.groupBy(by).agg(F.max("__d").alias("rise"), F.max_by(t, F.struct("__d", -F.col(t))).alias("at"))
    return top.select(by, F.when(F.col("rise") > 0, F.col("at")).otherwise(0.0).alias("drop_time"))


def onset_peaks(series: DataFrame, by: str, t: str = "t", onset: str = "onset", k: float = 0.6, min_gap: float = 0.18) -> DataFrame:
    """W-11. Local maxima above mean + k deviations, highest first, none closer than the gap to one that is taken.

    A flat top counts once, at its middle. Candidates come from windows; only the spacing is a fold over them.
    """
    w, every = Window.partitionBy(by).orderBy(t), Window.partitionBy(by)
    rows = series.withColumn("__new", F.coalesce((F.col(onset) != F.lag(onset).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumns({"__run": F.sum("__new").over(w), "__least": F.avg(onset).over(every) + k * F.stddev_pop(onset).over(every)})
    tops = rows.groupBy(by, "__run").agg(F.first(onset).alias("h"), F.max("__least").alias("least"), ((F.min(t) + F.max(t)) / 2).alias("t"))
    r = Window.partitionBy(by).orderBy("__run")
    tops = tops.withColumns({"a": F.lag("h").over(r), "z": F.lead("h").over(r)}).where("a < h and z < h and h >= least").select(by, F.col("t").cast("double").alias("t"), F.col("h").cast("double").alias("h"))

    def spaced(pdf):
        taken = []
        for row in pdf.sort_values(["h", "t"], ascending=[False, True]).itertuples(index=False):
            if all(abs(row.t - x) >= min_gap for x in taken):
                taken.append(row.t)
        return pdf[pdf["t"].isin(taken)].sort_values("t")

    return tops.groupBy(by).applyInPandas(spaced, tops.schema).select(by, F.round("t", 6).alias("t"), F.round("h", 6).alias("height"))


def dominant_period(series: DataFrame, by: str, idx: str = "idx", onset: str = "onset", fps: float = 10.0, lo: float = 60, hi: float = 200) -> DataFrame:
    """W-12. Rate per minute of the lag with the largest autocorrelation of the centred series, the shorter of equal ones.

    Lags go from the highest rate's up to the lowest rate's, that one left out. A series of under four values, or one that
    isn't longer than the last lag, has none (null), nor has one whose best lag is 0.
    """
    first, last = int(fps * 60.0 / hi), int(fps * 60.0 / lo)
    keys = series.groupBy(by).agg(F.count("*").alias("__n"))
    long = (F.col("__n") >= 4) & (F.col("__n") > last) & F.lit(last > first)
    rows = series.select(by, F.col(idx).alias("__i"), (F.col(onset) - F.avg(onset).over(Window.partitionBy(by))).alias("__c"))
    lags = rows.select(by, "__i", F.col("__c").alias("__x"), F.explode(F.sequence(F.lit(first), F.lit(max(first, last - 1)))).alias("__lag")).withColumn("__j", F.col("__i") + F.col("__lag"))
    pairs = lags.join(rows.select(by, F.col("__i").alias("__j"), F.col("__c").alias("__y")), [by, "__j"])
    score = pairs.groupBy(by, "__lag").agg(F.round(F.sum(F.col("__x") * F.col("__y")), 6).alias("__s"))
    best = score.groupBy(by).agg(F.max_by("__lag", F.struct("__s", -F.col("__lag"))).alias("__lag"))
    return keys.join(best, by, "left").select(by, F.when(long & (F.col("__lag") > 0), F.round(60.0 * fps / F.nullif("__lag", F.lit(0)), 1)).alias("bpm"))


def crossfade_timeline(clips: DataFrame, by: str, order: str, crossfade: float) -> DataFrame:
    """W-13. Start of each clip when neighbours overlap by the crossfade, and the total length."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = clips.withColumns({"__sum": F.coalesce(F.sum("duration").over(_before(by, [order])), F.lit(0.0)), "__rn": rn})
    w = Window.partitionBy(by)
    total = F.sum("duration").over(w) - crossfade * (F.count("*").over(w) - 1)
    return rows.select(by, order, F.round(F.col("__sum") - crossfade * (F.col("__rn") - 1), 6).alias("start"), F.round(total, 6).alias("total"))


def speech_end(silences: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """W-16. Where the last silence begins if it lasts to the file's end, else null."""
    last = silences.groupBy(by).agg(F.max(F.struct("end", "start")).alias("l"))
    ok = (F.abs(F.col("total_s") - F.col("l.end")) <= 0.35) & (F.col("l.start") > 1.0) & (F.col("l.start") < F.col("total_s"))
    return totals.join(last, by, "left").select(by, F.when(ok, F.round("l.start", 3)).alias("speech_end"))


def drop_alignment(beats: DataFrame, drops: DataFrame, seams: DataFrame, by: str) -> DataFrame:
    """W-17. Start the music so that its drop meets the seam; beats moved to the timeline, those outside left out."""
    rows = beats.join(drops, by).join(seams, by).withColumn("music_start", F.greatest(F.lit(0.0), F.col("drop_time") - F.col("seam")))
    rows = rows.withColumn("t", F.round(F.col("beat") - F.col("music_start"), 6))
    return rows.where((F.col("t") >= 0) & (F.col("t") <= F.col("total_s"))).select(by, "music_start", "t")


def speech_target(words: DataFrame, audio: DataFrame, by: str, order: list[str]) -> DataFrame:
    """W-18. The last timed unit's end where it lies in the audio, else the audio's length."""
    last = words.groupBy(by).agg(F.max_by("end", F.struct(*order)).alias("__end"))
    rows = audio.join(last, by, "left")
    return rows.select(by, F.when((F.col("__end") > 0) & (F.col("__end") <= F.col("audio_s")), F.col("__end")).otherwise(F.col("audio_s")).alias("target_s"))


def nearest_event_snap(points: DataFrame, beats: DataFrame, by: str, t: str = "t", beat: str = "beat") -> DataFrame:
    """J-3. Each time moves to its key's nearest beat, the earlier of two; unchanged where there is none.

    Points and beats are one ordered stream per key; the last beat before and the first after come from two windows.
    """
    both = points.select(by, F.col(t).alias("__t"), F.lit(None).cast("double").alias("__b"), F.lit(1).alias("__point")).unionByName(
        beats.select(by, F.col(beat).alias("__t"), F.col(beat).cast("double").alias("__b"), F.lit(0).alias("__point"))
    )
    back = Window.partitionBy(by).orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(by).orderBy("__t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = both.withColumns({"a": F.last("__b", ignorenulls=True).over(back), "z": F.first("__b", ignorenulls=True).over(ahead)}).where("__point = 1")
    near = F.when(F.col("a").isNull(), F.coalesce("z", "__t")).when(F.col("z").isNull() | (F.col("__t") - F.col("a") <= F.col("z") - F.col("__t")), F.col("a")).otherwise(F.col("z"))
    return rows.select(by, F.col("__t").alias(t), near.alias("snapped"))


def loop_fill_to_duration(clips: DataFrame, targets: DataFrame, by: str, order: str, reuse_limit: int | None = None, strict: bool = False, tolerance: float = 0.2) -> DataFrame:
    """G-4. Repeat the clips in order until the audio is covered, each at most ``reuse_limit`` times (None: as often as it takes).

    No fold: every repeat of every clip is a row, and a running sum cuts them. Repeats come only where speech isn't
    covered. ``strict``: nothing is repeated, and clips that are short by more than the tolerance are an error. Clips
    without any length are never repeated.
    """
    w = Window.partitionBy(by)
    rows = clips.join(targets, by).withColumn("__sum", F.sum("duration").over(w))
    if strict:
        short = F.col("__sum") + tolerance < F.col("speech_s")
        message = F.concat(F.lit("clips are short: "), F.round("__sum", 2), F.lit(" s of "), F.round("speech_s", 2), F.lit(" s"))
        rows = rows.withColumn("__sum", F.when(short, F.raise_error(message).cast("double")).otherwise(F.col("__sum")))
        need = F.when(F.col("__sum").isNotNull(), 1)  # the sum is looked at, so a short one is seen
    else:
        need = F.when((F.col("__sum") >= F.col("speech_s")) | (F.col("__sum") <= 0), 1).otherwise(F.ceil(F.col("audio_s") / F.col("__sum")))
        need = F.least(need, F.lit(reuse_limit)) if reuse_limit else need
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), need.cast("int")))).alias("loop"))
    rows = rows.withColumn("__before", F.coalesce(F.sum("duration").over(_before(by, ["loop", order])), F.lit(0.0)))
    rows = rows.where((F.col("loop") == 1) | (F.round(F.col("__before"), 6) < F.col("audio_s")))
    return rows.select(by, "loop", order, "duration", F.round("__before", 6).alias("start"))


def pin_and_loop_edits(timeline: DataFrame, pins: DataFrame, covers: DataFrame, by: str, order: str) -> DataFrame:
    """G-5. Pins take the first places in order; the last visual becomes the opening still unless the opening is video."""
    rows = timeline.join(pins.select(by, F.col("ord").alias(order), F.col("path").alias("__pin")), [by, order], "left").join(covers, by, "left")
    last = F.max(order).over(Window.partitionBy(by))
    path = F.coalesce("__pin", "path")
    path = F.when((F.col(order) == last) & F.col("cover").isNotNull() & ~F.col("cover_is_video"), F.col("cover")).otherwise(path)
    return rows.select(by, order, path.alias("path"))


def highlight_spans(captions: DataFrame, words: DataFrame, by: str, order: str) -> DataFrame:
    """W-14. Gapless plain and highlighted spans of each caption; words are clamped to it and come in order of their start.

    A word is highlighted if it equals a word of the caption's text in any case; another one, and an empty one, gets no span, but time
    moves on to its end. A caption without words in it is one plain span. A word that the clamping leaves without length doesn't count.
    """
    keys = [by, order]
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    frames = captions.select(*keys, F.col("start").alias("__c0"), F.col("end").alias("__c1"), F.split(F.lower("text"), r"(?U)\s+").alias("__text"))
    timed = words.select(*keys, bare(F.coalesce("word", F.lit(""))).alias("__word"), F.col("start").alias("__w0"), F.col("end").alias("__w1"), F.col("word_idx").alias("__at"))
    inside = timed.join(frames.drop("__text"), keys).withColumns({"__from": F.greatest("__w0", "__c0"), "__to": F.least("__w1", "__c1")}).where("__to > __from")
    w = Window.partitionBy(*keys).orderBy("__w0", "__at")
    inside = inside.withColumns({"__prev": F.lag("__to").over(w), "__last": F.lead("__at").over(w).isNull()}).drop("__c0", "__c1", "__w0", "__w1", "__at")
    rows = frames.join(inside, keys, "left")
    lit = F.when((F.col("__word") != "") & F.array_contains("__text", F.lower("__word")), F.struct(F.lit("highlight").alias("kind"), F.col("__from").alias("from"), F.col("__to").alias("to"), F.col("__word").alias("token")))
    plain = lambda a, z, when: F.when(when & (z > a), F.struct(F.lit("plain").alias("kind"), a.alias("from"), z.alias("to"), F.lit(None).cast("string").alias("token")))
    parts = F.array(plain(F.coalesce("__prev", "__c0"), F.col("__from"), F.lit(True)), lit, plain(F.coalesce("__to", "__c0"), F.col("__c1"), F.coalesce("__last", F.lit(True))))
    return rows.select(*keys, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("__s")).select(*keys, "__s.kind", F.round("__s.from", 3).alias("from"), F.round("__s.to", 3).alias("to"), "__s.token")


def sticker_spacing(tagged: DataFrame, by: str, t: str = "t", gap: float = 1.2) -> DataFrame:
    """W-15. Tagged words at least ``gap`` after the last one that was accepted (a fold over one script's sorted times)."""
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(acc, x):
        ok = acc["last"].isNull() | (x - acc["last"] >= gap)
        return F.struct(F.when(ok, x).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    folded = tagged.groupBy(by).agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("ts"))
    return folded.select(by, F.explode(F.aggregate("ts", zero, step, lambda a: a["kept"])).alias(t))


