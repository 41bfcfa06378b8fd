"""Vector matching of media to script segments, gates over scores, and the per-script selection folds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embed_distinct(df: DataFrame, key: str, text: str, embedder: Callable[[Column], Column], out: str = "embedding") -> DataFrame:
    """M-1. Embed each different key once and join the vectors back."""
    once = df.select(key, text).dropDuplicates([key]).withColumn(out, embedder(F.col(text))).select(key, out)
    return df.join(once, key, "left")


def segment_media_similarity(segments: DataFrame, media: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """J-4. Cosine of every segment with every media item of the same pool (vectors of unit length).

    The pool key is an equi-join key. Both sides are few per pool by nature; a pool's rows stream through the join, and
    the result has segments x media rows, which is the operator's output.
    """
    left = segments.select(by, "seg_idx", F.col(vec).alias("__a"))
    right = media.select(by, "media_idx", F.col(vec).alias("__b"))
    return left.join(right, by).select(by, "seg_idx", "media_idx", F.round(dot("__a", "__b"), 6).alias("sim"))


#: Media and segments of one pool that a task multiplies at once, about.
MEDIA_AT_ONCE, SEGMENTS_AT_ONCE = 4096, 1024


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.compute.list_flatten(column.combine_chunks())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _kept_of_blocks(segments: DataFrame, media: DataFrame, by: str, vec: str, block: Column, keep: Callable, carried: tuple[str, ...]) -> DataFrame:
    """(by, seg_idx, media_idx, sim): what ``keep`` leaves of each block of a pool's matrix of cosines.

    A pool's media are dealt over blocks, its segments over parts, by their number; each part meets each block in a task as two Arrow
    tables, whose vectors are multiplied at once. ``keep(sims, segments, media)`` marks the pairs of a block that may count.
    ``media`` has __blocks, the number of its pool's blocks, for ``block``.
    """
    dealt = media.withColumn("__block", block.cast("long")).select(by, "__block", "media_idx", F.col(vec).alias("__b"), *carried)
    sizes = segments.groupBy(by).agg(F.ceil(F.count("*") / SEGMENTS_AT_ONCE).alias("__parts"))
    pools = media.groupBy(by).agg(F.max("__blocks").alias("__blocks"))
    rows = segments.join(sizes, by).join(pools, by).withColumn("__part", F.pmod(F.xxhash64("seg_idx"), F.col("__parts")))
    own = [c for c in segments.columns if c.startswith("__")]
    left = rows.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__block"), "__part", "seg_idx", F.col(vec).alias("__a"), *own)
    right = dealt.join(sizes, by).select(*dealt.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__part"))
    kind = T.StructType([media.schema[by], segments.schema["seg_idx"], media.schema["media_idx"], T.StructField("sim", T.DoubleType())])

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], f.type) for n, f in zip(kind.names, (b.schema.field(by), a.schema.field("seg_idx"), b.schema.field("media_idx"), pa.field("sim", pa.float64())), strict=True)})
        b = b.sort_by("media_idx")
        sims = np.round(_vectors(a.column("__a")) @ _vectors(b.column("__b")).T, 6) + 0.0
        i, j = np.nonzero(keep(sims, a, b))
        return pa.table([b.column(by).take(j), a.column("seg_idx").take(i), b.column("media_idx").take(j), pa.array(sims[i, j])], names=kind.names)

    keys = [by, "__block", "__part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, kind)


def _first_of_rows(values: np.ndarray, k: int) -> np.ndarray:
    """Marks the k greatest of each row, of equal ones those further left."""
    if values.shape[1] <= k:
        return np.ones(values.shape, bool)
    order = np.argsort(-values, axis=1, kind="stable")[:, :k]
    out = np.zeros(values.shape, bool)
    np.put_along_axis(out, order, True, axis=1)
    return out


def _blocks_of(media: DataFrame, by: str) -> DataFrame:
    return media.join(media.groupBy(by).agg(F.ceil(F.count("*") / MEDIA_AT_ONCE).alias("__blocks")), by)


def top_media(segments: DataFrame, media: DataFrame, by: str, k: int = 1, vec: str = "embedding") -> DataFrame:
    """T-3 for large pools: (by, seg_idx, media_idx, sim) of the k best items of each segment, the lower index of equal scores.

    Each block of a pool gives its k best, so no row is made for each pair; ``segment_media_similarity`` has the same scores.
    """
    rows = _kept_of_blocks(segments, _blocks_of(media, by), by, vec, F.pmod(F.xxhash64("media_idx"), F.col("__blocks")), lambda sims, a, b: _first_of_rows(sims, k), ())
    best = Window.partitionBy(by, "seg_idx").orderBy(F.desc("sim"), "media_idx")
    return rows.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= k).drop("__rn")


def assignment_similarity(segments: DataFrame, media: DataFrame, by: str, video_bonus: float = 0.0, vec: str = "embedding") -> DataFrame:
    """J-4 for G-1: of each segment and kind the items that ``assign_media_to_segments`` can reach, without a row for each pair.

    That is what ``prune_for_assignment`` keeps: the best n sources and in each the best n cuts, n segments. A source lies in
    one block whole, which leaves out its worse sources; one with more items than a block holds is dealt over several,
    where only its worse cuts go.
    """
    sources = media.groupBy(by, "source").agg(F.count("*").alias("__of"))
    rows = _blocks_of(media, by).join(sources, [by, "source"]).withColumn("__wide", F.col("__of") > MEDIA_AT_ONCE)
    block = F.pmod(F.when(F.col("__wide"), F.xxhash64("source", "media_idx")).otherwise(F.xxhash64("source")), F.col("__blocks"))
    n = segments.groupBy(by).agg((F.max("seg_idx") + 1).alias("__n"))

    def keep(sims: np.ndarray, a: pa.Table, b: pa.Table) -> np.ndarray:
        most = a.column("__n")[0].as_py()
        source, kind = b.column("source").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), b.column("is_video").to_numpy(zero_copy_only=False).astype(bool)
        wide = b.column("__wide").to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros(sims.shape, bool)
        for video in (False, True):
            tops, groups = [], []
            for x in np.unique(source[kind == video]).tolist():
                at = np.flatnonzero((source == x) & (kind == video))
                out[:, at] = _first_of_rows(sims[:, at], most)
                groups.append(at)
                tops.append(np.where(wide[at[0]], np.inf, sims[:, at].max(axis=1)))
            if len(groups) > most:  # a source among the best n of all is among the best n here
                level = np.sort(np.stack(tops, axis=1), axis=1)[:, -most]
                for at, top in zip(groups, tops, strict=True):
                    out[:, at] &= (top >= level)[:, None]
        return out

    return _kept_of_blocks(segments.join(n, by), rows, by, vec, block, keep, ("source", "is_video", "__wide"))


def best_media(sims: DataFrame, by: str) -> DataFrame:
    """T-3. The best item of each segment; the lower index of equal scores."""
    best = sims.groupBy(by, "seg_idx").agg(F.max(F.struct("sim", (-F.col("media_idx")).alias("m"))).alias("b"))
    return best.select(by, "seg_idx", (-F.col("b.m")).alias("media_idx"), F.col("b.sim").alias("sim"))


def relevance_filter(scores: DataFrame, by: str, min_score: float, min_keep: int, strict: bool = False) -> DataFrame:
    """T-4. Items of enough score; unless strict, all video too, and the best ``min_keep`` instead where fewer are left."""
    good = F.col("score") >= min_score if strict else (F.col("score") >= min_score) | F.col("is_video")
    w = Window.partitionBy(by)
    rows = scores.withColumns({"__ok": good, "__kept": F.count_if(good).over(w), "__rank": F.row_number().over(w.orderBy(F.desc("score"), "media_idx"))})
    stays = F.col("__ok") if strict else F.when(F.col("__kept") < min_keep, F.col("__rank") <= min_keep).otherwise(F.col("__ok"))
    return rows.where(stays).select(*scores.columns)


def hook_candidate(frames: DataFrame, by: str, min_similarity: float, negative_margin: float) -> DataFrame:
    """T-5. The best opening frame of a pool, null if none is close enough to its text and clear of the negatives."""
    w = Window.partitionBy(by)
    sharp = (F.col("sharpness") - F.min("sharpness").over(w)) / (F.max("sharpness").over(w) - F.min("sharpness").over(w) + 1e-6)
    contrast = F.col("pos") - F.array_max("negs")
    rows = frames.withColumns({"__c": contrast, "__s": sharp}).withColumn("__ok", (F.col("pos") >= min_similarity) & (F.col("__c") >= negative_margin))
    score = F.round(F.col("pos") + 0.04 * F.col("__s") + 0.10 * F.col("__c"), 9)
    best = rows.groupBy(by).agg(F.max(F.when(F.col("__ok"), F.struct(score.alias("s"), (-F.col("idx")).alias("i")))).alias("b"))
    return best.select(by, (-F.col("b.i")).alias("idx"), F.round("b.s", 6).alias("score"))


def subject_presence_gate(media: DataFrame, labels: DataFrame, by: str, margin: float, abs_floor: float, video_margin: float = 0.35, video_abs_floor: float | None = None, min_keep: int = 1, strict: bool = False) -> DataFrame:
    """T-6. Items whose softmax over positive and negative labels says that the subject is there.

    ``labels`` has (by, media_idx, positive, cos). Photos need the margin and the floor; video may fall short by less than
    ``video_margin`` (or has thresholds of its own, if strict). Too few are filled up by probability, never below the
    floor; an empty result gives the best ``min_keep``, unless strict.
    """
    w = Window.partitionBy(by, "media_idx")
    p = labels.withColumn("__e", F.exp(100 * (F.col("cos") - F.max("cos").over(w))))
    p = p.withColumn("__p", F.col("__e") / F.sum("__e").over(w)).groupBy(by, "media_idx").agg(
        F.max(F.when(F.col("positive"), F.col("__p"))).alias("p_pos"), F.coalesce(F.max(F.when(~F.col("positive"), F.col("__p"))), F.lit(0.0)).alias("p_neg")
    )
    rows = media.join(p, [by, "media_idx"])
    gap = F.col("p_pos") - F.col("p_neg")
    photo = (gap >= margin) & (F.col("p_pos") >= abs_floor)
    video = (gap >= video_margin) & (F.col("p_pos") >= (abs_floor if video_abs_floor is None else video_abs_floor)) if strict else -gap < video_margin
    rows = rows.withColumn("__ok", F.when(F.col("is_video"), video).otherwise(photo))
    pool = Window.partitionBy(by)
    rank = F.row_number().over(pool.orderBy(F.col("__ok").desc(), F.round("p_pos", 9).desc(), "media_idx"))
    rows = rows.withColumns({"__kept": F.count_if("__ok").over(pool), "__rank": rank, "__floor": F.col("p_pos") >= abs_floor})
    rows = rows.withColumn("__take", F.col("__ok") | ((F.col("__rank") <= min_keep) & F.col("__floor")))
    rows = rows.withColumn("__any", F.count_if("__take").over(pool))
    stays = F.col("__take") if strict else F.col("__take") | ((F.col("__any") == 0) & (F.col("__rank") <= min_keep))
    return rows.where(stays).select(*media.columns, F.round("p_pos", 6).alias("p_pos"), F.round("p_neg", 6).alias("p_neg"))


def modality_blend(text_sims: DataFrame, image_sims: DataFrame, by: str, w_text: float = 0.3, w_image: float = 0.7) -> DataFrame:
    """T-9. Weighted sum of the text cosine and the best image cosine, the latter rescaled to 0 .. 1; text alone without images."""
    best = image_sims.groupBy(by, "seg_idx", "media_idx").agg(F.max("sim").alias("__img"))
    rows = text_sims.join(best, [by, "seg_idx", "media_idx"], "left")
    return rows.select(by, "seg_idx", "media_idx", F.round(F.when(F.col("__img").isNull(), F.col("sim")).otherwise(w_text * F.col("sim") + w_image * (F.col("__img") + 1) / 2), 9).alias("blend"))


def representative_images(images: DataFrame, keys: list[str], order: str, most: int = 1) -> DataFrame:
    """T-9. The first image of each item and evenly spaced ones behind it, at most so many."""
    w = Window.partitionBy(*keys)
    rows = images.withColumns({"__n": F.count("*").over(w), "__at": F.row_number().over(w.orderBy(order)) - 1})
    taken = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * F.col("__n") / most).cast("int"))
    return rows.where((F.col("__n") <= most) | F.array_contains(taken, F.col("__at"))).drop("__n", "__at")


def prune_for_assignment(sims: DataFrame, media: DataFrame, by: str, video_bonus: float = 0.0) -> DataFrame:
    """What a greedy assignment can reach: of each segment and kind the best n sources, in each the best n cuts, n = segments.

    Before a segment's turn at most n - 1 sources and cuts have been touched, so an untouched one is among the best n.
    """
    rows = sims.join(media.select(by, "media_idx", "source", "is_video"), [by, "media_idx"])
    rows = rows.withColumns({"__s": F.col("sim") + F.when(F.col("is_video"), video_bonus).otherwise(0.0), "__n": F.max("seg_idx").over(Window.partitionBy(by)) + 1})
    cut = Window.partitionBy(by, "seg_idx", "is_video", "source").orderBy(F.desc("__s"), "media_idx")
    rows = rows.withColumn("__cut", F.row_number().over(cut)).where(F.col("__cut") <= F.col("__n"))
    best = Window.partitionBy(by, "seg_idx", "is_video", "source")
    rows = rows.withColumn("__best", F.max(F.struct("__s", -F.col("media_idx"))).over(best))
    rows = rows.withColumn("__src", F.dense_rank().over(Window.partitionBy(by, "seg_idx", "is_video").orderBy(F.desc("__best"))))
    return rows.where(F.col("__src") <= F.col("__n")).select(by, "seg_idx", "media_idx", "sim", "source", "is_video")


def _folded(df: DataFrame, by: str, fold: Callable[[pd.DataFrame], list[tuple]], columns: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([df.schema[by], *(T.StructField(n, t) for n, t in columns)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fold(pdf), columns=[n for n, _ in columns])
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return df.groupBy(by).applyInPandas(run, schema)


def assign_media_to_segments(sims: DataFrame, media: DataFrame, by: str, reuse_penalty: float = 0.12, source_penalty: float = 0.08, max_media_reuse: int = 0, max_source_reuse: int = 0, video_bonus: float = 0.0, min_video_fraction: float = 0.0, min_score: float = 0.0, strict: bool = False) -> DataFrame:
    """G-1. (by, seg_idx, media_idx, sim): one media item per segment, in spoken order.

    The score falls with the uses of the item and of its source. Caps of 0 are none. The same item never follows itself,
    another source than the last is preferred. ``min_video_fraction`` of the segments, those with the best video, must take
    video and the others photos. A strict script with no allowed item, or too low a score, gives no rows.
    """
    n_forced = lambda n: int(np.rint(min_video_fraction * n))
    tops = sims.join(media.select(by, "media_idx", "is_video"), [by, "media_idx"]).groupBy(by, "seg_idx").agg(F.max(F.when(F.col("is_video"), F.col("sim"))).alias("__top"))
    rows = prune_for_assignment(sims, media, by, video_bonus).join(tops, [by, "seg_idx"])

    def fold(pdf: pd.DataFrame) -> list[tuple]:
        by_segment = {s: g.sort_values("media_idx").to_dict("records") for s, g in pdf.groupby("seg_idx")}
        ranked = sorted(((g[0]["__top"], -s) for s, g in by_segment.items() if g[0]["__top"] is not None and not pd.isna(g[0]["__top"])), reverse=True)
        forced = {-s for _, s in ranked[: n_forced(len(by_segment))]}
        uses, sources, last, out = {}, {}, None, []
        for s in sorted(by_segment):
            pool = by_segment[s]
            if min_video_fraction > 0:
                pool = [r for r in pool if r["is_video"] == (s in forced)] or pool
            ok = [r for r in pool if (last is None or r["media_idx"] != last["media_idx"]) and (not max_media_reuse or uses.get(r["media_idx"], 0) < max_media_reuse) and (not max_source_reuse or sources.get(r["source"], 0) < max_source_reuse)]
            if not ok:
                if strict:
                    return []
                ok = [r for r in pool if last is None or r["media_idx"] != last["media_idx"]] or pool
            other = [r for r in ok if last is None or r["source"] != last["source"]]
            pick = max(other or ok, key=lambda r: (r["sim"] - reuse_penalty * uses.get(r["media_idx"], 0) - source_penalty * sources.get(r["source"], 0) + (video_bonus if r["is_video"] else 0.0), -r["media_idx"]))
            if strict and pick["sim"] < min_score:
                return []
            uses[pick["media_idx"]] = uses.get(pick["media_idx"], 0) + 1
            sources[pick["source"]] = sources.get(pick["source"], 0) + 1
            out.append((s, pick["media_idx"], pick["sim"]))
            last = pick
        return out

    return _folded(rows, by, fold, [("seg_idx", sims.schema["seg_idx"].dataType), ("media_idx", sims.schema["media_idx"].dataType), ("sim", T.DoubleType())])


def rank_media_for_script(sims: DataFrame, by: str) -> DataFrame:
    """G-2. (by, pos, media_idx): for each segment the best unused item (the higher index of equal scores), then the best
    but the last one once all are used; leftovers follow in their own order.

    Before a segment's turn fewer items are used than there are segments, so the fold sees so many of each segment only;
    leftovers are numbered behind it by a window.
    """
    n = sims.groupBy(by).agg(F.count_distinct("seg_idx").alias("__n"))
    best = Window.partitionBy(by, "seg_idx").orderBy(F.desc("sim"), F.desc("media_idx"))
    rows = sims.select(by, "seg_idx", "media_idx", "sim").join(n, by).withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= F.col("__n"))

    def fold(pdf: pd.DataFrame) -> list[tuple]:
        used, order = set(), []
        for _, g in pdf.sort_values("seg_idx").groupby("seg_idx"):
            ranked = sorted(zip(g["sim"], g["media_idx"], strict=True), reverse=True)
            free = [m for _, m in ranked if m not in used] or [m for _, m in ranked if not order or m != order[-1]] or [ranked[0][1]]
            order.append(free[0])
            used.add(free[0])
        return list(enumerate(order))

    picks = _folded(rows.select(by, "seg_idx", "media_idx", "sim"), by, fold, [("pos", T.IntegerType()), ("media_idx", sims.schema["media_idx"].dataType)])
    rest = sims.select(by, "media_idx").distinct().join(picks.select(by, "media_idx"), [by, "media_idx"], "left_anti").join(n, by)
    behind = F.row_number().over(Window.partitionBy(by).orderBy("media_idx")) - 1 + F.col("__n")
    return picks.unionByName(rest.select(by, behind.cast("int").alias("pos"), "media_idx"))


def select_clips_for_script(sims: DataFrame, audio: DataFrame, by: str, max_clip: float, max_reuse: int = 2) -> DataFrame:
    """G-3. (by, clip, seg_idx, media_idx, seconds): ceil(audio / max_clip) clips over the segments in turn.

    Uses lower a score by 0, .2, .4, .6 and, at the limit, by 1 (with a limit of one use: by 1 while unused items are
    left, else by .3). A pool of fewer items than clips has a limit of what is needed, or less if more wasn't allowed.
    A score of -1 or less is never taken. Before a clip's turn fewer items are used than there are clips, so an unused one is
    among the best so many of its segment, and the fold sees no others.
    """
    sizes = sims.groupBy(by).agg(F.count_distinct("media_idx").alias("__size"))
    best = Window.partitionBy(by, "seg_idx").orderBy(F.desc("sim"), "media_idx")
    rows = sims.select(by, "seg_idx", "media_idx", "sim").join(audio, by).join(sizes, by).withColumn("__rn", F.row_number().over(best))
    rows = rows.where(F.col("__rn") <= F.greatest(F.lit(1), F.ceil(F.col("audio_s") / max_clip)))

    def fold(pdf: pd.DataFrame) -> list[tuple]:
        seconds = float(pdf["audio_s"].iloc[0])
        need = int(np.ceil(seconds / max_clip))
        segments = sorted(pdf["seg_idx"].unique().tolist())
        pool = {s: list(zip(g["media_idx"], g["sim"], strict=True)) for s, g in pdf.sort_values("media_idx").groupby("seg_idx")}
        size = int(pdf["__size"].iloc[0])
        required = -(-need // size)
        limit = max_reuse if need <= size else required if max_reuse == 1 else min(required, max_reuse)
        uses, out = {}, []
        for clip in range(need):
            best, best_score = None, -1.0
            for m, sim in pool[segments[clip % len(segments)]]:
                n = uses.get(m, 0)
                if limit == 1:
                    penalty = 0.0 if n == 0 else 1.0 if len(uses) < size else 0.3
                else:
                    penalty = (0.0, 0.2, 0.4, 0.6)[n] if n < min(limit, 4) else 1.0
                if sim - penalty > best_score and (sim - penalty > 0 or best_score < 0):
                    best, best_score = m, sim - penalty
            if best is None:
                continue
            uses[best] = uses.get(best, 0) + 1
            out.append((clip, segments[clip % len(segments)], best, round(seconds / need, 6)))
        return out

    kinds = [("clip", T.IntegerType()), ("seg_idx", sims.schema["seg_idx"].dataType), ("media_idx", sims.schema["media_idx"].dataType), ("seconds", T.DoubleType())]
    return _folded(rows, by, fold, kinds)
