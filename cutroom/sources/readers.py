"""Sources: exported statistics, batch files, sidecars, manifests, subtitles, voice catalogues and captured provider replies."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the exported statistics table.
EXPORT_COLUMNS = {"Content": "content_id", "Video title": "title", "Duration": "duration_s", "Views": "views", "Subscribers": "subscribers"}
SIDECAR = "_metadata.json"
ASPECTS = {"16:9": (1920, 1080), "9:16": (1080, 1920), "1:1": (1080, 1080)}


def read_analytics_export(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1. Raw content rows (text columns) of a CSV file, a folder of them, or ZIP files that hold one; totals are left out."""
    if path.endswith(".zip"):
        files = spark.read.format("binaryFile").load(path).select("content")

        def unpack(frames):
            for frame in frames:
                for body in frame["content"]:
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        for name in z.namelist():
                            if name.endswith("Table data.csv"):
                                rows = pd.read_csv(z.open(name), dtype=str, keep_default_na=False, encoding="utf-8-sig")
                                yield rows[list(EXPORT_COLUMNS)].rename(columns=EXPORT_COLUMNS)

        raw = files.mapInPandas(unpack, ", ".join(f"{c} string" for c in EXPORT_COLUMNS.values()))
    else:
        table = spark.read.csv(path, header=True)
        raw = table.select(*[F.col(f"`{c}`").alias(n) for c, n in EXPORT_COLUMNS.items()])
    return raw.where("content_id <> 'Total'")


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2. One row per video of the batch files: file, ordinal, defaults and entry as JSON; a file without videos is an error."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    videos = F.from_json(F.get_json_object("value", "$.videos"), "array<string>")
    rows = text.select("file", F.coalesce(F.get_json_object("value", "$.defaults"), F.lit("{}")).alias("defaults"), F.when(F.size(F.coalesce(videos, F.array().cast("array<string>"))) == 0, F.raise_error(F.concat(F.lit("no videos in "), F.col("file"))).cast("array<string>")).otherwise(videos).alias("v"))
    return rows.select("file", "defaults", F.posexplode("v").alias("ordinal", "entry"))


def file_place(path: str) -> Column:
    """Folder and name of a file without its ending: what a media file and its sidecar have in common."""
    return F.regexp_replace(path, r"([^/.][^/]*)\.[^./]*$", "$1")


def with_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media files (path, file_size, modified) with the fields of their sidecars (path, value: a JSON text): path, search_term, file_size, created_at.

    A sidecar belongs to the file of its own folder and name, ``<name>_metadata.json``, whatever path is written in it, so pairs that have
    been moved still meet. A file without one, or whose sidecar isn't an object or lacks a field, has its name as search term, its own size
    and the time of its last change in seconds. Of several files of one place each has the sidecar.
    """
    side = sidecars.where(F.col("path").endswith(SIDECAR)).select(F.expr(f"left(path, char_length(path) - {len(SIDECAR)})").alias("__place"), F.from_json("value", "search_term string, file_size bigint, created_at double").alias("__s"))
    side = side.groupBy("__place").agg(F.first("__s").alias("__s"))
    rows = media.withColumn("__place", file_place("path")).join(side, "__place", "left")
    stem = F.url_decode(F.replace(F.regexp_extract("__place", r"([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return rows.select("path", F.coalesce("__s.search_term", stem).alias("search_term"), F.coalesce("__s.file_size", "file_size").alias("file_size"), F.coalesce("__s.created_at", F.col("modified").cast("double")).alias("created_at"))


def read_media_sidecars(spark: SparkSession, path: str, pattern: str = "*.{mp4,mov,mkv,webm,jpg,jpeg,png,webp}") -> DataFrame:
    """SRC-3. The media files below a folder with their sidecars' fields (``with_sidecars``).

    Places, sizes and times come from the listing (``_metadata``): no media file is opened.
    """
    listed = lambda kind, only: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", only)
    media = listed("binaryFile", pattern).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"))
    sidecars = listed("text", f"*{SIDECAR}").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return with_sidecars(media, sidecars)


def read_task_manifests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4. Script, search terms (list or text) and parameters (JSON) of each task's manifest."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    terms = get("search_terms")
    listed = F.coalesce(F.when(terms.startswith("["), F.from_json(terms, "array<string>")), F.filter(F.transform(F.split(terms, "[,，]"), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("task_id"), get("script").alias("script"), listed.alias("terms"), get("params").alias("params"))


def read_srt(texts: DataFrame, by: str, text: str = "srt", keep_last: bool = False) -> DataFrame:
    """SRC-5. Cues of subtitle texts (cue_idx, start_ms, end_ms, text). A cue counts only if a blank line follows it."""
    from cutroom.functions.text import parse_time

    body = F.concat(F.replace(F.col(text), F.lit("\r"), F.lit("")), F.lit("\n\n" if keep_last else ""))
    cue = r"(?m)^(\d+)\n(\d+:\d+:\d+[,.]\d+ --> \d+:\d+:\d+[,.]\d+)\n((?:.+\n)+)\n"
    rows = texts.select(by, F.posexplode(F.regexp_extract_all(body, F.lit(cue), F.lit(0))).alias("cue_idx", "c"))
    time = F.regexp_extract("c", cue, 2)
    return rows.select(by, "cue_idx", parse_time(F.split_part(time, F.lit(" --> "), F.lit(1))).alias("start_ms"), parse_time(F.split_part(time, F.lit(" --> "), F.lit(2))).alias("end_ms"), F.rtrim(F.regexp_replace(F.regexp_extract("c", cue, 3), r"\n$", "")).alias("text"))


def read_voice_catalog(texts: DataFrame, text: str = "value", locales: list[str] | None = None) -> DataFrame:
    """SRC-6. "name-gender" of each block of a voice list, of the wanted locales, sorted."""
    block = r"Name:\s*(\S+)\s*\n\s*Gender:\s*(\S+)"
    rows = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(block), F.lit(0))).alias("b"))
    rows = rows.select(F.concat_ws("-", F.regexp_extract("b", block, 1), F.regexp_extract("b", block, 2)).alias("voice"))
    if locales:
        wanted = F.lit(False)
        for x in locales:
            wanted = wanted | F.lower("voice").startswith(x.lower())
        rows = rows.where(wanted)
    return rows.orderBy("voice")


def normalize_video_hits(hits: DataFrame, provider: str, aspect: str = "9:16", min_dur: int = 5) -> DataFrame:
    """SRC-7. Candidates of captured replies (provider, url, duration, term, thumbnail, previews) in reply order.

    "files": the first file of exactly the aspect's size. "renditions": the first rendition, in reply order, that is wide enough.
    """
    width, height = ASPECTS[aspect]
    if provider == "files":
        kind = "videos array<struct<duration: int, image: string, video_files: array<struct<link: string, width: int, height: int>>, video_pictures: array<struct<picture: string>>>>"
        v = hits.select("term", "term_ord", F.posexplode(F.from_json("body", kind)["videos"]).alias("hit_ord", "v")).where(F.col("v.duration") >= min_dur)
        file = F.try_element_at(F.filter("v.video_files", lambda f: (f["width"] == width) & (f["height"] == height)), F.lit(1))
        rows = v.select("*", file.alias("f"), F.col("v.image").alias("thumbnail_url"), F.transform("v.video_pictures", lambda p: p["picture"]).alias("preview_images"))
    else:
        kind = "hits array<struct<duration: int, videos: map<string, struct<url: string, width: int>>>>"
        v = hits.select("term", "term_ord", F.posexplode(F.from_json("body", kind)["hits"]).alias("hit_ord", "v")).where(F.col("v.duration") >= min_dur)
        file = F.try_element_at(F.filter(F.map_values("v.videos"), lambda f: f["width"] >= width), F.lit(1))
        rows = v.select("*", F.struct(file["url"].alias("link")).alias("f"), F.lit(None).cast("string").alias("thumbnail_url"), F.array().cast("array<string>").alias("preview_images"))
    return rows.where("f.link is not null").select(F.lit(provider).alias("provider"), F.col("f.link").alias("url"), F.col("v.duration").alias("duration"), "term", "term_ord", "hit_ord", "thumbnail_url", "preview_images")


def normalize_image_hits(hits: DataFrame, provider: str, seconds: int = 5) -> DataFrame:
    """SRC-8. Photos of captured replies with a constant duration; the largest address that a provider gives."""
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(f"v.{n}"), F.lit("")) for n in names))
    if provider == "wiki":
        kind, root, url = "pages array<struct<url: string, mime: string>>", "pages", pick("url")
    elif provider == "sized":
        kind, root, url = "photos array<struct<src: struct<large2x: string, large: string, original: string>>>", "photos", F.coalesce(*(F.nullif(F.col(f"v.src.{n}"), F.lit("")) for n in ("large2x", "large", "original")))
    elif provider == "web":
        kind, root, url = "hits array<struct<largeImageURL: string, webformatURL: string>>", "hits", pick("largeImageURL", "webformatURL")
    else:
        kind, root, url = "results array<struct<url: string>>", "results", pick("url")
    rows = hits.select("term", "term_ord", F.posexplode(F.from_json("body", kind)[root]).alias("hit_ord", "v"))
    if provider == "wiki":
        rows = rows.where(F.col("v.mime").isin("image/jpeg", "image/png"))
    return rows.select(F.lit(provider).alias("provider"), url.alias("url"), F.lit(seconds).alias("duration"), "term", "term_ord", "hit_ord").where("url is not null")


def _ranked(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def normalize_short_clip_hits(hits: DataFrame, max_dur: int = 12, max_clips: int = 5, least: int = 480) -> DataFrame:
    """SRC-9. Short clips with the widest file of at least 480 on both sides, so many per term in reply order."""
    kind = "clips array<struct<duration: double, files: array<struct<width: int, height: int, url: string>>>>"
    v = hits.select("term", F.posexplode(F.from_json("body", kind)["clips"]).alias("hit_ord", "v")).where(F.col("v.duration") <= max_dur)
    best = F.try_element_at(F.reverse(F.array_sort(F.filter("v.files", lambda f: (f["width"] >= least) & (f["height"] >= least)))), F.lit(1))
    rows = v.select("term", "hit_ord", F.col("v.duration").alias("duration"), best["url"].alias("url"), best["width"].alias("width")).where("url is not null")
    return _ranked(rows, ["term"], ["hit_ord"], max_clips)


def best_rendition(formats: str, max_h: int, codecs: tuple[str, ...]) -> Column:
    """Address of the rendition that is taken of an array of (height, codec, url, ext, muxed), null if none will do.

    Tiers in order: without sound and at most ``max_h`` high, of each codec family in turn (by the codec's begin), then of any; with sound
    and at most so high; with sound in this container; with sound. The highest of the first tier that has any is taken,
    of equally high ones the last, as replies go from worse to better. The container of all but the last tier is mp4.
    What a rendition doesn't say of its sound or container is taken to fit.
    """
    silent, sound, mp4 = (lambda f: ~F.coalesce(f["muxed"], F.lit(False))), (lambda f: F.coalesce(f["muxed"], F.lit(True))), (lambda f: F.coalesce(f["ext"] == "mp4", F.lit(True)))
    low = lambda f: F.coalesce(f["height"] <= max_h, F.lit(False))
    tiers = [*((lambda f, c=c: silent(f) & mp4(f) & low(f) & F.coalesce(f["codec"].startswith(c), F.lit(False))) for c in codecs), lambda f: silent(f) & mp4(f) & low(f), lambda f: sound(f) & mp4(f) & low(f), lambda f: sound(f) & mp4(f), sound]

    def rank(f: Column, n: Column) -> Column:
        tier = F.coalesce(*(F.when(fits(f), F.lit(-k)) for k, fits in enumerate(tiers)))
        return F.struct(tier.alias("t"), F.coalesce(f["height"], F.lit(0)).alias("h"), n.alias("n"), f["url"].alias("u"))

    return F.array_max(F.filter(F.transform(F.col(formats), rank), lambda x: x["t"].isNotNull() & x["u"].isNotNull()))["u"]


def normalize_footage_hits(hits: DataFrame, by: str, max_h: int = 1080, per_query: int = 2, max_sources: int = 6, codecs: tuple[str, ...] = ("avc1",), clips_per_video: int = 5, max_clips: int = 24) -> DataFrame:
    """SRC-10. Footage between 12 s and 20 min with its best rendition (``best_rendition``), so many per query and script.

    clips: how many clips a source gives, ``clips_per_video`` until the script has ``max_clips``; sources beyond that are left out.
    """
    kind = "entries array<struct<url: string, duration: double, formats: array<struct<height: int, codec: string, url: string, ext: string, muxed: boolean>>>>"
    v = hits.select(by, "term", "term_ord", F.posexplode(F.from_json("body", kind)["entries"]).alias("hit_ord", "v")).where((F.col("v.duration") > 12) & (F.col("v.duration") < 1200))
    v = v.select(by, "term", "term_ord", "hit_ord", F.col("v.url").alias("source"), F.col("v.duration").alias("duration"), F.col("v.formats").alias("__formats"))
    rows = v.withColumn("url", best_rendition("__formats", max_h, codecs)).drop("__formats").where("url is not null")
    rows = _ranked(_ranked(rows, [by, "term"], ["hit_ord"], per_query), [by], ["term_ord", "hit_ord", "term"], max_sources)
    before = (F.row_number().over(Window.partitionBy(by).orderBy("term_ord", "hit_ord", "term")) - 1) * clips_per_video
    return rows.withColumn("clips", F.least(F.lit(clips_per_video), F.lit(max_clips) - before)).where("clips > 0")


def concat_hits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


