"""Batch requests: overlay of defaults, preflight rules, identity, routing and order modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a second at rate 1, and the slowest rate that an estimate uses.
WORDS_PER_SECOND, SLOWEST_RATE = 2.65, 0.5
WORD = r"(?U)([\w’'-]+)"
#: Absolute claims that need a source, calls to action without a promise, and the one that replaces them.
RISKY_CLAIMS = r"(?i)\b(ended (?:his|her|their) career|never|always|first ever|on purpose)\b"
GENERIC_CTAS = ("follow for more", "follow for more ⚡", "subscribe for more")
REPLACED_CTA_START, CHANNEL_CTA = "FOLLOW FOR MORE", "FOLLOW FOR UNTOLD FOOTBALL STORIES ⚡"


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1)))


def overlay_defaults(requests_raw: DataFrame, fields: list[str]) -> DataFrame:
    """P-5. A request's own field, present even as null, wins over its file's default; then the fields become columns.

    ``defaults`` and ``entry`` are JSON objects; presence is a key's being in the object.
    """
    parse = lambda c: F.coalesce(F.from_json(F.col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    own, file = parse("entry"), parse("defaults")
    merged = [F.when(F.array_contains(F.map_keys(own), f), F.element_at(own, f)).otherwise(F.element_at(file, f)).alias(f) for f in fields]
    return requests_raw.select(*[c for c in requests_raw.columns if c not in ("defaults", "entry")], *merged)


def narration_estimate(df: DataFrame, text: str = "script", rate: str = "voice_rate") -> DataFrame:
    """P-7. Words, and seconds of speech at the request's rate."""
    return df.withColumns({"words": word_count(text), "estimated_s": F.round(_seconds(word_count(text), rate), 3)})


def _seconds(words: Column, rate: str) -> Column:
    """Seconds of speech; no rate, or a rate of 0, is 1."""
    return words / (WORDS_PER_SECOND * F.greatest(F.lit(SLOWEST_RATE), F.coalesce(F.nullif(F.col(rate).cast("double"), F.lit(0.0)), F.lit(1.0))))


def preflight_report(requests: DataFrame, max_words: int = 90, max_seconds: float = 0.0) -> DataFrame:
    """P-6. Errors, warnings and ok of every request, all rules at once; a ceiling of 0 seconds is none.

    A comparison needs its clips only; the rules of a narrated request, its warnings and its claims don't apply to it.
    Optional columns: ``enable_hook_card`` and ``enable_cta`` (null: on) switch the rules of the hook and of the call to
    action, ``hook_image_path`` stands in for a cover term, ``max_words`` and ``max_seconds`` (null or 0: the arguments)
    are a request's own limits.
    """
    rows = narration_estimate(requests)
    given = lambda c, kind: F.col(c).cast(kind) if c in requests.columns else F.lit(None).cast(kind)
    blank = lambda c: F.trim(F.coalesce(given(c, "string"), F.lit(""))) == ""
    none_of = lambda c: F.size(F.coalesce(given(c, "array<string>"), F.array().cast("array<string>"))) == 0
    limit = lambda c, kind, most: F.coalesce(F.nullif(given(c, kind), F.lit(0).cast(kind)), F.lit(most).cast(kind))
    listed = lambda *rules: F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules)), lambda x: x.isNotNull())
    told = ~F.coalesce(F.col("comparison_mode"), F.lit(False))
    hook, cta = (told & F.coalesce(given(c, "boolean"), F.lit(True)) for c in ("enable_hook_card", "enable_cta"))
    local = F.coalesce(F.col("source"), F.lit("")) == "local"
    seconds, ceiling = _seconds(F.col("words"), "voice_rate"), limit("max_seconds", "double", max_seconds)
    errors = listed(
        (F.coalesce(F.nullif(F.col("video_count"), F.lit(0)), F.lit(1)) != 1, "video_count=1 is required"), (F.coalesce(F.col("aspect"), F.lit("9:16")) != "9:16", "aspect must be 9:16"),
        (~told & (F.coalesce(F.col("comparison_clips"), F.lit(0)) < 2), "comparison needs two clips"),
        (told & blank("subject"), "video_subject must be supplied"), (told & blank("script"), "video_script must be supplied"),
        (told & ~local & none_of("terms"), "video_terms must be supplied"), (told & blank("voice_name"), "voice_name must be supplied"),
        (told & ~blank("script") & (F.col("words") < 12), "script is too short"), (told & (F.col("words") > limit("max_words", "int", max_words)), "script is too long"),
        (told & (ceiling > 0) & (seconds > ceiling), "narration is too long"),
        (hook & blank("hook_text"), "hook_text must be supplied"), (hook & (word_count("hook_text") > 9), "hook is too long"),
        (hook & blank("hook_cover") & blank("hook_image_path"), "hook_cover_term or hook_image_path must be supplied"),
    )
    warnings = listed(
        (told & (seconds > 45), "narration is over 45 seconds"),
        (hook & F.coalesce(F.col("hook_require_video"), F.lit(False)) & none_of("negative_terms"), "no contrasting negatives"),
        (cta & F.lower(F.trim(F.coalesce(F.col("cta_text"), F.lit("")))).isin(*GENERIC_CTAS), "generic call to action"),
        (told & F.coalesce(F.col("script").rlike(RISKY_CLAIMS), F.lit(False)), "absolute claim"),
    )
    return rows.withColumns({"errors": errors, "warnings": warnings}).withColumn("ok", F.size("errors") == 0)


def risky_claims(df: DataFrame, text: str = "script", pattern: str = RISKY_CLAIMS) -> DataFrame:
    """P-8. Distinct lower-cased matches of a claim pattern, sorted."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)), F.lower)
    return df.withColumn("claims", F.array_sort(F.array_distinct(found)))


def apply_growth_profile(requests: DataFrame) -> DataFrame:
    """P-9. Turn the follow tag off and put a promise in place of a generic call to action; list what changed."""
    tag = F.coalesce(F.col("loop_follow_tag"), F.lit(False))
    generic = F.upper(F.trim(F.coalesce(F.col("cta_text"), F.lit("")))).startswith(REPLACED_CTA_START)
    changes = F.filter(F.array(F.when(tag, F.lit("follow tag removed")), F.when(generic, F.lit("generic call to action replaced"))), lambda x: x.isNotNull())
    return requests.withColumns({"changes": changes, "cta_text": F.when(generic, F.lit(CHANNEL_CTA)).otherwise(F.col("cta_text")), "loop_follow_tag": F.lit(False)})


def request_fingerprint(requests: DataFrame, fields: list[str], task: str = "task_id") -> DataFrame:
    """P-10. SHA-256 of the request's fields as JSON with sorted names (stable within this library), and the task's edit seed."""
    body = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    rows = requests.withColumn("fingerprint", F.sha2(body, 256))
    return rows.withColumn("edit_seed", F.substring(F.sha2(F.concat_ws(":", "fingerprint", F.col(task).cast("string")), 256), 1, 16))


def narration_fit_plan(df: DataFrame, ceiling: float) -> DataFrame:
    """P-16. Whether audio over the ceiling is blocked, the tempo that would fit it, and whether that tempo is safe."""
    tempo = F.col("audio_s") / max(0.5, ceiling - 0.08)
    over = F.col("audio_s") > ceiling
    return df.withColumns({"blocked": over, "tempo": F.when(over, F.round(tempo, 6)), "safe": F.when(over, tempo.between(0.5, 2.0)).otherwise(True)})


def voice_route(df: DataFrame, voice: str = "voice_name", rate: str = "voice_rate") -> DataFrame:
    """P-18. Provider, model, voice, gender and locale of a voice name, its V2 route, and the rate as signed percent."""
    name, v = F.trim(F.coalesce(F.col(voice), F.lit(""))), F.coalesce(F.col(rate).cast("double"), F.lit(1.0))
    prefix = F.regexp_extract(name, r"^([a-z]+):", 1)
    provider = F.when(prefix != "", prefix).when(name.contains("-V2"), "azure-v2").otherwise("azure-v1")
    rest = F.regexp_replace(name, r"^[a-z]+:", "")
    model = F.when(prefix != "", F.nullif(F.regexp_extract(rest, r"^([^:]+):", 1), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(rest, r"^[^:]+:", ""), r"-(Female|Male)$", "")
    percent = F.rint((v - 1) * 100).cast("int")
    return df.withColumns({
        "provider": provider, "model": model, "gender": F.nullif(F.regexp_extract(name, r"-(Female|Male)$", 1), F.lit("")), "voice": F.regexp_replace(bare, "-V2$", ""),
        "locale": F.nullif(F.regexp_extract(bare, r"^([a-z]{2,3}-[A-Z]{2})", 1), F.lit("")), "rate_text": F.concat(F.when(percent >= 0, "+").otherwise(""), percent.cast("string"), F.lit("%")),
    })


def effective_order_mode(requests: DataFrame) -> DataFrame:
    """P-21. Search images force sequential order; semantic order of several outputs falls back to random."""
    mode = F.when(F.col("source") == "search_images", "sequential").when((F.col("video_count") > 1) & (F.col("order_mode") == "semantic"), "random").otherwise(F.col("order_mode"))
    return requests.withColumn("effective_order", mode)


def batch_status_summary(reports: DataFrame, by: str = "batch") -> DataFrame:
    """A-4. Counts by status of each batch; one failed preflight blocks the batch."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return reports.groupBy(by).agg(F.count("*").alias("requests"), n("complete"), n("failed"), n("pending"), F.bool_or(~F.col("ok")).alias("blocked"))
