"""Content performance: cleaning, topics, conversion, roles, summaries and top lists per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default topic keywords in order of precedence, and accented spellings that count as the plain one.
TOPIC_KEYWORDS = ("ronaldo", "messi", "haaland", "mbappe", "neymar", "bellingham", "vinicius", "yamal", "barcelona", "real madrid")
TOPIC_ALIASES = {"mbappé": "mbappe", "vinícius": "vinicius"}
#: Inclusive duration ranges in seconds with their labels.
DURATION_BUCKETS = ((0, 15, "10-15s"), (16, 25, "16-25s"), (26, 40, "26-40s"), (41, 10_000, "41s+"))
#: Bits of a sketch of distinct keys: 2**17 registers have a standard error of 0.29 %, so 2 % are seven of them.
ID_BITS = 17


def _whole(column: str) -> Column:
    return F.expr(f"try_cast({column} as bigint)")


def clean_content_rows(raw: DataFrame) -> DataFrame:
    """P-1. Typed rows of (content_id, title, views, subscribers, duration): no totals, no blank or unreadable numbers.

    Blank subscribers and durations count as 0; other text that is no whole number drops the row, as do views up to 0.
    """
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(0).cast("bigint")).otherwise(_whole(c))
    typed = raw.where((F.col("content_id") != "Total") & (F.trim("views") != "")).select(
        *[c for c in raw.columns if c not in ("views", "subscribers", "duration_s")],
        _whole("views").alias("views"), blank("subscribers").alias("subscribers"), blank("duration_s").alias("duration_s"),
    )
    return typed.where("views > 0 and subscribers is not null and duration_s is not null")


def topic_cluster(df: DataFrame, col: str = "title", keywords=TOPIC_KEYWORDS, aliases=TOPIC_ALIASES, out: str = "topic") -> DataFrame:
    """P-2. The first keyword, in list order, that the text holds in lower case; aliases merge into it, else "other"."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    topic = F.lit("other")
    for word in reversed(keywords):
        hits = [low.contains(w) for w in (word, *(a for a, k in aliases.items() if k == word))]
        any_ = hits[0]
        for h in hits[1:]:
            any_ = any_ | h
        topic = F.when(any_, F.lit(word)).otherwise(topic)
    return df.withColumn(out, topic)


def conversion_per_1k(df: DataFrame, out: str = "subs_per_1k") -> DataFrame:
    """P-3. Subscribers won per thousand views."""
    return df.withColumn(out, F.round(F.col("subscribers") * 1000.0 / F.col("views"), 3))


def channel_summary(content: DataFrame, by: str = "channel") -> DataFrame:
    """A-1. Videos, views, subscribers, exact median of views and baseline conversion of each channel."""
    return content.groupBy(by).agg(
        F.count("*").alias("videos"), F.sum("views").alias("views"), F.sum("subscribers").alias("subscribers"), F.median("views").alias("median_views"),
        F.round(F.sum("subscribers") * 1000.0 / F.sum("views"), 3).alias("baseline_per_1k"),
    )


def summary_sketches(content: DataFrame, by: list[str], key: str = "content_id", k: int = 1024) -> DataFrame:
    """A-1 as mergeable sketches: by, videos, views, subscribers, __views (quantiles) and __ids (distinct keys).

    A sketch has a bounded size whatever it has seen, so sketches of days can be stored, and those of a month are merged
    from them (``merged_summary``) without reading the content again.
    """
    views = F.col("views").cast("bigint")
    return content.groupBy(*by).agg(F.count("*").alias("videos"), F.sum("views").alias("views"), F.sum("subscribers").alias("subscribers"), F.kll_sketch_agg_bigint(views, k).alias("__views"), F.hll_sketch_agg(key, ID_BITS).alias("__ids"))


def merged_summary(sketches: DataFrame, by: list[str], k: int = 1024) -> DataFrame:
    """A-1 of the groups ``by`` from sketches of finer ones: sums are exact, median_views and different_videos are estimates.

    The median's rank is off by less than 0.5 % of the rows at k = 1024 (99 % of the time), the number of different videos
    by less than 2 % (seven standard errors, so no group of any size is expected to pass it). Sketches of distinct keys
    merge with those of the same ``ID_BITS`` only.
    """
    rows = sketches.groupBy(*by).agg(F.sum("videos").alias("videos"), F.sum("views").alias("views"), F.sum("subscribers").alias("subscribers"), F.kll_merge_agg_bigint("__views", k).alias("__views"), F.hll_sketch_estimate(F.hll_union_agg("__ids")).alias("different_videos"))
    rows = rows.withColumns({"median_views": F.kll_sketch_get_quantile_bigint("__views", F.lit(0.5)), "baseline_per_1k": F.round(F.col("subscribers") * 1000.0 / F.col("views"), 3)})
    return rows.drop("__views")


def reach_conversion_role(content: DataFrame, by: str = "channel", strong: float = 1.5) -> DataFrame:
    """P-4. Reach and conversion against the channel, and the role by which of the two rounded indices is strong.

    The channel's figures are one row each and are joined back by the channel key.
    """
    base = content.groupBy(by).agg(F.median("views").alias("__median"), (F.sum("subscribers") * 1000.0 / F.sum("views")).alias("__base"))
    return _roles(conversion_per_1k(content).join(base, by), strong).drop("__median", "__base")


def _roles(df: DataFrame, strong: float = 1.5) -> DataFrame:
    """Indices and role of items that carry their channel's median and baseline."""
    reach = F.round(F.col("views") / F.col("__median"), 3)
    conversion = F.when(F.col("__base") == 0, 0.0).otherwise(F.round(F.col("subs_per_1k") / F.col("__base"), 3))
    far, deep = F.col("reach_index") >= strong, F.col("conversion_index") >= strong
    role = F.when(far & deep, "hybrid_winner").when(far, "reach_winner").when(deep, "loyalty_winner").otherwise("baseline")
    return df.withColumns({"reach_index": reach, "conversion_index": conversion}).withColumn("role", role)


def _performance(content: DataFrame, keys: list[str]) -> DataFrame:
    return content.groupBy(*keys).agg(
        F.count("*").alias("videos"), F.sum("views").alias("views"), F.sum("subscribers").alias("subscribers"),
        F.bround(F.sum("views").cast("double") / F.count("*"), 0).cast("bigint").alias("views_per_video"),
        F.round(F.sum("subscribers") * 1000.0 / F.sum("views"), 3).alias("subs_per_1k"),
    )


def cluster_performance(content: DataFrame, by: str = "channel", topic: str = "topic") -> DataFrame:
    """A-2. Figures of each topic of a channel; means round half to even."""
    return _performance(content, [by, topic])


def duration_bucket(df: DataFrame, col: str = "duration_s", buckets=DURATION_BUCKETS, out: str = "duration_bucket") -> DataFrame:
    """J-8. Label of the inclusive range that a duration falls into, null outside all."""
    label = F.lit(None).cast("string")
    for lo, hi, name in reversed(buckets):
        label = F.when(F.col(col).between(lo, hi), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def duration_performance(content: DataFrame, by: str = "channel") -> DataFrame:
    """A-3. Videos, median views and conversion of each duration range that has videos."""
    return duration_bucket(content).where("duration_bucket is not null").groupBy(by, "duration_bucket").agg(
        F.count("*").alias("videos"), F.bround(F.median("views"), 0).cast("bigint").alias("median_views"), F.round(F.sum("subscribers") * 1000.0 / F.sum("views"), 3).alias("subs_per_1k"),
    )


def _top(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order, "content_id"))).where(F.col("rank") <= n)


def top_reach(content: DataFrame, by: str = "channel", n: int = 10) -> DataFrame:
    """T-1. The n most viewed items of each channel; ties by id."""
    return _top(content, by, [F.desc("views")], n)


def top_conversion(content: DataFrame, by: str = "channel", n: int = 10, min_views: int = 500) -> DataFrame:
    """T-2. The n items of best conversion, then views, among those with enough views."""
    return _top(conversion_per_1k(content).where(F.col("views") >= min_views), by, [F.desc("subs_per_1k"), F.desc("views")], n)


def strategy_report(content: DataFrame, by: str = "channel", n: int = 10) -> DataFrame:
    """SNK-1. One nested row per channel: summary, top lists, topics and duration ranges, ready for a JSON sink.

    Summary, topics and ranges are one pass over grouping sets; roles are worked out for the items of the top lists only.
    """
    rows = duration_bucket(topic_cluster(content)).select(by, "topic", "duration_bucket", "views", "subscribers")
    sets = rows.groupingSets([[by], [by, "topic"], [by, "duration_bucket"]], by, "topic", "duration_bucket").agg(
        F.grouping_id().alias("level"), F.count("*").alias("videos"), F.sum("views").alias("views"), F.sum("subscribers").alias("subscribers"), F.median("views").alias("median_views"),
        F.round(F.sum("subscribers") * 1000.0 / F.sum("views"), 3).alias("subs_per_1k"), (F.sum("subscribers") * 1000.0 / F.sum("views")).alias("base"),
    )
    whole, topic, length = F.col("level") == 3, F.col("level") == 1, (F.col("level") == 2) & F.col("duration_bucket").isNotNull()
    listed = lambda when, *cells: F.array_sort(F.collect_list(F.when(when, F.struct(*cells))))
    half = F.bround("median_views", 0).cast("bigint").alias("median_views")
    report = sets.groupBy(by).agg(
        F.max(F.when(whole, F.struct("videos", "views", "subscribers", "median_views", F.col("subs_per_1k").alias("baseline_per_1k"), "base"))).alias("all"),
        listed(topic, "topic", "videos", "views", "subs_per_1k").alias("topics"), listed(length, "duration_bucket", "videos", half, "subs_per_1k").alias("durations"),
    )
    cells = [by, "rank", "content_id", "title", "views", "subs_per_1k"]
    tops = top_reach(conversion_per_1k(content), by, n).select(*cells, F.lit(True).alias("far")).unionByName(top_conversion(content, by, n).select(*cells, F.lit(False).alias("far")))
    tops = _roles(tops.join(report.select(by, F.col("all.median_views").alias("__median"), F.col("all.base").alias("__base")), by))
    item = ("rank", "content_id", "title", "views", "subs_per_1k", "role")
    tops = tops.groupBy(by).agg(listed(F.col("far"), *item).alias("top_reach"), listed(~F.col("far"), *item).alias("top_conversion"))
    report = report.join(tops, by, "left").select(by, "all.*", "top_reach", "top_conversion", "topics", "durations")
    return report.drop("base")
