"""Results of costly per-item work (embeddings, media probes) that are kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutroom.sources.folders import path_exists

#: Files of a cache table that its rows are dealt over by key; a run writes the buckets that it adds to.
BUCKETS = 16


def known(df: DataFrame, key: list[str], path: str, kind: T.DataType) -> DataFrame:
    """The cache table below ``path`` (key columns, result, bucket), empty if it isn't there yet."""
    spark = df.sparkSession
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("result", kind), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def cached(df: DataFrame, key: list[str], item: str, compute: Callable[[Column], Column], path: str, out: str = "result", buckets: int = BUCKETS) -> DataFrame:
    """M-1 with a memory: ``df`` with the result of ``compute`` over its item, once for each different key.

    ``key`` names what a result depends on, such as a file's path, time and size: results are kept below ``path`` by it, only
    keys that aren't there are computed, and a file that has changed has another key. A key with a null is computed anew
    each time. Of rows of one key the least item counts. What is computed is appended before the result is read, so a run
    that fails leaves whole files or none, and two runs at once may both write a key: the least result counts.
    """
    whole = " and ".join(f"`{k}` is not null" for k in key)
    given = df.where(whole).groupBy(*key).agg(F.min(item).alias("__item"))
    rows = given.withColumn("result", compute(F.col("__item")))
    kind = rows.schema["result"].dataType
    table = known(df, key, path, kind)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = given.join(table.select(*key), key, "left_anti").withColumn("result", compute(F.col("__item"))).withColumn("bucket", bucket)
    fresh.select(*key, "result", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    results = known(df, key, path, kind).groupBy(*key).agg(F.min("result").alias(out)) if _ordered(kind) else known(df, key, path, kind).dropDuplicates(key).select(*key, F.col("result").alias(out))
    found = df.where(whole).join(results, key, "left").select(*df.columns, out)
    return found.unionByName(df.where(f"not ({whole})").withColumn(out, compute(F.col(item))))


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def media_probe(files: DataFrame, prober: Callable[[Column], Column], path: str, out: str = "probe") -> DataFrame:
    """The plug-point of media probes: files (path, modified, file_size, ...) with what ``prober`` says of a path, once for each state of a file."""
    return cached(files, ["path", "modified", "file_size"], "path", prober, path, out)


def embed_cached(df: DataFrame, key: list[str], item: str, embedder: Callable[[Column], Column], path: str, out: str = "embedding") -> DataFrame:
    """The plug-point of embedders: vectors of items, kept by (key, time, size) or whatever the vectors depend on."""
    return cached(df, key, item, embedder, path, out)
