"""Sharding by jump consistent hashing, in SQL functions only.

The jump generator needs one uniform draw per jump. A draw is 31 bits of md5(key:shard), so the sequence depends on the
key alone, not on the number of shards: with one more shard a row either keeps its shard or goes into the new one.
There is no ring table, and the texts never leave the scan: only their size and checksum are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shards up to which each is tried as a landing place; beyond, so many jumps are made, where about ln(shards) are needed.
MOST_JUMPS = 512


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a string key. A null key counts as the empty string."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def jump(state: Column, _: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), state["next"].cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        draw = F.shiftright(draw, 1) + 1
        landed = F.floor((state["next"] + 1) * (F.lit(2147483648.0) / draw)).cast("long")
        go = state["next"] < shards
        return F.struct(F.when(go, state["next"]).otherwise(state["at"]).alias("at"), F.when(go, landed).otherwise(state["next"]).alias("next"))

    steps = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(steps, start, jump, lambda s: s["at"].cast("int"))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Gapless numbers from 0 within each group, without a task that holds a whole group.

    Rows are numbered by 32 bits of an md5 of the order columns, then by these columns. Each group is cut into ``salts``
    ranges of those bits; ranges are numbered alone, then shifted by the sizes of the ranges before them, so the numbers
    are the same at any number of partitions. The table of sizes has groups x salts rows, so the groups must be few.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat(*(x for c in order for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"))))
    df = df.withColumn("__bits", F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"))
    df = df.withColumn("__part", F.shiftright(F.col("__bits") * salts, 32).cast("int"))
    own = Window.partitionBy(*group, "__part").orderBy("__bits", *order)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = df.withColumn("__rn", F.row_number().over(own).cast("long") - 1)
    return numbered.join(sizes, [*group, "__part"]).withColumn(out, F.col("__rn") + F.col("__before")).drop("__rn", "__before", "__part", "__bits")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless in the shard) and grown_shard (one more shard).

    A null text has size 1 and the checksum of no bytes; a null key is placed as the empty string. Repeated rows get
    the same shard and slots of their own. Beyond ``MOST_JUMPS`` shards a walk of more jumps than that would end early;
    the chance is below 1e-300 a row, as about ln(shards) are needed. Other columns are not read. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"), jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return ranked(rows, ["shard"], [key, "text_crc32", "size"], "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
