"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutroom.llm import decontaminate, jaccard, langid, packing, suffixes
from cutroom.llm.common import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.5
#: Bytes of a passage that goes if it repeats: over 50 words of running text, of five bytes with their space.
PASSAGE_BYTES = suffixes.PASSAGE
NO_ID = -(1 << 63)


def _name(doc_id: str) -> Column:
    """A plain key of a row's id, so that a join by it shuffles the texts once; a null id is the smallest number, which a text's hash beside it tells from that."""
    return F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("__id")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose most likely language is likelier than not; a null, empty or letterless text has none and goes.

    Rows are judged by their texts alone: those that share an id, have none or repeat each other stay as often as they come.
    """
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out())), lang_out="lang_pred", score_out="lang_score")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id, a null id last; rows with equal id and text are one."""
    alone = F.col("component").isNull()
    rows = jaccard.link_rows(docs).groupBy("component", F.when(alone, F.col("doc_id")).alias("__i"), F.when(alone, F.col("text_hash")).alias("__h"))
    stay = rows.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("l"))
    stay = stay.select(_name("l.doc_id"), F.col("l.text_hash").alias("__text"))
    kept = docs.select("*", _name("doc_id"), F.xxhash64("text").alias("__text")).join(stay, ["__id", "__text"], "left_semi")
    first = Window.partitionBy("__id", "__text").orderBy(F.xxhash64(*COLUMNS))
    return kept.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat; a character that is cut goes whole, a text without a word left goes."""
    done = suffixes.remove_repeats(docs, length=PASSAGE_BYTES, whole_characters=True)
    done = done.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text")))
    done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item. Rows that share an id, or have none, are judged one by one; a null text stays.

    Equal rows share their fate and stay as often as they come. Without items all rows stay.
    """
    leaks = decontaminate.leaking_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(_name("doc_id"), F.col("text_hash").alias("__text"))
    return docs.select("*", _name("doc_id"), F.xxhash64("text").alias("__text")).join(leaks, ["__id", "__text"], "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null text is empty and has one token. Rows that repeat an id are documents of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each one's result in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are a trained model, graph components and a greedy packing: not one SQL query. Tests compare with brute force.
ORACLE_SQL = None
