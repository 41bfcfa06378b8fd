"""Near duplicates by HyperMinHash: sketches, bands, collision-corrected estimates, then verification on whole sets.

A set's shingles are hashed into buckets; a register keeps of a bucket's smallest hash the number of leading zeros and
the ten bits behind them, 16 bits in all. Two registers agree with a chance of the sets' Jaccard similarity, or, rarely, as
different hashes share these bits; the estimate takes that share off.

Small sets would leave most buckets empty, so they are hashed by several functions of fewer buckets each, ``LEVELS``, and a set whose
smaller partners may be on the next level has a sketch of that level too. Six neighbouring registers are a band. Sets with an equal band
meet; of 96 bands two linked sets share none with a chance below 3e-13 at a similarity of 0.8 and less above. Pairs whose
estimate is more than eight standard errors below 0.8 are dropped, all others are verified on whole sets.

Large groups aren't expanded into pairs: see ``jaccard.derived_links``, which compares with leaders first. The sets that
lead are those that agree with most others, so a group of copies with edits is compared with its centre; what that leaves
open around one centre is compared part by part (``jaccard.links_around``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, counted, mix, near, only, small_batches, tally, tidy, utf8
from .jaccard import PAIRS_AT_ONCE, PERCENT, answers, both_sides, derived_links, equal_sets, links_around, names_of, shingle_sets, verified

WORDS = 2
REGISTERS, BAND, MANTISSA = 576, 6, 10
#: Levels: (functions, least shingles of a set). With so many shingles a bucket gets four at least, or is a function of its own.
LEVELS = ((1, 2304), (2, 1152), (4, 576), (8, 288), (16, 144), (32, 72), (64, 36), (192, 12), (576, 1))
#: Standard errors of an estimate at the threshold, below which a pair is dropped.
ERRORS = 8
#: Least estimate of a pair with a leader that is verified: of nearer ones the exact distance is used to rule other pairs out.
TELLING = 0.3
#: Shingles and functions that are hashed at once, about.
AT_ONCE = 1 << 18
_U = np.uint64


def level_of(n: int) -> int:
    return next(i for i, (_, least) in enumerate(LEVELS) if n >= least)


def levels_of(n: int) -> list[int]:
    """A set's own level, and the next one if a linked set may be so small that it belongs there."""
    own = level_of(n)
    return [own, own + 1] if own + 1 < len(LEVELS) and PERCENT * n < 100 * LEVELS[own][1] else [own]


def sketch(own: np.ndarray, level: int) -> np.ndarray:
    """The registers of a set of shingle hashes: 0 for an empty bucket, else (leading zeros + 1) << 10 | mantissa."""
    functions = LEVELS[level][0]
    size = REGISTERS // functions
    least = np.full(REGISTERS, 1 << 32, np.int64)
    salts = mix(np.arange(1, functions + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(level))
    step = max(1, AT_ONCE // functions)
    for a in range(0, len(own), step):
        h = mix(own[None, a : a + step] ^ salts[:, None])
        low = (h & _U(0xFFFFFFFF)).astype(np.int64)
        if size == 1:
            np.minimum(least, low.min(axis=1), out=least)
        else:
            bucket = ((h >> _U(32)) * _U(size) >> _U(32)).astype(np.int64) + np.arange(functions)[:, None] * size
            np.minimum.at(least, bucket.ravel(), low.ravel())
    fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    registers = ((33 - exponent) << MANTISSA) | ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(least >> 32, 0, registers).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """How likely registers of two sets without a common shingle agree: the sum over all register values of both chances."""
    x, y = (np.maximum(1, v).astype(np.float64) * functions / REGISTERS for v in (n, m))
    both, total = x + y, np.zeros(len(x))
    for zeros in range(33):
        high = 0.5**zeros
        total += high / 2 / (1 << MANTISSA) * (x * y / both) * (np.exp(-both * high / 2) - np.exp(-both * high))
    return total


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """Jaccard similarity by rows of registers, without the agreement that is by chance."""
    seen = np.maximum(1, ((left != 0) | (right != 0)).sum(axis=1))
    same = ((left == right) & (left != 0)).sum(axis=1) / seen
    by_chance = chance(n, m, functions)
    return (same - by_chance) / (1 - by_chance)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


@tidy
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links), class_id (the smallest key of an equal set) and kept of every row.

    Documents link when 100 * intersection >= 80 * union of their sets of distinct k-word shingles (with fewer words, the
    whole sequence is the one shingle). A null or empty text, or one without words, has the empty set and is linked with
    nothing. Texts are read whole. Rows that repeat a key are one node of the link graph and share their verdict; a null key
    is never the smallest unless it is alone. ``kept``: the key is its component's. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = small_batches(docs).select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    longs = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *longs("h", "cid", "other", "n", "first")])
    sketch_schema = T.StructType([*longs("first", "other", "n", "level"), T.StructField("sketch", T.BinaryType())])

    def each(batch: pa.RecordBatch, column: str):
        data, offs = utf8(batch.column(column))
        for a, z in blocks(offs):
            yield from shingle_sets(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], k)

    def described(batches):
        for batch in batches:
            found = np.array([(*names_of(own), len(own)) for own in each(batch, "text")], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T), pa.array(found[:, 0])], names=schema.names)

    members, classes = equal_sets(tally(rows.mapInArrow(described, schema)), [])

    def sketched(batches):
        for batch in batches:
            cells, made = [], []
            for own in each(batch, "text"):
                for level in levels_of(len(own)) if len(own) else ():
                    cells.append((*names_of(own), len(own), level))
                    made.append(sketch(own, level).tobytes())
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.array(cells, np.int64).reshape(-1, 4).T), pa.array(made, pa.binary())], names=sketch_schema.names)

    # a row of each class is sketched; rows that the bitmap lets through besides give the same sketches again
    one = classes.select(F.col("least.id").alias("id"), F.col("least.h").alias("h"))
    sketches = only(rows, one, ["id", "h"]).select("text").mapInArrow(sketched, sketch_schema)
    renamed = tally(members.where("cid <> first").select("first", "other", "n", "cid").distinct())
    if counted(renamed):
        sketches = sketches.join(renamed, ["first", "other", "n"], "left").withColumn("cid", F.coalesce("cid", "first"))
    else:
        sketches = sketches.withColumn("cid", F.col("first"))
    sketches = tally(sketches.select("cid", "n", "level", "sketch"))

    def band(i):
        own = F.substring("sketch", 2 * BAND * i + 1, 2 * BAND)
        return F.when(own != F.lit(bytes(2 * BAND)), F.xxhash64(own, F.col("level"), F.lit(i)))

    bands = sketches.select("cid", "n", F.explode(F.array(*map(band, range(REGISTERS // BAND)))).alias("token")).where("token is not null")
    shared = tally(bands.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("top"), F.count("*").alias("rows")).where("low < top").select("token", "rows"))
    lists = tally(only(bands, shared, ["token"]).distinct().join(near(shared), "token").select("token", "cid", "n", "rows"))
    # a set that agrees with many others in many bands is central: it leads
    ranks = tally(lists.groupBy("cid").agg((-F.sum("rows")).alias("rank")))
    lists = tally(lists.join(near(ranks), "cid").select("token", "cid", "n", F.lit(0).alias("pos"), "rank"))
    least_estimate = PERCENT / 100 - ERRORS * (PERCENT * (100 - PERCENT) / 1e4 / REGISTERS) ** 0.5

    def estimated(batches):
        for batch in batches:
            sides = {s: batch.column(f"own_{s}") for s in "ab"}
            level, n, m = sides["a"].field("level").to_numpy(), *(sides[s].field("n").to_numpy() for s in "ab")
            found = estimate(*(_registers(sides[s].field("sketch")) for s in "ab"), n, m, np.array([f for f, _ in LEVELS])[level])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "estimate"])

    def verify(pairs: DataFrame, least: float = least_estimate) -> DataFrame:
        named = tally(pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).alias("parts")))
        own = only(sketches, named, ["cid"]).join(near(named), "cid").groupBy("cid", "level", "parts").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        held = own.select("cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.struct("level", "n", "sketch").alias("own"))
        met = both_sides(pairs, held, named, ["own"]).where("own_a.level = own_b.level").select("a", "b", "own_a", "own_b")
        best = tally(met.mapInArrow(estimated, "a long, b long, estimate double").groupBy("a", "b").agg(F.max("estimate").alias("estimate")))
        far = best.where(F.col("estimate") < least).select("a", "b", F.lit(None).cast("double").alias("dist"), F.lit(False).alias("linked"))
        return verified(best.where(F.col("estimate") >= least).select("a", "b"), classes, rows, k).unionByName(far)

    links = derived_links(lists, verify, lambda pairs: verify(pairs, TELLING), lambda homes: links_around(homes, classes, rows, k))
    return answers(key, members, classes, *links).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
