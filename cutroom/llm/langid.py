"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fit: n-gram counts per language are gathered on the executors from a bounded sample of the labelled rows.
Score: the log-probability matrix (buckets x languages, a fixed size) is broadcast; a batch of texts is a sparse
document-by-bucket matrix, multiplied with it by gathering matrix rows and summing them per document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, id_crc, release, small_batches

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def _letters_only(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts; each run of other characters is one space. Row offsets, n + 1."""
    low = [" " + t.lower() + " " if t else "" for t in texts]
    offs = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=offs[1:])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _alphabetic()
    letter = known[np.minimum(points, 0xFFFF)] & (points < 0x10000)
    for i in np.flatnonzero(points >= 0x10000):
        letter[i] = chr(points[i]).isalpha()
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    keep[offs[:-1][offs[:-1] < offs[1:]]] = True  # the space before the first word
    points = np.where(letter, points, 32)[keep]
    upto = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    return points.astype(np.uint64), upto[offs]


def _grams(points: np.ndarray, offs: np.ndarray, orders: tuple[int, ...], bits: int):
    """For each order: bucket and row of every n-gram that has a letter."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for n in orders:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = row[:m] == row[n - 1 :]
        if n == 1:
            ok &= points[:m] != 32
        yield (h[ok] >> np.uint64(64 - 32)).astype(np.int64) & ((1 << bits) - 1), row[:m][ok]


def _pieces(texts: list, most: int = BLOCK_BYTES):
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", fit_docs: int = 6000, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smooth: float = 0.5) -> tuple[list[str], np.ndarray, tuple[int, ...], int]:
    """Model: languages, log-probability matrix (2**bits x languages), orders, bits.

    ``fit_docs`` is the documented bound of the sample: rows with a label and a text are drawn by a hash of their key
    so that about that many are expected, however many there are. No labelled row gives a model without languages.
    """
    rows = small_batches(labelled).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = labelled.where(F.col(lang).isNotNull()).count()
    if n > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in _pieces(texts):
                points, offs = _letters_only(texts[a:z])
                for bucket, row in _grams(points, offs, orders, bits):
                    for name in set(langs[a:z]):
                        mine = np.fromiter((x == name for x in langs[a:z]), bool, z - a)[row]
                        sums[name] = sums.get(name, 0) + np.bincount(bucket[mine], minlength=1 << bits)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.astype(np.int64).tobytes() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    total: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "text").repartition(6).mapInArrow(count, "lang string, counts binary").collect():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    langs = sorted(total)
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32), orders, bits
    counts = np.stack([total[x] for x in langs], 1) + smooth
    return langs, np.log(counts / counts.sum(0)).astype(np.float32), orders, bits


def identify(docs: DataFrame, model: tuple, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability (0 to 1).

    A null text, one without letters and a model without languages give ``und`` and 0. Of equally likely languages the
    first by name wins. Texts are read whole. A column that has an output's name is replaced; repeated rows stay.
    """
    langs, logp, orders, bits = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(column: pa.Array) -> pa.Array:
        release()
        names, matrix = shared.value
        best, prob = np.full(len(column), -1), np.zeros(len(column))
        texts = column.to_pylist()
        for a, z in _pieces(texts if names else []):
            points, offs = _letters_only(texts[a:z])
            sums, some = np.zeros((z - a, len(names))), np.zeros(z - a, bool)
            for bucket, row in _grams(points, offs, orders, bits):
                if len(row):
                    at = np.flatnonzero(np.diff(row, prepend=-1))
                    sums[row[at]] += np.add.reduceat(matrix[bucket], at, axis=0)
            spaces = np.zeros(len(points) + 1, np.int64)
            np.cumsum(points != 32, out=spaces[1:])
            some = spaces[offs[1:]] > spaces[offs[:-1]]
            top = sums.argmax(1)
            rest = np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            best[a:z], prob[a:z] = np.where(some, top, -1), np.where(some, 1 / rest, 0)
        lang = pa.array([names[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
        return pa.StructArray.from_arrays([lang, pa.array(prob)], fields=list(kind))

    got = small_batches(docs).withColumn("__lang", predict(F.col(text)))
    return got.withColumns({lang_out: F.col("__lang.lang"), score_out: F.col("__lang.score")}).drop("__lang")


def held_out(key: str = "doc_id"):
    return F.coalesce(id_crc(key) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
