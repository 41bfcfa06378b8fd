"""Quality rules: word and line counts, and a linear-chain CRF that marks each line as content or boilerplate.

The CRF is trained on the line sequences of a bounded sample of labelled documents (a line's training label is its
document's), its Viterbi labels decide: a document is kept if enough of its words stand in content lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import WHITE, blocks, mix, prefix_hash, runs, shingles, small_batches, span_hash, utf8

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?:;\"')")] = True
#: Names of the line features; each is one bit.
FEATURES = (
    "bias", "few symbols", "symbols", "many symbols", "capitals", "up to 3 words", "4 to 9 words", "10 words or more",
    "ends a sentence", "repeats an earlier line", "repeats its words", "long words", "digits", "first", "last",
)
CONTENT, BOILERPLATE = 0, 1


def _span_sums(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[e] - total[s]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier one; which equal any other one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    same[:-1] |= same[1:]
    any_[order] = same
    return later, any_


def describe(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every row; features, words and row of every line that has a word."""
    n = len(offs) - 1
    salt = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s, e, row = runs(~WHITE[data], offs)
    total, down = prefix_hash(data)
    hashes = span_hash(total, down, s, e)
    points = (data & 0xC0) != 0x80
    grams, gram_row, at = shingles(hashes, row, 3)
    _, twice = _again(mix(grams ^ salt[gram_row]))
    repeated = np.zeros(len(s), bool)
    for k in range(3):
        repeated[at[twice] + k] = True

    ls, le, line_row = runs(data != 10, offs)
    first_word = np.searchsorted(s, ls)
    words = np.searchsorted(s, le) - first_word
    full = np.flatnonzero(words > 0)
    ls, le, line_row, words, first_word = ls[full], le[full], line_row[full], words[full], first_word[full]
    line_again, _ = _again(mix(span_hash(total, down, ls, le) ^ salt[line_row]))
    chars = np.maximum(1, _span_sums(points, ls, le))
    symbols = _span_sums(SYMBOL[data], ls, le) / chars
    word_order = np.repeat(np.arange(len(full)), words)
    word_at = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words) + np.repeat(first_word, words)
    again_in_line, _ = _again(mix(hashes[word_at] ^ (word_order.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
    repeats = np.bincount(word_order[again_in_line], minlength=len(full)) / np.maximum(1, words)
    last_end = e[first_word + words - 1] if len(full) else np.zeros(0, np.int64)
    bits = np.zeros((len(full), len(FEATURES)), bool)
    bits[:, 0] = True
    bits[:, 1], bits[:, 2], bits[:, 3] = (symbols > 0) & (symbols <= 0.03), (symbols > 0.03) & (symbols <= 0.15), symbols > 0.15
    bits[:, 4] = _span_sums(UPPER[data], ls, le) > 0.3 * chars
    bits[:, 5], bits[:, 6], bits[:, 7] = words <= 3, (words > 3) & (words < 10), words >= 10
    bits[:, 8] = STOP[data[last_end - 1]] if len(full) else False
    bits[:, 9] = line_again
    bits[:, 10] = repeats > 0.7
    bits[:, 11] = chars > 11 * words
    bits[:, 12] = _span_sums(DIGIT[data], ls, le) > 0.2 * chars
    bits[1:, 13] = line_row[1:] != line_row[:-1]
    bits[:1, 13] = True
    bits[:-1, 14] = line_row[1:] != line_row[:-1]
    bits[-1:, 14] = True
    word_chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(points, out=word_chars[1:])
    count = lambda rows, w=None: np.bincount(rows, weights=w, minlength=n).astype(np.int64)
    return {
        "n_words": count(row), "word_chars": count(row, word_chars[e] - word_chars[s]),
        "n_symbols": _span_sums(SYMBOL[data], offs[:-1], offs[1:]), "n_dup_lines": count(line_row[line_again]),
        "n_repeat_words": count(row[repeated]), "bits": bits, "line_words": words, "line_row": line_row,
    }


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", fit_docs: int = 4000, fit_lines: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """CRF weights from a sample of at most about ``fit_docs`` labelled documents of at most ``fit_lines`` lines."""
    known = labels.where(F.col(quality).isNotNull()).select(F.col(key).alias("k"), F.col(quality).cast("int").alias("q")).dropDuplicates(["k"])
    n = known.count()
    if n > fit_docs:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))
    rows = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(known), "k").select("text", "q")  # as many rows as the sample

    def lines(batches):
        for b in batches:
            data, offs = utf8(b.column(0))
            for a, z in blocks(offs):
                d = describe(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
                each = np.bincount(d["line_row"], minlength=z - a)
                packed = (d["bits"] @ (1 << np.arange(len(FEATURES)))).tolist()
                cut = np.cumsum(each) - each
                ok = [i for i in range(z - a) if 0 < each[i] <= fit_lines]
                yield pa.RecordBatch.from_arrays([pa.array([packed[cut[i] : cut[i] + each[i]] for i in ok], pa.list_(pa.int32())), b.column(1).take(pa.array([a + i for i in ok], pa.int64()))], names=["bits", "q"])

    got = rows.mapInArrow(lines, "bits array<int>, q int").collect()
    lengths = np.array([len(r["bits"]) for r in got], np.int64)
    packed = np.array([x for r in got for x in r["bits"]], np.int64)
    features = ((packed[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
    label = np.repeat(np.array([CONTENT if r["q"] else BOILERPLATE for r in got], np.int64), lengths)
    return crf.fit(features, label, lengths)


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", least_words: int = 50, least_content: float = 0.5) -> DataFrame:
    """``docs`` with the counts, base_failed, content_share and kept. A column of an output's name is replaced.

    A null or empty text has no words, so it fails the base rule; its content share is 0. Ties between labellings go to
    content. Texts are read whole, repeated rows are judged alike, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kinds = [*((x, pa.int64()) for x in names), ("content_share", pa.float64())]

    @F.arrow_udf("struct<" + ", ".join(f"{x}: bigint" for x in names) + ", content_share: double>")
    def measure(column: pa.Array) -> pa.Array:
        weights, move = shared.value
        data, offs = utf8(column)
        found = [(a, z, describe(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])) for a, z in blocks(offs)]
        counts = [np.concatenate([d[x] for _, _, d in found]) if found else np.zeros(0, np.int64) for x in names]
        share = np.zeros(len(column))
        if found:
            row = np.concatenate([a + d["line_row"] for a, _, d in found])
            words = np.concatenate([d["line_words"] for _, _, d in found])
            emit = np.concatenate([d["bits"] for _, _, d in found]) @ weights
            label = crf.viterbi(emit, move, crf.Chains(np.bincount(row, minlength=len(column))))
            good = np.bincount(row, weights=words * (label == CONTENT), minlength=len(column))
            share = good / np.maximum(1, np.bincount(row, weights=words, minlength=len(column)))
        return pa.StructArray.from_arrays([*(pa.array(x) for x in counts), pa.array(share)], fields=[pa.field(n, t) for n, t in kinds])

    got = small_batches(docs).withColumn("__q", measure(F.col(text))).withColumns({n: F.col(f"__q.{n}") for n, _ in kinds}).drop("__q")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= least_content))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
