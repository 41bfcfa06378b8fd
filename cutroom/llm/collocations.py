"""Phrases whose words stand together more often than chance, from sorted streams of phrase counts.

Counting goes level by level: a phrase of k words can only be frequent if both phrases of k - 1 words in it are. A level's
occurrences are counted by a 64-bit name, first within a block of text, then before and behind Spark's shuffle; the names of the
frequent ones go into a bitmap of fixed size that prunes the next level. Names only prune: a last pass counts the phrases that are left
as texts, so every count is exact.

The table of counts is then read as two streams. In prefix order, a phrase comes behind its own beginnings, so the
counts of the first words of each cut are the last ones seen, and its extensions to the right follow it. In suffix order,
phrases read backwards, the same holds for the rest of each cut and for extensions to the left. Both streams are
windows over sorted partitions, and they meet phrase by phrase in a merge join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, fold_case, mix, prefix_hash, runs, settle, small_batches, span_hash, utf8

LONGEST, LEAST, TOP = 5, 100, 2000
#: Languages whose totals are broadcast at most; with more, they are joined.
FEW = 1 << 16
UNKNOWN = "und"
#: Bits of the bitmap of frequent phrases of a level: 2**26, so 8 MB on the driver and in a worker at most.
FILTER_BITS = 26
#: Bytes that end a piece, and those between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(10, 14)]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
_U = np.uint64


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and pieces of all words; a piece's number differs from that of the piece before it, a row's from the next one's."""
    stop = BREAK[data]
    s, e, row = runs(~(stop | BLANK[data]), offs)
    piece = np.cumsum(stop)[s] + row if len(s) else row
    return s, e, row, piece


def _hashed(data: np.ndarray, offs: np.ndarray, languages: np.ndarray):
    """Words of lower-cased texts with their hashes, into which the row's language goes, and a hash of each language."""
    low = fold_case(data)
    s, e, row, piece = words_of(low, offs)
    total, down = prefix_hash(low)
    return low, s, e, row, piece, span_hash(total, down, s, e), languages[row]


def phrase_names(words: np.ndarray, tongue: np.ndarray, piece: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of k words, and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(piece[:n] == piece[k - 1 :])
    h = tongue[at] + _U(k)
    for j in range(k):
        h = mix(h ^ words[at + j])
    return h, at


def _in(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = (names >> _U(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _candidates(words, tongue, piece, k: int, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``phrase_names`` of k words of which both parts of k - 1 words may be frequent."""
    name, at = phrase_names(words, tongue, piece, k)
    if k == 1 or not len(at):
        return name, at
    shorter, places = phrase_names(words, tongue, piece, k - 1)
    good = np.zeros(len(words) + 1, bool)
    good[places] = _in(known[k - 2], shorter)
    keep = good[at] & good[at + 1]
    return name[keep], at[keep]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of the bytes, one behind the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def _tight(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one blank behind each, and where each begins (and the end)."""
    size = e - s + 1
    begin = np.append(0, np.cumsum(size))
    out = _gather(np.append(data, np.uint8(32)), s, size)
    out[begin[1:] - 1] = 32
    return out, begin


def _tongues(column: pa.Array) -> np.ndarray:
    """A hash of each row's language, by its distinct values."""
    codes = column.dictionary_encode()
    data, offs = utf8(codes.dictionary)
    total, down = prefix_hash(data)
    own = span_hash(total, down, offs[:-1], offs[1:])
    return own[codes.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(len(column), np.uint64)


def _folded(name: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different names and how often each comes."""
    order = np.argsort(name)
    name = name[order]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(name))) if n is None else np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return name[first], size


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words that come at least ``least`` times in a language; f is exact."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known: list[np.ndarray] = []

    def each(batch: pa.RecordBatch):
        tongues = _tongues(batch.column("lang"))
        data, offs = utf8(batch.column("text"))
        for a, z in blocks(offs, 2 * BLOCK_BYTES - 1):
            yield a, _hashed(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], tongues[a:z])

    for k in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(known)

        def counted(batches, k=k, shared=shared):
            for batch in batches:
                found = [_folded(_candidates(words, tongue, piece, k, shared.value)[0]) for _, (_, _, _, _, piece, words, tongue) in each(batch)]
                if found:
                    name, n = _folded(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n)], names=["name", "n"])

        often = rows.mapInArrow(counted, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        place = F.shiftrightunsigned("name", 64 - FILTER_BITS)
        bits = often.select(F.shiftright(place, 3).alias("byte"), F.expr("shiftleft(1, cast(shiftrightunsigned(name, {}) & 7 as int))".format(64 - FILTER_BITS)).alias("bit"))
        bits = bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(FILTER_BITS - 3) rows at most
        bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        bitmap[bits.column("byte").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint8)
        known.append(bitmap)
    shared = spark.sparkContext.broadcast(known)

    def written(batches):
        """The phrases that may be frequent as texts, the words joined by blanks, with their counts in a block; a phrase of no words for all words."""
        for batch in batches:
            for a, (low, s, e, row, piece, words, tongue) in each(batch):
                tight, begin = _tight(low, s, e)
                for k in range(1, longest + 1):
                    name, at = _candidates(words, tongue, piece, k, shared.value)
                    good = _in(shared.value[k - 1], name)
                    order = np.argsort(name[good], kind="stable")
                    name, at = name[good][order], at[good][order]
                    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else order
                    size = np.diff(np.append(first, len(name)))
                    at = at[first]
                    long = begin[at + k] - begin[at] - 1
                    ends = np.append(0, np.cumsum(long))
                    texts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_gather(tight, begin[at], long))]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(a + row[at])), pa.array(np.full(len(at), k, np.int32)), texts, pa.array(size, pa.int64())], names=["lang", "k", "phrase", "f"])
                rows, size = np.unique(row, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(a + rows)), pa.array(np.zeros(len(rows), np.int32)), pa.array([""] * len(rows), pa.string()), pa.array(size, pa.int64())], names=["lang", "k", "phrase", "f"])

    counts = rows.mapInArrow(written, "lang string, k int, phrase string, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return settle(counts.where((F.col("f") >= least) | (F.col("k") == 0)))


def _stream(counts: DataFrame, words: Column, longest: int, out: str) -> DataFrame:
    """lang, phrase, k, f, the counts ``out``2, ``out``3, ... of the beginnings of so many words, and the greatest count of an extension by one word.

    A partition holds the phrases that begin with the same two words, in order. There the beginning of j words of a phrase
    is the last row of j words so far, and every beginning of a frequent phrase is frequent, so it has a row.
    """
    rows = counts.withColumn("__w", words).withColumns({"__u": F.col("__w")[0], "__v": F.col("__w")[1]})
    own = Window.partitionBy("lang", "__u", "__v").orderBy("__w")
    last = lambda j, c: F.last(F.when(F.col("k") == j, F.col(c)), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__rn", F.row_number().over(own))
    rows = rows.select("*", *(last(j, "f").alias(f"{out}{j}") for j in range(2, longest)), *(last(j, "__rn").alias(f"__g{j}") for j in range(2, longest)))
    # a phrase of j words and its extensions by one word have the same last row of j words
    extended = [F.when(F.col("k") == j, F.max(F.when(F.col("k") == j + 1, F.col("f"))).over(Window.partitionBy("lang", "__u", "__v", f"__g{j}"))) for j in range(2, longest)]
    rows = rows.withColumn(f"{out}_extended", F.coalesce(*extended, F.lit(0)))
    return rows.select("lang", "phrase", "k", "f", *(f"{out}{j}" for j in range(2, longest)), f"{out}_extended")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score.

    Texts are read whole, in lower case (A-Z only); a null text is empty and a null language is ``und``. Repeated rows
    count as often as they come, ties go to the greater count and then to the phrase in the order of its bytes. Other
    columns are not read. A language without phrases, and an empty table, give no rows.
    """
    found = phrase_counts(docs, text, lang, longest, least)
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    totals = F.broadcast(totals) if totals.limit(FEW + 1).count() <= FEW else totals
    single = found.where("k = 1").select("lang", F.col("phrase").alias("word"), F.col("f").alias("w"))
    counts, words = found.where("k > 1"), F.split("phrase", " ")
    fore = _stream(counts, words, longest, "l")
    back = _stream(counts, F.reverse(words), longest, "r").drop("k", "f")
    both = fore.join(back.hint("merge"), ["lang", "phrase"]).where(F.greatest("l_extended", "r_extended") < F.col("f"))
    for side, at in (("l", 0), ("r", -1)):
        word = F.element_at(words, 1 if at == 0 else -1)
        both = both.withColumn("word", word).join(single.withColumnRenamed("w", f"{side}1").hint("merge"), ["lang", "word"]).drop("word")
    both = both.join(totals, "lang")

    def cut(k: int, j: int) -> Column:
        """Score of a phrase of k words cut behind j words; sizes are in whole numbers of 38 digits."""
        score = F.expr(f"(cast(f as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l{j} as decimal(19,0)) * cast(r{k - j} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{k - j}").alias("r"))

    lowest = F.coalesce(*(F.when(F.col("k") == k, F.array_min(F.array(*(cut(k, j) for j in range(1, k))))) for k in range(2, longest + 1)))
    scored = both.withColumn("__c", lowest).select("lang", "phrase", F.col("f").alias("a"), "__c.l", "__c.r", "n", "__c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
