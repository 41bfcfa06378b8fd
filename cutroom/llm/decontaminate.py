"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every training text is a query (its different words); items whose score reaches a share of their own
score (the item as its own query) are retrieved and then verified: enough word 3-grams of the item's question part and
of its answer part must stand in the passage. Impacts are divided by the item's own score, so one threshold holds for
all items. Passages are two segments long and overlap by one, so an item no longer than a segment lies whole in one. A
segment is as long as the item's own class of length, 64 words or twice, four times, ... as many, each class with an
index of its own: how long other items are says nothing about an item.

Most passages are dismissed many at a time by a bound on the items: an item's common terms, whose impacts sum to less than a
part of the threshold, count as present, only the others are looked up and summed. Where no item's bound reaches the
threshold there is no pivot to find; the rest are searched by block-max WAND.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, prefix_hash, runs, settle, shingles, small_batches, span_hash, utf8

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Items per index that is broadcast; a larger benchmark is searched in several such blocks, with the statistics of all items.
ITEMS_PER_INDEX = 20_000
#: Words of a segment of the shortest items.
LEAST_SEGMENT = 64
POSTINGS_PER_BLOCK = 16
GRAM = 3


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte Latin letters À to Þ."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word (letters, digits and bytes from 128 on), case folded."""
    s, e, row = runs(WORD[data], offs)
    total, down = prefix_hash(fold(data))
    return span_hash(total, down, s, e), row


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: split behind its last question mark or "Answer:", else its last quarter of words is the answer."""
    for mark in ("Answer:", "answer:", "?"):
        head, found, tail = text.rpartition(mark)
        if found and head.strip() and tail.strip():
            return head + found, tail
    parts = text.split()
    cut = max(1, len(parts) - max(1, len(parts) // 4))
    return " ".join(parts[:cut]), " ".join(parts[cut:])


@dataclass
class Postings:
    items: np.ndarray
    impacts: np.ndarray
    last: np.ndarray  # last item of each block
    most: np.ndarray  # largest impact of each block
    bound: float


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray  # sorted word hashes
    postings: list[Postings]
    rare_from: np.ndarray  # for each term, where its postings in the next two begin: items for which it isn't common
    rare_items: np.ndarray
    rare_impacts: np.ndarray
    common: np.ndarray  # for each item, the impacts of its common terms
    parts: list[tuple[np.ndarray, np.ndarray]]  # 3-gram hashes of question and answer
    segment: int


def _grams(words: np.ndarray) -> np.ndarray:
    k = min(GRAM, len(words))
    return np.unique(shingles(words, np.zeros(len(words), np.int64), k)[0]) if k else np.zeros(0, np.uint64)


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words_of(data, np.array([0, len(data)]))[0]


@dataclass
class Statistics:
    """Of all items with a word, however many indexes they are dealt over."""

    items: int
    mean: float  # words of an item
    holders: dict[int, int]  # items that hold a word, for the words of one index at least


def statistics_of(items: list[tuple]) -> Statistics:
    """Statistics of (id, text) rows that are all items."""
    words = [w for _, t in items if t for w in [_hashed(t)] if len(w)]
    terms, counts = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True) if words else ((), ())
    lengths = [len(w) for w in words]
    return Statistics(len(words), float(np.mean(lengths)) if lengths else 0.0, {int(t): int(n) for t, n in zip(terms, counts, strict=True)})


def segment_of(words: int, least_segment: int = LEAST_SEGMENT) -> int:
    """Words of a segment of an item's class of length: the least segment doubled until the item fits."""
    return least_segment << max(0, -(-words // least_segment) - 1).bit_length()


def build_indexes(items: list[tuple], least: float = 0.5, statistics: Statistics | None = None) -> list[Index]:
    """Indexes of (id, text) rows, one for each class of length."""
    of, classes = statistics or statistics_of(items), {}
    for i, t in items:
        if t:
            classes.setdefault(segment_of(len(_hashed(t))), []).append((i, t))
    return [build_index(classes[segment], least, segment=segment, statistics=of) for segment in sorted(classes)]


def build_index(items: list[tuple], least: float = 0.5, k1: float = 1.2, b: float = 0.75, segment: int = LEAST_SEGMENT, statistics: Statistics | None = None) -> Index:
    """Index of (id, text) rows of one class of length; items without a word are left out. ``least`` is the threshold it will be searched with."""
    of = statistics or statistics_of(items)
    kept = [(i, t, w) for i, t in items if t for w in [_hashed(t)] if len(w)]
    ids = [i for i, _, _ in kept]
    lengths = np.array([len(w) for _, _, w in kept], float)
    rows: dict[int, list[tuple[int, int]]] = {}
    for n, (_, _, w) in enumerate(kept):
        for h, tf in zip(*(x.tolist() for x in np.unique(w, return_counts=True)), strict=True):
            rows.setdefault(h, []).append((n, tf))
    vocabulary = np.array(sorted(rows), np.uint64)
    own, weighted = np.zeros(len(kept)), []
    for h in vocabulary.tolist():
        at, tf = np.array([x[0] for x in rows[h]]), np.array([x[1] for x in rows[h]], float)
        idf = np.log(1 + (of.items - of.holders[h] + 0.5) / (of.holders[h] + 0.5))
        score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[at] / of.mean))
        own[at] += score
        weighted.append((at, score))
    postings = []
    for at, score in weighted:
        impact = score / own[at]
        cuts = np.arange(0, len(at), POSTINGS_PER_BLOCK)
        postings.append(Postings(at, impact, at[np.append(cuts[1:], len(at)) - 1], np.maximum.reduceat(impact, cuts), float(impact.max())))
    term = np.repeat(np.arange(len(postings)), [len(p.items) for p in postings])
    item = np.concatenate([p.items for p in postings]) if postings else np.zeros(0, np.int64)
    impact = np.concatenate([p.impacts for p in postings]) if postings else np.zeros(0)
    order = np.lexsort((impact, item))
    summed = np.cumsum(impact[order])
    first = np.searchsorted(item[order], np.arange(len(kept)))
    summed -= np.append(0.0, summed)[first][item[order]]
    is_common = np.zeros(len(item), bool)
    is_common[order] = summed < least / 2
    common = np.bincount(item[is_common], weights=impact[is_common], minlength=len(kept))
    rare = ~is_common
    rare_from = np.searchsorted(term[rare], np.arange(len(postings) + 1))
    parts = [tuple(_grams(_hashed(x)) for x in question_and_answer(t)) for _, t, _ in kept]
    return Index(ids, vocabulary, postings, rare_from, item[rare], impact[rare], common, parts, segment)


def block_max_wand(index: Index, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All items whose impacts over ``terms`` sum to ``least`` or more, by item.

    Lists are kept in the order of their current item. The pivot is the first item where the lists' bounds reach the
    threshold; if the bounds of the current blocks don't, whole blocks are skipped, else the item is scored.
    """
    cursors = [[p, 0] for p in (index.postings[t] for t in terms)]
    found, margin = [], least - 1e-9
    while True:
        cursors = [c for c in cursors if c[1] < len(c[0].items)]
        cursors.sort(key=lambda c: c[0].items[c[1]])
        total, pivot = 0.0, None
        for n, (p, at) in enumerate(cursors):
            total += p.bound
            if total >= margin:
                pivot = int(p.items[at])
                break
        if pivot is None:
            return found
        while n + 1 < len(cursors) and cursors[n + 1][0].items[cursors[n + 1][1]] == pivot:
            n += 1
        block_total, edge = 0.0, len(index.ids)
        for p, at in cursors[: n + 1]:
            k = int(np.searchsorted(p.last, pivot))
            if k < len(p.last):
                block_total += float(p.most[k])
                edge = min(edge, int(p.last[k]) + 1)
        if block_total < margin:  # no item before the first block's end can reach it, nor one before the next list's item
            follow = int(cursors[n + 1][0].items[cursors[n + 1][1]]) if n + 1 < len(cursors) else len(index.ids)
            goal = max(pivot + 1, min(edge, follow))
            for c in cursors[: n + 1]:
                c[1] += int(np.searchsorted(c[0].items[c[1] :], goal))
            continue
        score = 0.0
        for c in cursors[: n + 1]:
            c[1] += int(np.searchsorted(c[0].items[c[1] :], pivot))
            if c[1] < len(c[0].items) and c[0].items[c[1]] == pivot:
                score += float(c[0].impacts[c[1]])
                c[1] += 1
        if score >= margin:
            found.append((pivot, score))


def _overlap(part: np.ndarray, passage: np.ndarray) -> float:
    return float(np.isin(part, passage).mean()) if len(part) else 1.0


def search(index: Index, data: np.ndarray, offs: np.ndarray, least: float, verify: float, hashed: tuple[np.ndarray, np.ndarray] | None = None):
    """(row, item, score, question overlap, answer overlap) of every verified passage; a pair may come twice. ``hashed``: ``words_of`` the texts."""
    if not len(index.vocabulary):
        return
    words, row = hashed or words_of(data, offs)
    if not len(words):
        return
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    place = np.arange(len(words)) - first[row]
    per_row = np.bincount(row, minlength=len(offs) - 1)
    segments = -(-per_row // index.segment)
    base = np.zeros(len(segments) + 1, np.int64)
    np.cumsum(segments, out=base[1:])
    segment = base[row] + place // index.segment
    term = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    hit = np.flatnonzero(index.vocabulary[term] == words)
    pairs = np.unique(segment[hit] * len(index.vocabulary) + term[hit])
    seg_of, term_of = np.divmod(pairs, len(index.vocabulary))
    owner = np.repeat(np.arange(len(segments)), segments)
    follows = np.zeros(base[-1] + 1, bool)  # the next segment is of the same row
    follows[: len(owner) - 1] = owner[1:] == owner[:-1]
    at = np.searchsorted(seg_of, np.arange(base[-1] + 2))
    many = index.rare_from[term_of + 1] - index.rare_from[term_of]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.rare_from[term_of], many)
    seg, item, impact = np.repeat(seg_of, many), index.rare_items[entry], index.rare_impacts[entry]
    second = (seg > 0) & follows[seg - 1]  # a segment is also the second of the passage before
    key = np.concatenate([seg * len(index.ids) + item, (seg[second] - 1) * len(index.ids) + item[second]])
    key, where = np.unique(key, return_inverse=True)
    bound = np.bincount(where, weights=np.concatenate([impact, impact[second]]), minlength=len(key)) + index.common[key % len(index.ids)]
    for seg in np.unique(key[bound >= least - 1e-9] // len(index.ids)).tolist():
        end = seg + 2 if follows[seg] else seg + 1
        terms = np.unique(term_of[at[seg] : at[end]]).tolist()
        candidates = block_max_wand(index, terms, least)
        if not candidates:
            continue
        r = int(owner[seg])
        lo = first[r] + (seg - base[r]) * index.segment
        span = words[lo : min(lo + (end - seg) * index.segment, first[r] + per_row[r])]
        grams = {k: np.unique(shingles(span, np.zeros(len(span), np.int64), k)[0]) for k in range(1, GRAM + 1)}
        for item, score in candidates:
            question, answer = index.parts[item]
            # a part shorter than a 3-gram has one gram of its own length, hashed alike
            q, a = (max(_overlap(x, grams[k]) for k in grams) if len(x) == 1 else _overlap(x, grams[GRAM]) for x in (question, answer))
            if q >= verify and a >= verify:
                yield r, item, score, q, a


def leaking_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = 0.5, verify: float = 0.5) -> DataFrame:
    """(key, text_hash, item, score, question_overlap, answer_overlap) of every verified passage; key and text_hash (xxhash64) name a row."""
    names = [key, "text_hash", "__item", "score", "question_overlap", "answer_overlap"]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("__item", benchmark.schema[item].dataType), *(T.StructField(x, T.DoubleType()) for x in names[3:])])
    items = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    parts = max(1, -(-items.count() // ITEMS_PER_INDEX))
    items = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int"))

    def terms_of(batches):
        for batch in batches:
            words = [_hashed(t) for t in batch.column(1).to_pylist()]
            terms = pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), terms], names=["part", "n", "terms"])

    counted = settle(items.select("part", "t").mapInArrow(terms_of, "part int, n long, terms array<long>").where("n > 0"))
    n_items, mean = counted.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    term_parts = counted.select("part", F.explode("terms").alias("term"))
    holders = term_parts.groupBy("term").agg(F.count("*").alias("holders"))
    per_part = settle(term_parts.distinct().join(holders, "term"))
    found = None
    for n in range(parts):  # at most ITEMS_PER_INDEX items or so at a time on the driver, with the counts of their words
        of = Statistics(n_items, mean, {int(np.int64(r["term"]).view(np.uint64)): r["holders"] for r in per_part.where(F.col("part") == n).collect()})
        indexes = build_indexes([(r["i"], r["t"]) for r in items.where(F.col("part") == n).collect()], least, statistics=of)
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def scan(batches, shared=shared):
            for batch in batches:
                data, offs = utf8(batch.column(2))
                for a, z in blocks(offs):
                    part, at = data[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
                    hashed = words_of(part, at)
                    for index in shared.value:
                        rows = list(search(index, part, at, least, verify, hashed))
                        if rows:
                            own = pa.array([a + r[0] for r in rows])
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([index.ids[r[1]] for r in rows]), *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4))], names=names)

        part = small_batches(docs).select(key, F.xxhash64(F.col(text)).alias("text_hash"), text).mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("__item", item)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = 0.5, verify: float = 0.5) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap): the best passage of each key and leaked item.

    Null and empty texts and items without a word leak nothing; a text shorter than a passage is one passage; texts are
    searched whole, in passages of the item's own class of length. Scores don't depend on how many indexes the items
    are dealt over. Ties give one row. Rows that repeat a key, or have none, give one row for the key (null counts as one) and item;
    ``leaking_rows`` tells them apart. Items that repeat an id are one item of it. Other columns are not read. Empty tables give no rows.
    """
    found = leaking_passages(docs, benchmark, key, text, item, item_text, least, verify)
    best = Window.partitionBy(key, item).orderBy(F.desc("score"), F.desc("question_overlap"), F.desc("answer_overlap"))
    return found.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").select(key, item, *(F.round(x, 6).alias(x) for x in ("score", "question_overlap", "answer_overlap")))


def leaking_rows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(key, text_hash) of the rows that hold an item, once each: of rows that share a key, or have none, only those whose own text leaks."""
    return leaking_passages(docs, benchmark, key, text, **more).select(key, "text_hash").distinct()


def op1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
