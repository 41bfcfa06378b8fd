"""Removal of long repeated substrings with a sparse suffix array that is spread over range partitions.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Every such string (window) is owned by one
anchor, the place of its smallest k-gram hash, so equal windows have equal anchors at equal distances. Suffixes at the
anchors stand for all windows they own:

1. Anchored suffixes go to range partitions by their leading bytes; the splitters are quantiles of a bounded sample. A
   bucket is sorted by multikey quicksort (leading bytes, then the k-gram, then the owned text), and neighbours are
   compared: equal owned texts repeat as a whole; equal k-grams with different owned texts may share single windows.
2. Only of the latter, one of each different text, the owned texts themselves go to the same buckets, where the suffixes
   at all their windows are sorted and compared in the same way.

A key that fills several buckets is a splitter more than once. Its rows are dealt over those buckets and compared across
the boundaries by counts that are combined before the shuffle, whole texts first and then windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, blocks, mix, only, prefix_hash, settle, small_batches, span_hash, utf8

LENGTH = 400
#: Shortest passage that is reported beside: over 50 words of running text, of five bytes with their space.
PASSAGE = 250
#: Anchors that a bucket should hold, about; the splitters are taken from so many keys a bucket, and documents at least.
BUCKET_ANCHORS, KEYS_PER_BUCKET, SAMPLE_DOCS = 1 << 20, 32, 1500
#: Rows of one text, of those that several buckets hold, that a task compares with its count; texts with more that are broadcast at most.
ROWS_AT_ONCE, BROADCAST_TEXTS = 1024, 1 << 16
_PLACE_BITS = 28


def gram_of(length: int) -> int:
    """Bytes of the k-grams that the windows' anchors are chosen by."""
    return max(1, length // 4)


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    tiles = padded.reshape(-1, w)
    fore = np.minimum.accumulate(tiles, axis=1).ravel()
    back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | data[at + j]
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int | None = None) -> tuple[np.ndarray, ...]:
    """row, first and last window (in the row), lead, k-gram hash and hash of the owned text of every anchor."""
    gram = gram or gram_of(length)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    total, down = prefix_hash(data)
    k = np.arange(len(data) - gram + 1)
    keys = mix((total[gram:] - total[:-gram]) * down[k])
    keys = (keys >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | k.astype(np.uint64)
    least = _slide_min(keys, length - gram + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    window = np.flatnonzero(np.arange(length, length + len(least)) <= offs[row + 1])
    if not len(window):
        return none
    owner = (least[window] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[window[1:]] != row[window[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    lo, hi, at = window[first], window[last], owner[first]
    owned = mix(span_hash(total, down, lo, hi + length) ^ ((at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    start = offs[row[lo]]
    return row[lo], lo - start, hi - start, _lead(data, at), span_hash(total, down, at, at + gram), owned


def anchors_of_rows(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int | None = None, step: int = 4 * BLOCK_BYTES):
    """``anchors`` of any rows: in blocks of rows, a very long row in steps that overlap."""
    margin = 2 * length
    for a, z in blocks(offs):
        if offs[z] - offs[a] <= step + 2 * margin:
            got = anchors(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], length, gram)
            yield (got[0] + a, *got[1:])
            continue
        size = int(offs[z] - offs[a])  # one row
        for p in range(0, size, step):
            b, e = max(0, p - margin), min(size, p + step + margin + length)
            got = anchors(data[offs[a] + b : offs[a] + e], np.array([0, e - b]), length, gram)
            mine = (got[1] + b >= p) & (got[1] + b < p + step)
            yield (got[0][mine] + a, got[1][mine] + b, got[2][mine] + b, *(x[mine] for x in got[3:]))


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Order by several keys: sort by the first, then only runs of equal rows by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    rank = np.zeros(len(order), np.int64)
    for n in range(1, len(keys)):
        before = keys[n - 1][order]
        rank[1:] += np.cumsum(before[1:] != before[:-1])
        tied = np.zeros(len(order), bool)
        tied[1:] = rank[1:] == rank[:-1]
        tied[:-1] |= rank[1:] == rank[:-1]
        at = np.flatnonzero(tied)
        order[at] = order[at[np.lexsort((keys[n][order[at]], rank[at]))]]
    return order


def _range_key(lead: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Six leading bytes, then 16 bits of the k-gram's hash: what the buckets are ranges of."""
    return (lead >> np.uint64(16) << np.uint64(16)) | (gram >> np.uint64(48))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _deal(splitters: np.ndarray, key: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each row, and whether its key is a splitter more than once, so that equal rows are in other buckets too."""
    left, right = np.searchsorted(splitters, key, "left"), np.searchsorted(splitters, key, "right")
    wide = right > left + 1
    return left + np.where(wide, salt % (right - left + 1).astype(np.uint64), 0).astype(np.int64), wide


def _splitters(sample: np.ndarray, buckets: int) -> np.ndarray:
    if not len(sample):
        return np.zeros(0, np.uint64)
    return np.sort(sample)[(np.arange(1, buckets) * len(sample)) // buckets]



#: What an anchor's row is: one of its kind in its text, one that stands for several in its text, or a range of such ones.
ALONE, SEVERAL, RANGE = 0, 1, 2


def fold_rows(row, lo, hi, lead, gram, own) -> tuple[np.ndarray, ...]:
    """The anchors with a kind each. Of those that are equal within a text, as in a text that goes round in circles, one
    stays; all of them repeat for certain, so they become ranges at once, joined where they touch."""
    order = multikey_order(row.astype(np.uint64), gram, own)
    same = (row[order][1:] == row[order][:-1]) & (gram[order][1:] == gram[order][:-1]) & (own[order][1:] == own[order][:-1])
    kind, extra = np.full(len(row), ALONE), np.zeros(len(row), bool)
    kind[order[:-1][same]] = SEVERAL
    kind[order[1:][same]] = SEVERAL
    extra[order[1:][same]] = True
    many = np.flatnonzero(kind == SEVERAL)
    if not len(many):
        return row, lo, hi, lead, gram, own, kind
    new = np.ones(len(many), bool)
    new[1:] = (row[many][1:] != row[many][:-1]) | (lo[many][1:] != hi[many][:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = many[begin], many[np.append(begin[1:], len(many)) - 1]
    zero = np.zeros(len(first), np.uint64)
    pairs = (row, row[first]), (lo, lo[first]), (hi, hi[last]), (lead, zero), (gram, zero), (own, zero), (kind, np.full(len(first), RANGE))
    return tuple(np.concatenate([a[~extra], b]) for a, b in pairs)


def compare_neighbours(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (id, h, lo, hi, lead, gram, own, kind, bucket, open) that repeat: with ``whole`` (an equal own elsewhere), ``mixed``
    (a different own under the same gram) and ``first`` (the one that stands for all equal ones). Others are left out.
    """
    fields = [f for f in rows.schema.fields if f.name not in ("bucket", "open")]
    names = [f.name for f in fields] + ["open", "whole", "mixed", "first"]
    schema = T.StructType(fields + [T.StructField(x, T.BooleanType()) for x in names[-4:]])

    def compare(batches):
        held = list(batches)  # one bucket: a bounded share of the rows
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        cells = {x: table.column(x).combine_chunks() for x in table.column_names}
        lead, gram, own = (_unsigned(cells[x]) for x in ("lead", "gram", "own"))
        kind = cells["kind"].to_numpy()
        ranges, rest = np.flatnonzero(kind == RANGE), np.flatnonzero(kind != RANGE)
        if len(ranges):
            at, flags = pa.array(ranges), [pa.array(np.full(len(ranges), x)) for x in (False, True, False, False)]
            yield from pa.Table.from_arrays([*(cells[f.name].take(at) for f in fields), *flags], names=names).to_batches(max_chunksize=20_000)
        if not len(rest):
            return
        order = rest[multikey_order(lead[rest], gram[rest], own[rest])]
        lead, gram, own = lead[order], gram[order], own[order]
        is_open = cells["open"].to_numpy(zero_copy_only=False)[order]
        run = np.ones(len(order), bool)
        run[1:] = (lead[1:] != lead[:-1]) | (gram[1:] != gram[:-1])
        text = run.copy()
        text[1:] |= own[1:] != own[:-1]
        starts, texts = np.flatnonzero(run), np.flatnonzero(text)
        sizes = np.diff(np.append(texts, len(order)))
        whole = np.repeat((sizes > 1) | np.maximum.reduceat(kind[order] == SEVERAL, texts), sizes)
        n_texts = np.add.reduceat(text.astype(np.int64), starts)
        mixed = np.repeat(n_texts > 1, np.diff(np.append(starts, len(order))))
        keep = np.flatnonzero(is_open | whole | (mixed & text))
        at = pa.array(order[keep])
        flags = [pa.array(x[keep]) for x in (is_open, whole, mixed, text)]
        yield from pa.Table.from_arrays([*(cells[f.name].take(at) for f in fields), *flags], names=names).to_batches(max_chunksize=20_000)

    near = settle(rows.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(compare, schema))
    # across the boundaries: the rows of keys that fill several buckets
    spread = near.where("open").drop("whole", "mixed", "first")
    keys = ["lead", "gram", "own"]
    texts = spread.groupBy(*keys).agg(F.sum(1 + F.col("kind")).alias("n"), F.ceil(F.count("*") / ROWS_AT_ONCE).alias("parts"), F.min(F.struct("id", "h", "lo")).alias("least"))
    grams = texts.groupBy("lead", "gram").agg((F.min("own") != F.max("own")).alias("mixed"))
    texts = settle(texts.join(grams, ["lead", "gram"]))
    many = texts.where("parts > 1").select(*keys, "parts")
    many = F.broadcast(many) if many.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else many
    spread = spread.join(many, keys, "left").withColumn("part", F.pmod(F.xxhash64("id", "h", "lo"), F.coalesce("parts", F.lit(1)))).drop("parts")
    across = spread.join(texts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts"), [*keys, "part"]).drop("part")
    across = across.withColumns({"whole": F.col("n") > 1, "first": F.struct("id", "h", "lo").eqNullSafe(F.col("least"))})
    return near.where("not open").unionByName(across.select(*near.columns).where("whole or mixed"))


def _text_key(id_: str, text: str):
    return [F.col(id_).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text")]


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(id, h, lo, hi): ranges of starts of windows that also start elsewhere; h is the text's hash, which with the id names a row."""
    spark = docs.sparkSession
    gram = gram or gram_of(length)
    rows = small_batches(docs).select(*_text_key(key, text))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    density = 2 / (length - gram + 2)  # anchors a byte of random text
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * density / BUCKET_ANCHORS))
    id_type = docs.schema[key].dataType
    longs = lambda names: [T.StructField(x, T.LongType()) for x in names]
    schema = T.StructType([T.StructField("id", id_type), *longs(("h", "lo", "hi", "lead", "gram", "own", "kind", "bucket")), T.StructField("open", T.BooleanType())])

    def lay(splitters, cells, row, lo, hi, lead, gram_, own, kind):
        row = pa.array(row)
        salt = mix(own ^ cells[1].take(row).to_numpy(zero_copy_only=False).view(np.uint64) ^ lo.astype(np.uint64))
        bucket, is_open = _deal(splitters, _range_key(lead, gram_), salt)
        bucket = np.where(kind == RANGE, (salt % np.uint64(buckets)).astype(np.int64), bucket)
        is_open &= kind != RANGE
        numbers = [pa.array(x.view(np.int64)) for x in (lead, gram_, own)]
        return pa.RecordBatch.from_arrays([cells[0].take(row), cells[1].take(row), pa.array(lo), pa.array(hi), *numbers, pa.array(kind.astype(np.int64)), pa.array(bucket), pa.array(is_open)], names=schema.names)

    def sample_keys(batches):
        for batch in batches:
            for got in anchors_of_rows(*utf8(batch.column(0)), length, gram):
                _, _, _, lead, gram_, _, kind = fold_rows(*got)
                yield pa.RecordBatch.from_arrays([pa.array(_range_key(lead, gram_)[kind != RANGE].view(np.int64))], names=["key"])

    share = min(1.0, max(SAMPLE_DOCS / max(n, 1), 4 * buckets * KEYS_PER_BUCKET / max(size * density, 1)))
    some = rows if share == 1 else rows.where(F.pmod(F.xxhash64("h", "id"), F.lit(1 << 30)) < int((1 << 30) * share))
    keys = some.select("text").mapInArrow(sample_keys, "key long")
    keys = keys if share == 1 else keys.where(F.rand(7) < 0.25)
    shared = spark.sparkContext.broadcast(_splitters(keys.toArrow().column("key").to_numpy().view(np.uint64), buckets))

    def anchored(batches):
        for batch in batches:
            for found in anchors_of_rows(*utf8(batch.column(2)), length, gram):
                if len(found[0]):
                    yield lay(shared.value, batch.columns, *fold_rows(*found))

    found = compare_neighbours(rows.mapInArrow(anchored, schema), buckets)
    whole = found.where("whole").select("id", "h", "lo", "hi")

    # windows of different texts under one k-gram
    asked = found.where("mixed and first").groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi", "lead", "gram", "open")).alias("spans"))
    wanted = only(rows, asked, ["id", "h"])
    joined = wanted.join(asked.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "spans"), F.expr("id <=> i2 and h <=> h2")).select("id", "h", "text", "spans")
    part_schema = T.StructType([schema["id"], *longs(("h", "lo", "lead", "gram", "bucket")), T.StructField("part", T.BinaryType())])

    def parts(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            take, cells, owned = [], [], []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                for s in (s for s in spans if not s["open"]):
                    take.append(i)
                    cells.append((s["lo"], s["lead"], s["gram"]))
                    owned.append(data[offs[i] + s["lo"] : offs[i] + s["hi"] + length].tobytes())
            lo, lead, gram_ = np.array(cells, np.int64).reshape(-1, 3).T
            bucket, _ = _deal(shared.value, _range_key(lead.astype(np.int64).view(np.uint64), gram_.astype(np.int64).view(np.uint64)), np.zeros(len(lo), np.uint64))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, (lo, lead, gram_, bucket)), pa.array(owned, pa.binary())], names=part_schema.names)

    span_schema = T.StructType([schema[x] for x in ("id", "h", "lo", "hi")])

    def compare_windows(batches):
        held = list(batches)  # one bucket: a bounded share of the parts
        if not held:
            return
        table = pa.Table.from_batches(held)
        order = multikey_order(*(_unsigned(table.column(x)) for x in ("lead", "gram")))
        table = table.take(pa.array(order)).combine_chunks()
        gram_ = table.column("gram").to_numpy()
        data, offs = utf8(table.column("part"))
        groups = np.append(np.flatnonzero(np.append(True, gram_[1:] != gram_[:-1])), len(gram_)) if len(gram_) else np.zeros(1, np.int64)
        for a, z in blocks(offs[groups]):
            a, z = int(groups[a]), int(groups[z])
            row, lo, hi = _shared_windows(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], gram_[a:z], length)
            ids = pa.array(row + a)
            start = table.column("lo").take(ids).to_numpy()
            yield pa.RecordBatch.from_arrays([*(table.column(x).take(ids).combine_chunks() for x in ("id", "h")), pa.array(start + lo), pa.array(start + hi)], names=span_schema.names)

    inside = joined.where(F.exists("spans", lambda s: ~s["open"])).mapInArrow(parts, part_schema)
    inside = inside.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(compare_windows, span_schema)

    def windows(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for i, spans in enumerate(batch.column(3).to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                for s in (s for s in spans if s["open"]):
                    part = own[s["lo"] : s["hi"] + length]
                    total, down = prefix_hash(part)
                    at = np.arange(s["hi"] - s["lo"] + 1)
                    ids = pa.array(np.full(len(at), i))
                    numbers = (at + s["lo"], _lead(part, at).view(np.int64), span_hash(total, down, at, at + length).view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), *map(pa.array, numbers)], names=["id", "h", "lo", "lead", "digest"])

    # the same of keys that fill several buckets: equal windows by partially aggregated counts
    window_schema = T.StructType([schema["id"], *longs(("h", "lo", "lead", "digest"))])
    spread = joined.where(F.exists("spans", lambda s: s["open"])).mapInArrow(windows, window_schema)
    twice = spread.groupBy("lead", "digest").count().where("count > 1").select("lead", "digest")
    across = spread.join(twice, ["lead", "digest"], "left_semi").select("id", "h", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(inside).unionByName(across)


def _shared_windows(data: np.ndarray, offs: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (row, first, last) of the windows of each text that another text of its group has too."""
    many = np.diff(offs) - length + 1
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = offs[row] + place
    total, down = prefix_hash(data)
    keys = group[row].view(np.uint64), _lead(data, at), span_hash(total, down, at, at + length)
    order = multikey_order(*keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    shared = np.zeros(len(order) + 2, bool)
    shared[order[1:][same] + 1] = True
    shared[order[:-1][same] + 1] = True
    edge = np.zeros(len(order) + 1, bool)
    edge[:-1] = place == 0
    opens = np.flatnonzero(shared[1:-1] & (~shared[:-2] | edge[:-1]))
    closes = np.flatnonzero(shared[1:-1] & (~shared[2:] | edge[1:]))
    return row[opens], place[opens], place[closes]


def _covered(spans: list, size: int, length: int) -> np.ndarray:
    edges = np.zeros(size + 1, np.int64)
    for s in spans:
        edges[s["lo"]] += 1
        edges[s["hi"] + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _spans(docs: DataFrame, key: str, text: str, length: int, gram: int | None = None) -> DataFrame:
    """(__id, __h, spans) of the texts with repeated windows; copies of a row give the same ones, which are combined first."""
    spans = repeated_windows(docs, key, text, length, gram).groupBy("id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return settle(spans.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, passage: int | None = None, whole_characters: bool = False) -> DataFrame:
    """``docs`` with kept (bytes without the removed runs), n_bytes, n_removed, n_spans.

    With ``whole_characters``, a character of which a byte goes goes whole, so kept is UTF-8 as the text is.

    With ``passage``, at most ``length``, also n_passage: bytes covered by strings of so many bytes that start elsewhere
    too. They are only counted. A longer string that repeats is made of such passages, so only texts with enough of
    them are searched for it.

    Texts are UTF-8 bytes, a null is empty; a text shorter than ``length`` keeps everything. Strings are judged on the
    input. Repeated rows repeat each other. Null keys stay; a column of an output's name is replaced; an empty table
    stays empty.
    """
    marked = docs.withColumns({"__id": F.col(key), "__h": F.xxhash64(F.col(text))})
    kinds = [("kept", "binary"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint")]
    if passage is None:
        spans = _spans(docs, key, text, length, gram).withColumn("short", F.lit(None).cast("array<struct<lo: bigint, hi: bigint>>"))
    else:
        kinds.append(("n_passage", "bigint"))
        short = _spans(docs, key, text, passage).withColumnRenamed("spans", "short")
        starts = F.aggregate("short", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"] + 1)
        able = only(marked, short.where(starts > length - passage), ["__id", "__h"]).select(key, text)
        long = _spans(able, key, text, length, gram).select(F.col("__id").alias("i"), F.col("__h").alias("g"), "spans")
        spans = short.join(long, F.expr("__id <=> i and __h <=> g"), "left").drop("i", "g")
    found = spans.select(F.col("__id").alias("__i2"), F.col("__h").alias("__h2"), F.struct("spans", "short").alias("__spans"))
    joined = only(marked, spans, ["__id", "__h"]).join(found, F.expr("__id <=> __i2 and __h <=> __h2"), "left").drop("__i2", "__h2")
    whole = only(marked, spans, ["__id", "__h"], absent=True).withColumn("__spans", F.lit(None).cast(found.schema["__spans"].dataType))
    joined = joined.unionByName(whole)
    arrow = {"binary": pa.binary(), "bigint": pa.int64()}

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        data, offs = utf8(texts)
        out = []
        for i in range(len(texts)):
            own = data[offs[i] : offs[i + 1]]
            here = found[i].as_py() or {}
            n_passage = int(_covered(here["short"], len(own), passage).sum()) if here.get("short") else 0
            if not here.get("spans"):
                out.append((own.tobytes(), len(own), 0, 0, n_passage))
                continue
            gone = _covered(here["spans"], len(own), length)
            if whole_characters:
                begins = (own & 0xC0) != 0x80
                begins[0] = True
                gone = np.maximum.reduceat(gone, np.flatnonzero(begins))[np.cumsum(begins) - 1]
            out.append((own[~gone].tobytes(), len(own), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), n_passage))
        return pa.StructArray.from_arrays([pa.array([x[j] for x in out], arrow[t]) for j, (_, t) in enumerate(kinds)], fields=[pa.field(n, arrow[t]) for n, t in kinds])

    done = F.arrow_udf(cut, f"struct<{', '.join(f'{n}: {t}' for n, t in kinds)}>")(F.col(text), F.col("__spans"))
    return joined.withColumn("__c", done).withColumns({x: F.col(f"__c.{x}") for x, _ in kinds}).drop("__c", "__id", "__h", "__spans")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
