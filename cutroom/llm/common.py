"""Numpy kernels over Arrow text columns, shared by the corpus operators.

A text column arrives as one UTF-8 byte buffer and row offsets, so per-byte work is vectorised over many
rows at once. ``blocks`` bounds the bytes that are held in temporaries, whatever the batch or text size.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text makes a step of its own.
BLOCK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch (a longer row is a batch of its own). Texts are long, so a batch of the default size would fill a
#: worker's memory, and the buffers that it is made in stay with the executor.
BATCH_ROWS, BATCH_BYTES = 1000, 2 * BLOCK_BYTES
#: Rows that Spark's Parquet reader decodes at once: each task's scan holds their texts on the executor's heap.
SCAN_ROWS = 512

#: The white space of the word definition, [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(setting: str) -> int:
    """A number of rows, or of bytes with Spark's units."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)


def small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``; from now on its session decodes ``SCAN_ROWS`` rows of Parquet at once and hands Python workers batches of ``BATCH_ROWS`` rows and about ``most`` bytes at most.

    The plan runs after the operator has returned, so the settings can't be put back. Smaller ones stay.
    """
    conf = df.sparkSession.conf
    for name, size in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", most), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        if not 0 < _size(conf.get(name)) <= size:
            conf.set(name, str(size))
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. A folder of our own stands in for it in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or os.path.join(os.environ.get("TMPDIR", "/tmp"), "cutroom-checkpoints"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tally(df: DataFrame, **counts: Column) -> DataFrame:
    """``settle``, with the rows, and whatever ``counts`` ask for, counted by the job that writes the checkpoint: see ``counted``.

    A stage that is run again may count rows twice, so a count is no less than the true one, and 0 if that is 0.
    """
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items())))
    _counted[out] = seen.get
    return out


#: What was counted of tallied tables that are still in use.
_counted: WeakKeyDictionary = WeakKeyDictionary()


def counted(df: DataFrame, what: str = "rows") -> int:
    """A count that ``tally`` took of this very table."""
    return _counted[df][what]


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator over a table each of whose jobs removes its shuffle files as it ends.

    Else they stay until the driver happens to collect its garbage, and many small steps add up. A settled table doesn't need the files of
    the job that wrote it. The session's setting is put back afterwards, so what the caller runs isn't touched.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf = docs.sparkSession.conf
        was = conf.get(name, "false")
        conf.set(name, "true")
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(name, was)

    return run


#: Rows of a settled table of a few numbers that is broadcast at most.
FEW_ROWS = 1 << 16


def near(df: DataFrame) -> DataFrame:
    """A tallied table of narrow rows for a join: broadcast if it has ``FEW_ROWS`` rows at most, else as it is. Results are the same."""
    return F.broadcast(df) if counted(df) <= FEW_ROWS else df


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def release() -> None:
    """Give memory that the last batch left free back to the system: many workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null counts as empty."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(at, kind, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row's edge: starts, ends, rows."""
    n = len(mask)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1] | edge[1:n]
    closes[:-1] &= ~mask[1:] | edge[1:n]
    s = np.flatnonzero(opens)
    return s, np.flatnonzero(closes) + 1, np.searchsorted(offs, s, side="right") - 1


_held: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; those for a block are kept, those for a longer text are not."""
    if _held and n <= len(_held[0][0]):
        return _held[0]
    size = max(n, 2 * BLOCK_BYTES)
    up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size == 2 * BLOCK_BYTES:
        _held.append(made)
    return made


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash mod 2**64 (n + 1 values) and the factors that make a slice's hash independent of its place."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_letters()[data] * up[: len(data)], out=total[1:])
    return total, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hash(total: np.ndarray, down: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def shingles(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-word windows inside a row, their rows and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h + words[j : j + n]) * _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(32)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(h[at]), row[at], at


FILTER_BITS = 24


def only(rows: DataFrame, keys: DataFrame, on: list[str], absent: bool = False) -> DataFrame:
    """Rows whose key may be in ``keys`` (some others too), or those whose key isn't, without shuffling them.

    A bitmap of 2**FILTER_BITS hashed keys, at most 2**(FILTER_BITS - 5) words, is combined before its shuffle and broadcast.
    With very many keys it passes more rows than need be and changes nothing else.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << FILTER_BITS))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("__bits"))
    hit = (F.shiftright(place, 5) == F.col("__word")) & (F.col("__bits").bitwiseAND(F.expr("shiftleft(1L, cast(pmod(xxhash64({}), {}) & 31 as int))".format(", ".join(on), 1 << FILTER_BITS))) != 0)
    return rows.join(F.broadcast(words), hit, "left_anti" if absent else "left_semi")
