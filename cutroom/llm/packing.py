"""Packing of tokenised documents into fixed-length sequences by shortest-pack-first over the length histogram.

Executors tokenise and cut; the driver sees the histogram of piece lengths (one number per length, so at most
``max_tokens`` numbers) and turns it into packing patterns with counts; pieces find their place by their rank among
the pieces of equal length. The rank is made without a task that holds a whole length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import BLOCK_BYTES, release, settle, small_batches
from .sharding import ranked

MAX_TOKENS = 2048
END_ID = 1
#: Words whose ids a worker remembers at most, the longest such word, and words that are encoded as one text.
KNOWN_WORDS, KNOWN_CHARS, WORDS_AT_ONCE = 250_000, 48, 256
#: Words that a worker keeps for its next task, where it may keep any: the first ones that it met, so mostly frequent ones.
KEPT_WORDS = 150_000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A comma or full stop at a word's end that belongs to a longer run of signs, so it can't be cut off.
_RUN_OF_SIGNS = re.compile(r"[,.] (?:(?<=[^\w\s][,.] )|(?<=_[,.] ))")


def _words(text: str) -> list[str]:
    """Words that the tokenizer encodes on their own: parts at blanks, line feeds and before a word's last , or .

    Its splitter keeps letters, single digits and runs of other signs apart, so a sign behind a letter or digit is a part
    of its own. Latin-1 is lower-cased here, as the tokenizer does, so that fewer different words come up.
    """
    text = text.replace("\n", " ") + " "
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    if not _RUN_OF_SIGNS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    Each different word is encoded once, as long as a worker remembers it. A text with a string of the added tokens'
    form goes through the tokenizer whole.
    """

    _held: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.model._resize_cache(0)  # the words that it gets are all different
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part of a word
        for part, i in vocabulary.items():
            self.ends[i] = part.endswith("</w>")

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    @classmethod
    def done(cls, keep: bool) -> None:
        """A task's end: keep the tokenizer and some words for the next one (about 80 MB), or nothing, as other operators need memory."""
        for encoder in cls._held.values():
            encoder.known = dict(islice(encoder.known.items(), KEPT_WORDS))
        if not keep:
            cls._held.clear()
        release()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of letters alone are one part each: many go as one text, cut behind each part's end."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        groups = [letters[i : i + WORDS_AT_ONCE] for i in range(0, len(letters), WORDS_AT_ONCE)]
        odd = [w for w in words if not w.isalpha()]
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups]), strict=True):
            cuts = [0, *((np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()]
            if len(cuts) != len(group) + 1:
                odd += group
                continue
            out.update(zip(group, (ids[a:z] for a, z in pairwise(cuts)), strict=True))
        out.update(zip(odd, self._whole(odd), strict=True))
        return [out[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [[] if "<|" in t else _words(t) for t in texts]
        fresh = list(set().union(*split) - self.known.keys())
        self.known.update(zip(fresh, self._encode(fresh), strict=True))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        room = KNOWN_WORDS - len(self.known) + len(fresh)
        for i, w in enumerate(fresh):
            if i >= room or len(w) > KNOWN_CHARS:
                del self.known[w]
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def cut_pieces(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: pieces of at most ``max_tokens`` ids; all but a document's last are full."""
    end = struct.pack("<I", end_id)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches):
        encoder = WordEncoder.of(path or tokenizer_file())
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            a = 0
            while a < len(texts):
                z, size, part = a, 0, []
                while z < len(texts) and size < BLOCK_BYTES:
                    part.append(texts[z].as_py() or "")
                    size += len(part[-1])
                    z += 1
                take, rows = [], []
                for i, ids in enumerate(encoder.encode(part)):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, max_tokens):
                        body = ids[4 * s : 4 * (s + max_tokens)]
                        take.append(a + i)
                        rows.append((s, len(body) // 4, zlib.crc32(body), n))
                numbers = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), *(pa.array(numbers[:, j]) for j in range(4))], names=schema.names)
                a = z
        WordEncoder.done(keep)

    return small_batches(docs).select(key, text).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (count, ((length, how many), ...)) that hold each length as often as the histogram says.

    Lengths are placed longest first, each into the packs that are shortest so far; packs of the same contents are one
    pattern with a count, so a step moves many packs at once. New packs take as many of the length as fit.
    """
    open_packs: dict[int, list] = {}  # room left -> [count, contents]
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room >= length:
                count, contents = open_packs[room].pop()
                moved = min(count, left)
                if moved < count:
                    open_packs[room].append((count - moved, contents))
                if not open_packs[room]:
                    del open_packs[room]
                if contents[-1][0] == length:
                    contents = (*contents[:-1], (length, contents[-1][1] + 1))
                else:
                    contents = (*contents, (length, 1))
                open_packs.setdefault(room - length, []).append((moved, contents))
                left -= moved
                continue
            fit = max_tokens // length
            for count, many in ((left // fit, fit), (1, left % fit)):
                if count and many:
                    open_packs.setdefault(max_tokens - length * many, []).append((count, ((length, many),)))
            left = 0
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def _places(patterns) -> dict[int, np.ndarray]:
    """For each length, a row for each pattern that holds it: first rank, how many, first sequence, offset."""
    places: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for count, contents in patterns:
        at = 0
        for length, many in contents:
            places.setdefault(length, []).append((taken.get(length, 0), many, first, at))
            taken[length] = taken.get(length, 0) + count * many
            at += length * many
        first += count
    return {length: np.array(rows, np.int64) for length, rows in places.items()}


def pack(pieces: DataFrame, key: str = "doc_id", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths must be 1 .. max_tokens; equal lengths are ranked by (key, start)."""
    pieces = settle(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(_places(shortest_pack_first(histogram, max_tokens)))
    rows = ranked(pieces, ["length"], [key, "start"], "__rank")
    columns = list(pieces.columns)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(x).to_numpy() for x in ("length", "__rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[part[0]])
                begin, many, first, at = shared.value[length].T
                k = np.searchsorted(begin, ranks[part], side="right") - 1
                pack_no, slot = np.divmod(ranks[part] - begin[k], many[k])
                sequence[part], offset[part] = first[k] + pack_no, at[k] + slot * length
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), pa.array(sequence), pa.array(offset)], names=schema.names)

    return rows.select(*columns, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, keep: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless in its sequence).

    A null or empty text is the end id alone. Long texts are cut at multiples of ``max_tokens`` ids. Repeated rows are
    packed once each; null keys stay. Other columns are not read. An empty table gives an empty result. With ``keep``,
    Python workers keep the tokenizer and frequent words between tasks.
    """
    return pack(cut_pieces(docs, path, key, text, max_tokens, keep=keep), key, max_tokens)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=True)
