"""Replacement of many terms in one reading of a text, by an ordered table of them."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that are looked for in one reading; a longer table takes several readings, in its order, of the same rows.
AT_ONCE = 1 << 16

_SPANS = "array<struct<at: int, to: int, new: string>>"
_SPAN = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("new", pa.string())]))


def _folded(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Terms:
    """Terms with what replaces them, in order; the automaton is built where it is used."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.entries, self.automaton = entries, None

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "automaton": None}

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(entry, start, end) of all terms in a text that stand between word boundaries."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for n, (term, _) in reversed(list(enumerate(self.entries))):  # of equal terms the first one counts
                self.automaton.add_word(_folded(term), (n, len(term)))
            self.automaton.make_automaton()
        out = []
        for last, (n, size) in self.automaton.iter(_folded(text)):
            start, end = last - size + 1, last + 1
            if _is_word(text, start - 1) != _is_word(text, start) and _is_word(text, last) != _is_word(text, end):
                out.append((n, start, end))
        return out

    def spans(self, text: str, taken: list[dict]) -> list[dict]:
        """The spans that are taken already, and those that these terms take of the rest: earlier entries first, then from the left."""
        out, free = list(taken), bytearray(b"\1") * len(text)
        for s in taken:
            free[s["at"] : s["to"]] = bytes(s["to"] - s["at"])
        for n, start, end in sorted(self.found(text)):
            if all(free[start:end]):
                free[start:end] = bytes(end - start)
                out.append({"at": start, "to": end, "new": self.entries[n][1]})
        return out


def _replaced(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["at"]):
        out += [text[at : s["at"]], s["new"]]
        at = s["to"]
    return "".join(out) + text[at:]


def _taken(shared: Broadcast):
    """The spans of a text with those of one block of terms added."""

    def take(texts: pa.Array, taken: pa.Array) -> pa.Array:
        return pa.array([shared.value.spans(t, s) if t else [] for t, s in zip(texts.to_pylist(), taken.to_pylist(), strict=True)], _SPAN)

    return F.arrow_udf(take, _SPANS)


def replace_terms(df: DataFrame, text: str, terms: DataFrame, out: str, at_once: int = AT_ONCE) -> DataFrame:
    """``df`` with the text in which the terms of the table (ord, term, spoken) are replaced.

    A term counts in any case of letters and between word boundaries. Where terms overlap the one with the smaller ord is
    taken, so longer ones stand before the shorter ones in them; of equal terms the first counts. What has been put in isn't looked at again.
    Terms that are null or empty are left out. A null text stays null.

    The table is read in blocks of ``at_once`` terms at most, each broadcast as one automaton, so its size doesn't matter to
    a worker's memory; all blocks are steps over the same rows, without a shuffle. ord and term should be unique together.
    """
    spark = df.sparkSession
    table = terms.where("term <> ''").select("ord", "term", F.coalesce("spoken", F.lit("")).alias("spoken")).orderBy("ord", "term", "spoken")
    spans = F.array().cast(_SPANS)
    rows, start = df.withColumn("__spans", spans), 0
    while True:
        block = [(r["term"], r["spoken"]) for r in table.offset(start).limit(at_once).collect()]
        if block:
            rows = rows.withColumn("__spans", _taken(spark.sparkContext.broadcast(Terms(block)))(F.col(text), F.col("__spans")))
        start += at_once
        if len(block) < at_once:
            break

    def put(texts: pa.Array, taken: pa.Array) -> pa.Array:
        return pa.array([_replaced(t, s) if t else t for t, s in zip(texts.to_pylist(), taken.to_pylist(), strict=True)], pa.string())

    return rows.withColumn(out, F.arrow_udf(put, "string")(F.col(text), F.col("__spans"))).drop("__spans")
