"""Text to segments and captions: splitting, packing, cleaning, timing, alignment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import contains

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutroom.functions.dictionary import replace_terms

#: Punctuation that breaks a text into caption units; a point between digits doesn't.
BREAKS = r"\n|(?<![0-9])\.|\.(?![0-9])|[?,、;:!…？，。；：！]"
SMALL_NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_sentences(df: DataFrame, text: str = "text", min_len: int = 1) -> DataFrame:
    """X-1. Sentences in order (pos, sentence); short ones are merged until long enough, a short tail joins the last.

    A text without a sentence is one sentence as it stands.
    """
    parts = _parts(F.col(text), "[.!?]+")
    if min_len > 1:

        def merge(acc: Column, x: Column) -> Column:
            open_ = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
            full = F.char_length(open_) >= min_len
            return F.struct(F.when(full, F.concat(acc["done"], F.array(open_))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(open_).alias("open"))

        def finish(acc: Column) -> Column:
            n = F.size(acc["done"])
            joined = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), F.lit(" "), acc["open"])))
            return F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(joined)

        parts = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")), merge, finish)
    parts = F.when(F.size(parts) == 0, F.array(F.coalesce(F.col(text), F.lit("")))).otherwise(parts)
    return df.select("*", F.posexplode(parts).alias("pos", "sentence"))


def segment_list(text: str, least: int = 25, most: int = 150) -> list[str]:
    """X-2 for one text: sentences; long ones are packed anew at commas, short ones wait for the next.

    A waiting short one is let go before the sentence that would have completed it, not with it.
    """
    sentences = [s.strip() for s in re.split(r"[.!?]+", text) if s.strip()]
    packed: list[str] = []
    for s in sentences:
        if len(s) <= most:
            packed.append(s)
            continue
        held = ""
        for part in (p.strip() for p in s.split(",") if p.strip()):
            if held and len(held) + 2 + len(part) > most:
                packed.append(held)
                held = part
            else:
                held = f"{held}, {part}" if held else part
        if held:
            packed.append(held)
    out, wait = [], ""
    for s in packed:
        size = len(s) + (len(wait) + 2 if wait else 0)
        if size < least:
            wait = f"{wait}. {s}" if wait else s
        elif wait or size > most:  # what waits goes alone, this one waits
            out += [wait] if wait else []
            wait = s
        else:
            out.append(s)
    return out + [wait] * bool(wait)


def _exploded(df: DataFrame, column: str, fold, out: str, kind: str = "string") -> DataFrame:
    """Rows of a per-row fold over a column, in order; the fold returns a list."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fold(v) if v is not None else [])

    rows = df.withColumn("__list", F.pandas_udf(run, f"array<{kind}>")(F.col(column)))
    return rows.select(*df.columns, F.posexplode("__list").alias("pos", out))


def segment_script(df: DataFrame, text: str = "text", least: int = 25, most: int = 150) -> DataFrame:
    """X-2. Segments of a script in order (pos, segment)."""
    return _exploded(df, text, lambda t: segment_list(t, least, most), "segment")


def split_on_punctuation(df: DataFrame, text: str = "text") -> DataFrame:
    """X-3. Caption units in order (pos, unit)."""
    return df.select("*", F.posexplode(_parts(F.col(text), BREAKS)).alias("pos", "unit"))


def _packed(sentences: Column, limit: int, size) -> Column:
    """Join sentences in order while their size stays within the limit."""

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
        over = (acc["open"] != "") & (size(joined) > limit)
        return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(over, x).otherwise(joined).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(sentences, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunk_by_words(df: DataFrame, text: str = "text", most: int = 130, per_minute: float = 130) -> DataFrame:
    """X-4. Sentences packed into chunks of at most so many words (pos, chunk, words, minutes); a longer sentence is one chunk."""
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    rows = df.select("*", F.posexplode(_packed(_parts(F.col(text), r"(?<=[.!?])\s+"), most, words)).alias("pos", "chunk"))
    return rows.withColumn("words", words(F.col("chunk"))).withColumn("minutes", F.round(F.col("words") / per_minute, 3))


def chunk_by_chars(df: DataFrame, text: str = "text", most: int = 300) -> DataFrame:
    """X-5. Sentences packed into chunks of at most so many characters; a short text is one chunk as it stands."""
    chunks = F.when(F.char_length(text) <= most, F.array(F.col(text))).otherwise(_packed(_parts(F.col(text), r"(?<=[.!?])\s+"), most, F.char_length))
    return df.select("*", F.posexplode(chunks).alias("pos", "chunk"))


#: Marks that end a caption group wherever they stand in a word.
GROUP_MARKS = "?,.、;:!…？，。；：！"


def caption_groups(words: DataFrame, by: list[str], order: str, most_words: int = 4, most_chars: int = 40, most_lines: int = 2) -> DataFrame:
    """X-6. Timed words in caption groups; a group ends with a punctuated word, at a number of words, or once its text with
    a blank behind each word is longer than its lines. Blank words are skipped."""
    bare = lambda w: F.regexp_replace(w, r"^\s+|\s+$", "")
    kinds = {c: words.schema[c].dataType.simpleString() for c in ("start", "end", "word")}
    empty = F.array().cast(f"array<struct<start: {kinds['start']}, end: {kinds['end']}, text: {kinds['word']}>>")
    cells = lambda acc: F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["text"].alias("text"))
    fresh = [F.lit(0).alias("n"), F.lit(0).alias("size"), *(F.lit(None).cast(kinds[c]).alias(n) for c, n in (("start", "start"), ("end", "end"), ("word", "text")))]

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] >= most_words) | (acc["size"] > most_chars * most_lines) | acc["ended"]
        keep = lambda new, old: F.when(full, new).otherwise(old)
        return F.struct(
            keep(F.concat(acc["done"], F.array(cells(acc))), acc["done"]).alias("done"), (keep(F.lit(0), acc["n"]) + 1).alias("n"), (keep(F.lit(0), acc["size"]) + F.char_length(bare(x["word"])) + 1).alias("size"),
            F.least(keep(F.lit(None), acc["start"]), x["start"]).alias("start"), F.greatest(keep(F.lit(None), acc["end"]), x["end"]).alias("end"),
            F.concat_ws(" ", keep(F.lit(None).cast("string"), acc["text"]), x["word"]).alias("text"), x["word"].rlike(f"[{GROUP_MARKS}]").alias("ended"),
        )

    start = F.struct(empty.alias("done"), *fresh, F.lit(False).alias("ended"))
    rows = words.where(bare(F.col("word")) != "").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, "word", "start", "end"))).alias("__w"))
    groups = F.aggregate("__w", start, step, lambda acc: F.concat(acc["done"], F.array(cells(acc))))
    return rows.select(*by, F.posexplode(groups).alias("group", "__g")).select(*by, "group", F.round("__g.start", 3).alias("start"), F.round("__g.end", 3).alias("end"), "__g.text")


def phrase_groups(df: DataFrame, units: str = "units") -> DataFrame:
    """X-7. Phrases of an array of spoken units, in order (pos, phrase): short units are grouped, up to a mark that ends a
    sentence, a comma behind the fourth or the eighth unit; units that are long on average stay as they are."""
    array = F.coalesce(F.col(units), F.array().cast("array<string>"))
    size = F.aggregate(array, F.lit(0), lambda n, x: n + F.char_length(x))

    def step(acc: Column, x: Column) -> Column:
        n, text = acc["n"] + 1, F.concat_ws(" ", acc["open"], x)
        ends = x.rlike(r"[.!?。！？]\s*$") | (n >= 8) | (x.rlike(r"[,，]\s*$") & (n >= 4))
        phrase = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+([,.!?。，！？])", "$1")
        return F.struct(F.when(ends, F.concat(acc["done"], F.array(phrase))).otherwise(acc["done"]).alias("done"), F.when(ends, F.lit(None)).otherwise(text).alias("open"), F.when(ends, F.lit(None)).otherwise(phrase).alias("last"), F.when(ends, 0).otherwise(n).alias("n"))

    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"), none.alias("last"), F.lit(0).alias("n"))
    grouped = F.aggregate(array, start, step, lambda acc: F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    return df.select("*", F.posexplode(F.when(size >= 15 * F.size(array), array).otherwise(grouped)).alias("pos", "phrase"))


def recognised_segments_to_cues(words: DataFrame, by: list[str], order: str) -> DataFrame:
    """X-8. Cues that end with a word that holds a mark anywhere; the cue's last character is dropped, its span is kept.

    Words carry their own blanks and are joined as they are; a cue is stripped, and a blank one gives no row. A cue that the drop leaves
    empty passes its start on to the next one, but at a segment's begin only to one whose first word has a mark too.
    The break depends on the word alone, so cue numbers are a running sum.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = words.withColumn("__b", F.col("word").rlike(f"[{GROUP_MARKS}]").cast("int")).withColumn("cue", F.coalesce(F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda x: x["word"]), "")
    cues = rows.groupBy(*by, "cue").agg(F.min_by("start", order).alias("__s"), F.max_by("end", order).alias("end"), text.alias("text"), F.max("__b").alias("__b"), F.count("*").alias("__n"))
    cues = cues.withColumn("text", F.when(F.col("__b") == 1, F.expr("left(text, char_length(text) - 1)")).otherwise(F.col("text")))
    c = Window.partitionBy(*by).orderBy("cue")
    cues = cues.withColumn("__full", (F.col("text") != "").cast("int"))
    cues = cues.withColumn("__part", F.coalesce(F.sum("__full").over(c.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.first("__s").over(Window.partitionBy(*by, "__part").orderBy("cue"))
    first = F.when((F.col("__part") == 0) & ((F.col("__n") > 1) | (F.col("__b") == 0)), F.col("__s")).otherwise(first)
    cues = cues.withColumn("__first", first).withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("__full = 1 and text <> ''")
    return cues.select(*by, F.row_number().over(c).alias("cue_idx"), F.round("__first", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def parse_terms(df: DataFrame, reply: str = "reply", subject: str = "subject") -> DataFrame:
    """X-9. Search terms from a JSON array, else from the first bracketed part, else from a comma list, else the subject."""
    text = F.coalesce(F.col(reply), F.lit(""))
    array = lambda c: F.from_json(c, "array<string>")
    listed = _parts(text, "[,，]")
    terms = F.coalesce(F.when(F.trim(text).startswith("["), array(text)), array(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))), F.when(F.size(listed) > 0, listed), F.array(F.col(subject)))
    return df.withColumn("terms", F.filter(F.transform(terms, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def clean_script(df: DataFrame, text: str = "text", out: str = "clean") -> DataFrame:
    """X-10. Without * and #, and without what stands between the first opening and the last closing bracket of a line."""
    c = F.regexp_replace(F.col(text), "[*#]", "")
    return df.withColumn(out, F.regexp_replace(F.regexp_replace(c, r"\[.*\]", ""), r"\(.*\)", ""))


def _bare_reply(reply: str) -> Column:
    """A reply without white space and then quotes at its ends; empty for an error reply."""
    c = F.coalesce(F.col(reply), F.lit(""))
    c = F.when(c.startswith("Error:"), F.lit("")).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(c, '^"+|"+$', ""), "^'+|'+$", "")


def _first_line(text: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(text, "\n"), 1), r"(?U)^\s+|\s+$", "")


def _space_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def hook_validity(df: DataFrame, hook: str = "hook", subject: str = "subject") -> DataFrame:
    """X-11. hook_text: the reply's first line in capitals if it is 10 to 80 characters, else the subject's first five words in
    capitals; from_reply says which. phrase: the first line as it stands if it has 3 to 12 words, else the subject; phrase_ok says which.

    Quotes and white space around a reply go before its line is taken. A reply that begins with "Error:" is none.
    """
    line = _first_line(F.upper(_bare_reply(hook)))
    term = _first_line(_bare_reply(hook))
    about = F.coalesce(F.col(subject), F.lit(""))
    valid, fits = F.char_length(line).between(10, 80), F.size(_space_words(term)).between(3, 12)
    fallback = F.array_join(F.slice(_space_words(F.upper(about)), 1, 5), " ")
    phrase = F.when(fits, term).otherwise(F.regexp_replace(about, r"(?U)^\s+|\s+$", ""))
    return df.withColumns({"hook_text": F.when(valid, line).otherwise(fallback), "from_reply": valid, "phrase": phrase, "phrase_ok": fits})


#: Numbers, terms and contractions as they are to be spoken, in the order in which they are replaced.
SPOKEN_TERMS = (
    ("150-300", "one hundred fifty to three hundred"), ("75-150", "seventy five to one hundred fifty"), ("150", "one hundred fifty"), ("300", "three hundred"),
    ("75", "seventy five"), ("6-7", "six to seven"), ("30", "thirty"), ("5", "five"), ("2", "two"),
    ("metabolism", "how your body burns calories"), ("antioxidants", "healthy compounds"), ("quinoa", "healthy grains"), ("cardiovascular", "heart and blood vessel"),
    ("World Health Organization", "health experts"), ("vigorous cardio", "intense exercise"), ("moderate cardio", "gentle exercise"),
    ("strengthening activities", "muscle building exercises"), ("resistance bands", "exercise bands"), ("complex carbs", "healthy carbs"),
    ("you're", "you are"), ("don't", "do not"), ("let's", "let us"), ("when's", "when is"), ("that's", "that is"), ("it's", "it is"),
)


def spoken_terms(spark: SparkSession) -> DataFrame:
    """The table (ord, term, spoken) of ``SPOKEN_TERMS``."""
    return spark.createDataFrame([(n, *x) for n, x in enumerate(SPOKEN_TERMS)], "ord int, term string, spoken string")


def normalise_for_speech(df: DataFrame, text: str = "text", terms: DataFrame | None = None, most: int = 120, out: str = "spoken") -> DataFrame:
    """X-12. One blank for white space, the dictionary's terms replaced (``dictionary.replace_terms``; ``spoken_terms`` unless
    given), repeated ! ? and . once, and sentences over the limit cut at ", " into sentences that end with a full stop."""
    rows = df.withColumn(out, F.regexp_replace(F.regexp_replace(F.col(text), r"(?U)\s+", " "), "^ | $", ""))
    rows = replace_terms(rows, out, spoken_terms(df.sparkSession) if terms is None else terms, out)
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(out), "!!+", "!"), r"\?\?+", "?"), r"\.\.+", ".")

    def cut(s: Column) -> Column:
        body, mark = F.regexp_replace(s, "[.!?]$", ""), F.regexp_extract(s, "[.!?]$", 0)
        parts = F.split(body, ", ")
        n = F.size(parts)
        whole = F.concat(F.array_join(F.transform(F.slice(parts, 1, n - 1), lambda p: F.concat(F.trim(p), F.lit("."))), " "), F.lit(" "), F.element_at(parts, -1), mark)
        return F.when((F.char_length(body) > most) & (mark != "") & (n > 1), whole).otherwise(s)

    sentences = F.transform(F.regexp_extract_all(c, F.lit("[^.!?]*[.!?]|[^.!?]+"), F.lit(0)), cut)
    return rows.withColumn(out, F.trim(F.regexp_replace(F.array_join(sentences, " "), r"(?U)\s+", " ")))


def number_words(n: int) -> str:
    """0 to 999 in words."""
    if n < 20:
        return SMALL_NUMBERS[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{SMALL_NUMBERS[n % 10]}" if n % 10 else "")
    return f"{SMALL_NUMBERS[n // 100]} hundred" + (f" {number_words(n % 100)}" if n % 100 else "")


def spell_numbers(df: DataFrame, text: str = "text", out: str = "spelled") -> DataFrame:
    """X-13. Whole numbers between word boundaries: up to 999 in words, by a map literal of a thousand entries, larger ones without leading zeros."""
    spoken = F.create_map(*(F.lit(x) for n in range(1000) for x in (str(n), number_words(n))))
    plain = lambda w: F.regexp_replace(w, "^0+(?=.)", "")
    tokens = F.transform(F.split(F.col(text), r"(?U)\b(?=[0-9])|(?<=[0-9])\b"), lambda w: F.when(w.rlike("^[0-9]+$"), F.coalesce(F.try_element_at(spoken, plain(w)), plain(w))).otherwise(w))
    return df.withColumn(out, F.array_join(tokens, ""))


def wrap_list(text: str, most_chars: int = 40, most_lines: int = 2) -> list[str]:
    """X-14 for one caption: lines of whole words, commas left out. A comma ends a line that is over 60 % full; what
    doesn't fit the lines is left out; then a line under 70 % takes the next line's first word if it has room for it."""
    lines, held = [], ""
    for phrase in (p.split() for p in text.split(",") if p.strip()):
        for w in phrase:
            fits = len(held) + len(w) + bool(held) <= most_chars
            if not fits:
                lines.append(held or w)
                held = w if held else ""
                if len(lines) >= most_lines:
                    break
            else:
                held = f"{held} {w}" if held else w
        if len(held) > 0.6 * most_chars:
            lines.append(held)
            held = ""
            if len(lines) >= most_lines:
                break
    if held and len(lines) < most_lines:
        lines.append(held)
    for i in range(len(lines) - 1):
        first, _, rest = lines[i + 1].partition(" ")
        if rest and len(lines[i]) < 0.7 * most_chars and len(lines[i]) + 1 + len(first) <= most_chars:
            lines[i], lines[i + 1] = f"{lines[i]} {first}", rest
    return lines


def wrap_lines(df: DataFrame, text: str = "text", most_chars: int = 40, most_lines: int = 2) -> DataFrame:
    """X-14. Lines of a caption in order (pos, line)."""
    return _exploded(df, text, lambda t: wrap_list(t, most_chars, most_lines), "line")


def bracket_strip(df: DataFrame, text: str = "text", out: str = "bare") -> DataFrame:
    """X-15. Brackets become blanks."""
    return df.withColumn(out, F.trim(F.translate(F.col(text), "[](){}", "      ")))


def format_time(seconds: Column) -> Column:
    """X-16. HH:MM:SS,mmm; milliseconds are cut, not rounded."""
    ms = F.floor(F.round(seconds * 1000, 6)).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("bigint"), F.floor(ms / 60_000).cast("bigint") % 60, F.floor(ms / 1000).cast("bigint") % 60, ms % 1000)


def parse_time(text: Column) -> Column:
    """X-16. Milliseconds of HH:MM:SS,mmm."""
    part = lambda n: F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)", n).cast("bigint")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def transcript_overlap(df: DataFrame, script: str = "script", transcript: str = "transcript") -> DataFrame:
    """A-9. Shared different words over all words of the script, with a verdict."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "")
    share = F.size(F.array_intersect(words(script), words(transcript))) / F.greatest(F.lit(1), F.size(words(script)))
    return df.withColumns({"overlap": F.round(share, 6), "verdict": F.when(share < 0.1, "fail").when(share < 0.3, "warn").otherwise("ok")})


def levenshtein_similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """J-7. 1 - edit distance / longer length in lower case; null where both are empty."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return df.withColumn(out, F.when(longer > 0, F.round(1 - F.levenshtein(F.lower(F.col(a)), F.lower(F.col(b))) / longer, 6)))


#: Characters of candidates that one pass compares a line with; a longer candidate is a pass of its own.
AT_ONCE = 1 << 14


class Lanes:
    """Levenshtein distances of a text to many others in one pass: these stand side by side in one whole number, a bit apart.

    The steps are those of ``Distances``, each for all of the others together. What an addition carries out of a text ends in the
    bit behind it, and what a shift brings from there into the next text is set in its first bit anyway; that bit is cleared
    in ``up``, from which alone carries come. The last column's differences add up to the distance.
    """

    def __init__(self, others: list[str]):
        sizes = np.array([len(x) for x in others])
        self.codes = np.frombuffer("".join(f"{x}\0" for x in others).encode("utf-32-le"), np.uint32)
        self.ends = np.cumsum(sizes + 1) - 1
        inside, first = np.ones(len(self.codes), bool), np.zeros(len(self.codes), bool)
        inside[self.ends], first[self.ends - sizes] = False, True
        self.full, self.first, self.at = self._whole(inside), self._whole(first & inside), {}

    @staticmethod
    def _whole(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def _bits(self, whole: int) -> np.ndarray:
        n = len(self.codes)
        return np.unpackbits(np.frombuffer(whole.to_bytes(n + 7 >> 3, "little"), np.uint8), count=n, bitorder="little").astype(np.int64)

    def distances(self, text: str) -> np.ndarray:
        at, full, first = self.at, self.full, self.first
        for y in set(text) - at.keys():
            at[y] = self._whole(self.codes == ord(y))
        up, down = full, 0
        for y in text:
            same = at[y] | down
            diagonal = (((same & up) + up) ^ up) | same
            right_up, right_down = (down | (full ^ (diagonal | up))) << 1 | first, (diagonal & up) << 1
            up = (right_down | (full ^ (diagonal | right_up))) & full
            down = diagonal & right_up
        upto = np.cumsum(self._bits(up) - self._bits(down & full))[self.ends]
        return len(text) + np.diff(upto, prepend=0)


def best_fuzzy_match(left: DataFrame, right: DataFrame, by: str, a: str, b: str, at_once: int = AT_ONCE) -> DataFrame:
    """J-7. The most similar candidate of each line among those of its key, the larger text of equal ones; null without any.

    Every line is compared with every candidate. A key's candidates are dealt over blocks of about ``at_once`` characters, by
    a running sum of their lengths, and its lines go to each of them: a task holds one block at a time, and a line's distances
    to it are one pass. A block gives its best only.
    """
    row = lambda df, c, is_line: df.where(f"`{by}` is not null and `{c}` is not null").select(by, F.lit(is_line).alias("is_line"), F.col(c).alias("text"), F.lit(0).alias("n") if is_line else (F.char_length(F.lower(c)) + 1).alias("n"))
    # lines stand behind all candidates, so the sum there is that of all
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("is_line", "n", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    block = lambda n: F.floor((upto - n) / at_once)
    rows = row(right, b, False).union(row(left, a, True).distinct()).withColumn("block", F.when(F.col("is_line"), F.sequence(F.lit(0).cast("bigint"), block(F.lit(0)))).otherwise(F.array(block(F.col("n")))))
    rows = rows.select(by, F.explode("block").alias("block"), "is_line", "text").repartition(by, "block").sortWithinPartitions(by, "block", "is_line")
    rows = rows.select(by, "block", "is_line", "text", F.lower("text").alias("low"))
    schema = T.StructType([rows.schema[by], T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("distance", T.IntegerType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, lanes, sizes = None, [], None, None
        for batch in batches:
            out = []
            for key, n, is_line, text, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, n) != last:
                    last, texts, lanes = (key, n), {}, None
                if not is_line:
                    texts[text] = low
                    continue
                if not texts:
                    continue
                if lanes is None:
                    lanes, sizes = Lanes(list(texts.values())), np.array([len(x) for x in texts])
                distances, longer, others = lanes.distances(low), np.maximum(sizes, len(text)), list(texts)
                share = np.where(longer > 0, 1 - distances / np.maximum(longer, 1), -np.inf)
                # the figure is rounded to six places later: what could then be equal to the best stays
                best: dict = {}
                for j in np.flatnonzero(share >= share.max() - 2e-6):
                    best[share[j]] = max(best.get(share[j], (others[j], distances[j])), (others[j], distances[j]))
                out += [(key, text, other, int(distance)) for other, distance in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate((batch.schema.field(0).type, pa.string(), pa.string(), pa.int32()))], names=schema.names)

    longer = F.greatest(F.char_length("a"), F.char_length("b"))
    similarity = F.when(longer > 0, F.round(1 - F.col("distance") / longer, 6))
    found = rows.mapInArrow(compare, schema).select(by, F.col("a").alias(a), F.struct(similarity.alias("similarity"), F.col("b").alias(b)).alias("m"))
    found = left.select(by, a, F.lit(None).cast(found.schema["m"].dataType).alias("m")).unionByName(found).groupBy(by, a).agg(F.max("m").alias("m"))
    return found.select(by, a, F.col(f"m.{b}").alias(b), F.col("m.similarity").alias("similarity"))


def lexicon_tag_words(words: DataFrame, lexicon: DataFrame, shock_words: list[str], word: str = "word") -> DataFrame:
    """J-9. The first dictionary entry (by ord) of each word's letters, and whether it is a shock word."""
    rows = words.withColumn("__w", F.lower(F.regexp_replace(F.col(word), r"[^\p{L}]", "")))
    first = lexicon.groupBy(F.lower("key").alias("__w")).agg(F.min_by("sticker", "ord").alias("sticker"))
    return rows.join(first, "__w", "left").withColumn("is_shock", F.col("__w").isin(shock_words)).drop("__w")


def fragment_to_sentence(fragments: DataFrame, sentences: DataFrame, by: str) -> DataFrame:
    """J-2. Each fragment's middle word lies in the first sentence that ends there or later, else in the last one.

    Both sides carry running word counts per script and are one ordered stream, as in J-3: two windows, no join. A script
    without sentences has no rows.
    """
    count = lambda c: F.size(F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda w: w != ""))
    upto = lambda order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = fragments.withColumn("__n", count("fragment")).withColumn("__at", (F.sum("__n").over(upto("frag_idx")) - F.col("__n") / 2).cast("double"))
    s = sentences.withColumn("__at", F.sum(count("sentence")).over(upto("sent_idx")).cast("double"))
    # one ordered stream of fragments, at their middles, and sentences, at their ends
    said = F.struct("sent_idx", "sentence", "prompt")
    f = f.select(by, "__at", F.lit(0).alias("__kind"), F.col("frag_idx").alias("__order"), F.struct("frag_idx", "fragment").alias("__f"), F.lit(None).cast(s.select(said.alias("x")).schema["x"].dataType).alias("__s"))
    s = s.select(by, "__at", F.lit(1).alias("__kind"), F.col("sent_idx").alias("__order"), F.lit(None).cast(f.schema["__f"].dataType).alias("__f"), said.alias("__s"))
    w = Window.partitionBy(by).orderBy("__at", "__kind", "__order")
    here = F.first("__s", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    last = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = f.unionByName(s).withColumn("__s", F.coalesce(here, last)).where("__kind = 0 and __s is not null")
    evidence = F.coalesce(F.nullif(F.trim("__s.prompt"), F.lit("")), F.col("__s.sentence"))
    return hit.select(by, "__f.frag_idx", "__f.fragment", "__s.sent_idx", evidence.alias("evidence"))


def caption_line_match(units: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """J-5. Spoken units that add up to the script's lines; only scripts all of whose lines are met.

    The loosest tier compares what is left without non-word characters, so units and lines meet where the running
    lengths of that text are equal (an equi-join) and the texts between two such points agree. The tightest tier gives the text.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.col(c)), r"(?U)[\W_]+", "")
    upto = lambda order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = units.withColumn("__b", bare("unit")).withColumn("__len", F.sum(F.char_length("__b")).over(upto("unit_idx")))
    l = lines.withColumn("__b", bare("line")).withColumn("__end", F.sum(F.char_length("__b")).over(upto("line_idx")))  # noqa: E741
    nth = lambda end, order: F.row_number().over(Window.partitionBy(by, end).orderBy(order))
    l = l.withColumn("__nth", nth("__end", "line_idx"))  # noqa: E741  # a line without words ends where the one before it does
    marks = u.select(by, F.col("__len").alias("__end"), nth("__len", "unit_idx").alias("__nth"), F.col("unit_idx").alias("last_unit"), "end")
    met = l.join(marks, [by, "__end", "__nth"])
    # units and ends of lines as one ordered stream: a unit belongs to the first line that ends with it or later
    line = F.struct("line_idx", "line", "__b", "end")
    ends = met.select(by, F.col("last_unit").alias("__at"), F.lit(1).alias("__kind"), line.alias("__l"), *(F.lit(None).cast(u.schema[c].dataType).alias(c) for c in ("unit", "start")), F.lit(None).cast("string").alias("__ub"))
    inside = u.select(by, F.col("unit_idx").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(ends.schema["__l"].dataType).alias("__l"), "unit", "start", F.col("__b").alias("__ub"))
    ahead = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    parts = inside.unionByName(ends).withColumn("__l", F.first("__l", ignorenulls=True).over(ahead)).where("__kind = 0 and __l is not null")
    parts = parts.select(by, "__l.*", F.col("__at").alias("unit_idx"), "unit", "__ub", F.col("start").alias("us"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", c))), lambda x: x[c]), "")
    got = parts.groupBy(by, "line_idx", "line", "__b", "end").agg(text("__ub").alias("__said"), text("unit").alias("said"), F.min("us").alias("start")).where("__said = __b")
    plain = lambda c: F.regexp_replace(F.col(c), r"\p{Punct}", "")
    chosen = F.when(F.col("said") == F.col("line"), F.col("line")).when(plain("said") == plain("line"), plain("line")).otherwise(F.col("line"))
    every = Window.partitionBy(by)
    want = lines.groupBy(by).agg(F.count("*").alias("__want"))
    got = got.withColumn("__got", F.count("*").over(every)).join(want, by).where("__got = __want")
    return got.select(by, "line_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.trim(chosen).alias("text"))


class Distances:
    """Levenshtein distances of one text to others that grow: what was read of another text is kept as bits of two whole numbers.

    Each step reads a character more, whatever was read before, so a text that grows by a cue costs that cue alone.
    """

    def __init__(self, text: str):
        self.size, self.at = len(text), {}
        for i, x in enumerate(text):
            self.at[x] = self.at.get(x, 0) | 1 << i
        self.full, self.top = (1 << self.size) - 1, 1 << max(0, self.size - 1)

    def start(self) -> tuple[int, int, int]:
        """What is known of the empty text; the last part is the distance."""
        return self.full, 0, self.size

    def read(self, known: tuple[int, int, int], more: str) -> tuple[int, int, int]:
        """What is known of a text with more characters behind it."""
        up, down, distance = known
        if not self.size:
            return up, down, distance + len(more)
        at, full, top = self.at, self.full, self.top
        for y in more:
            same = at.get(y, 0) | down
            diagonal = (((same & up) + up) ^ up) | same
            right_up, right_down = down | (~(diagonal | up) & full), up & diagonal
            distance += bool(right_up & top) - bool(right_down & top)
            right_up = (right_up << 1 | 1) & full
            up = (right_down << 1 & full) | (~(diagonal | right_up) & full)
            down = right_up & diagonal
        return up, down, distance


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of two texts."""
    d = Distances(a)
    return d.read(d.start(), b)[2]


def _share(distance: int, n: int, m: int) -> float:
    return 1 - distance / max(n, m) if n or m else 1.0


def _in_order(few: str, many: str) -> bool:
    """Whether all characters of one text stand in the other, in their order."""
    rest = iter(many)
    return all(map(partial(contains, rest), few))


def _least_distance(a: str, b: str) -> int:
    """Edits that two texts need at least, by the characters that one has more often than the other."""
    a, b = Counter(a), Counter(b)
    return max((a - b).total(), (b - a).total())


def _followed(line: str, cues: list[str], threshold: float) -> tuple[int, str]:
    """How many cues a line takes, and its verdict: following cues are merged while that brings them closer to the line.

    A cue that only lacks characters of the line (marks, mostly), or has some more, is as far from it as their lengths are.
    Character by character it is read where that isn't so, and where neither lengths nor characters rule a merge out.
    """
    if cues[0] == line:
        return 1, "exact"
    target = line.lower()
    known, text, used = None, cues[0], 1
    whole = "Σ" in text  # the one letter whose small form depends on what follows
    read = text.lower()
    size, wanted = len(read), len(target)
    few, many = (read, target) if size < wanted else (target, read)
    if read == target or (size != wanted and _in_order(few, many)):
        distance = abs(size - wanted)
    else:
        d = Distances(target)
        known = d.read(d.start(), read)
        distance = known[2]
    score = _share(distance, size, wanted)
    while text != line and used < len(cues):
        more = f" {cues[used]}"
        whole = whole or "Σ" in more
        added = more.lower()
        if whole:
            read = (text + more).lower()
            longer = len(read)
        else:
            longer = size + len(added)
        if _share(abs(longer - wanted), longer, wanted) <= score:  # what the lengths allow at most
            break
        if known is None:
            if _share(_least_distance(read if whole else read + added, target), longer, wanted) <= score:
                break
            d = Distances(target)
            known = d.read(d.start(), text.lower())
        trial = d.read(d.start(), read) if whole else d.read(known, added)
        better = _share(trial[2], longer, wanted)
        if better <= score:
            break
        text, known, size, score, used = text + more, trial, longer, better, used + 1
    return used, "exact" if text == line else "corrected" if score > threshold else "mismatch"


#: Cues that are looked at first for one line; a line that takes them all is followed to the end.
AT_MOST = 64


def caption_correction(cues: DataFrame, lines: DataFrame, by: str, threshold: float = 0.8) -> DataFrame:
    """J-6. Cues rewritten as script lines: equal, or following cues are merged while that brings them closer.

    A line's span is that of its merged cues. Lines left over take the next cue's time or 0; cues left over are dropped.
    Cues and lines of a script are one ordered stream, cues first: a task holds the cues of one script at a time, and scripts
    cost no group of their own.
    """
    no = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    heard = cues.select(by, F.lit(False).alias("is_line"), "cue_idx", no(lines, "line_idx"), F.col("start").cast("double"), F.col("end").cast("double"), "text")
    script = lines.select(by, F.lit(True), no(cues, "cue_idx"), "line_idx", F.lit(None).cast("double"), F.lit(None).cast("double"), "line")
    rows = heard.union(script).repartition(by).sortWithinPartitions(by, "is_line", F.col("cue_idx").asc_nulls_last(), F.col("line_idx").asc_nulls_last()).drop("cue_idx", "line_idx")
    schema = T.StructType([rows.schema[by], T.StructField("line_idx", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("verdict", T.StringType())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, spans, i, n = object(), [], [], 0, 0
        for batch in batches:
            out = []
            for key, is_line, start, end, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, texts, spans, i, n = key, [], [], 0, 0
                if not is_line:
                    texts.append(text)
                    spans.append((start, end))
                    continue
                if i >= len(texts):
                    out.append((key, n, 0.0, 0.0, text, "extra"))
                else:
                    used, verdict = _followed(text, texts[i : i + AT_MOST], threshold)
                    if used == AT_MOST:  # a line of very many cues
                        used, verdict = _followed(text, texts[i:], threshold)
                    out.append((key, n, spans[i][0], spans[i + used - 1][1], text, verdict))
                    i += used
                n += 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=schema.names)

    return rows.mapInArrow(align, schema)


def layout_list(words: list[str], lines: list[str]) -> list[tuple[int, int, int]]:
    """J-10 for one caption: (word number, line, position). Each word of the lines takes the next timed word that is equal
    without marks and case; timed words in between are passed over for good."""
    bare = lambda w: re.sub("[.,!?]", "", w).strip().lower()
    timed, out = iter(enumerate(words)), []
    for n, line in enumerate(lines):
        position = 0
        for w in line.split():
            k = next((i for i, t in timed if bare(t) == bare(w)), None)
            if k is not None:
                out.append((k, n, position))
                position += 1
    return out


def caption_word_layout(captions: DataFrame) -> DataFrame:
    """J-10. Line and position of every timed word of a caption (words and lines are arrays)."""

    def run(words: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([[{"word_idx": a, "line": b, "position": c} for a, b, c in layout_list(list(w), list(x))] for w, x in zip(words, lines, strict=True)])

    kind = "array<struct<word_idx: int, line: int, position: int>>"
    rows = captions.withColumn("__l", F.explode(F.pandas_udf(run, kind)("words", "lines")))
    return rows.select(*[c for c in captions.columns if c not in ("words", "lines")], "__l.*")
