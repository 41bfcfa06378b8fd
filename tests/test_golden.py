"""Cases worked out by hand for dictionaries, hooks, cues, renditions, sidecars, spans, periods and loops."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cutroom.functions import dictionary
from cutroom.functions import text as x
from cutroom.operators import timeline
from cutroom.sources import readers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def texts(spark, *values, names="text string"):
    return spark.createDataFrame([(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values)], "id int, " + names)


# --- dictionaries

TERMS = [(0, "new york city", "the city"), (1, "new york", "the state"), (2, "york", "a town"), (3, "it's", "it is"), (4, "5", "five"), (4, "", "nothing"), (5, None, "x"), (6, "York", "never"), (7, "été", "summer"), (8, "gone", None)]


@pytest.mark.parametrize("at_once", [1, 2, 1000])
def test_terms_in_order(spark, at_once):
    terms = spark.createDataFrame(TERMS, "ord int, term string, spoken string")
    df = texts(spark, "New York City, new york; York. Yorkshire", "IT'S 5, 55 or 5!", None, "", "L'ÉTÉ étés été", "gone gone", "İ york İ5 5", "no term")
    got = {r["id"]: r["out"] for r in dictionary.replace_terms(df, "text", terms, "out", at_once).collect()}
    assert got == {0: "the city, the state; a town. Yorkshire", 1: "it is five, 55 or five!", 2: None, 3: "", 4: "L'summer étés summer", 5: " ", 6: "İ a town İ5 five", 7: "no term"}


def test_terms_equal_one_replacement_after_the_other(spark):
    """Against regular expressions in order, where what is put in holds no term."""
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "aa bb", "bb cc aa", "cc-aa", "dd"]
    terms = sorted({w for w in words for _ in range(2)}, key=lambda w: (-len(w), w))
    table = spark.createDataFrame([(n, w, f"<{n}>") for n, w in enumerate(terms)], "ord int, term string, spoken string")
    values = ["".join(rng.choice(["aa", "AA", "bb", "cc", "dd", "ee", " ", " ", "-", ", ", "x"]) for _ in range(40)) for _ in range(60)]
    got = {r["id"]: r["out"] for r in dictionary.replace_terms(texts(spark, *values), "text", table, "out").collect()}
    for n, t in enumerate(values):
        for k, w in enumerate(terms):
            t = re.sub(rf"\b{re.escape(w)}\b", chr(0xE000 + k), t, flags=re.IGNORECASE) if not re.search("[-]", w) else t
        assert re.sub("[-]", lambda m: f"<{ord(m[0]) - 0xE000}>", t) == got[n]


def test_speech(spark):
    long = "one two three four five six seven eight, nine ten eleven twelve thirteen fourteen, fifteen sixteen seventeen eighteen nineteen twenty and more"
    df = texts(spark, "you're 150 now", "  Wait...  WHAT??  Don't!!", "75-150 or 150-300; 1500, 6-7", long + "! Short, one. Tail, without end", long, "A vigorous  cardio", None, "")
    got = {r["id"]: r["spoken"] for r in x.normalise_for_speech(df).collect()}
    parts = long.split(", ")
    cut = f"{parts[0]}. {parts[1]}. {parts[2]}"
    cut = re.sub(r"\bfive\b", "five", cut)
    assert got == {0: "you are one hundred fifty now", 1: "Wait. WHAT? do not!", 2: "seventy five to one hundred fifty or one hundred fifty to three hundred; 1500, six to seven", 3: f"{cut}! Short, one. Tail, without end", 4: long, 5: "A intense exercise", 6: None, 7: ""}
    own = spark.createDataFrame([(0, "tail", "end")], "ord int, term string, spoken string")
    assert x.normalise_for_speech(texts(spark, "Tail 5"), terms=own).first()["spoken"] == "end 5"


def test_numbers_beside_marks(spark):
    df = texts(spark, "won 5, then 12.", "3.5 007 1000 0999 v12 12v x_5 (999)", "", None, "é5 5é 21")
    got = {r["id"]: r["spelled"] for r in x.spell_numbers(df).collect()}
    assert got == {0: "won five, then twelve.", 1: "three.five seven 1000 nine hundred ninety-nine v12 12v x_5 (nine hundred ninety-nine)", 2: "", 3: None, 4: "é5 5é twenty-one"}


# --- hooks and cues


def test_hooks(spark):
    df = texts(spark, ("Error: quota exceeded", "the last final of a great player"), ('\n\n"he never lost a final"', "s"), ("'\"short\"'", "one two"), (None, " a b "), ("the moment nobody saw coming\nmore", None), ("x" * 81, None), ("\"'He left'\"", "p q r s t u"), names="hook string, subject string")
    got = rows(x.hook_validity(df), "id", "hook_text", "from_reply", "phrase", "phrase_ok")
    assert got == [
        (0, "THE LAST FINAL OF A", False, "the last final of a great player", False), (1, "HE NEVER LOST A FINAL", True, "he never lost a final", True), (2, "ONE TWO", False, "one two", False),
        (3, "A B", False, "a b", False), (4, "THE MOMENT NOBODY SAW COMING", True, "the moment nobody saw coming", True), (5, "", False, "", False), (6, "P Q R S T", False, "p q r s t u", False),
    ]


def replayed_cues(words):
    """Word by word, as a recogniser's segment is read; starts as they are carried on."""
    out, text, start, open_, counted = [], "", None, False, 0
    for w, a, z in words:
        if not open_:
            start, open_ = a, True
        end, text = z, text + w
        if any(m in w for m in x.GROUP_MARKS):
            text = text[:-1]
            if not text:
                continue
            if text.strip():
                out.append((start, end, text.strip()))
            open_, text = False, ""
        if counted == 0 and words[0][1] < a:
            start = a
        counted += 1
    if text.strip():
        out.append((start, end, text.strip()))
    return out


def test_cues_break_at_marks_anywhere(spark):
    rng = random.Random(8)
    cases = [[" It", "  cost", "  3.5m", " now."], [",", " a", " b."], [",", ",", " a.", " b"], [" a.", ",", " b"], [" ,", " b"], ["."], [" x"]]
    cases += [[rng.choice([",", " ,", " a", " b.", "c", " 3.5", "!", " ", ""]) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    timed = [[(w, n * 1.0, n + 0.5) for n, w in enumerate(c)] for c in cases]
    df = spark.createDataFrame([(k, n, *w) for k, c in enumerate(timed) for n, w in enumerate(c)], "k int, word_idx int, word string, start double, end double")
    got = {}
    for r in x.recognised_segments_to_cues(df, ["k"], "word_idx").orderBy("k", "cue_idx").collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"], r["text"]))
    assert got == {k: want for k, c in enumerate(timed) if (want := replayed_cues(c))}
    assert got[0] == [(0.0, 2.5, "It  cost  3.5"), (3.0, 3.5, "now")]


# --- sources


def test_renditions_by_tiers(spark):
    form = lambda h, codec, url, **more: {"height": h, "codec": codec, "url": url, **more}
    sources = {
        "family first": [form(720, "avc1.64", "a"), form(1080, "vp9", "b")], "only high": [form(2160, "vp9", "c")], "any codec": [form(480, "av01", "d"), form(720, "vp9", "e")],
        "last of equal": [form(720, "avc1", "f"), form(720, "avc1", "g")], "container": [form(1080, "avc1", "h", ext="webm"), form(360, "vp9", "i", ext="mp4")],
        "with sound": [form(2160, "avc1", "j", muxed=False), form(360, "avc1", "k", muxed=True)], "nothing": [form(2160, "avc1", "l", muxed=False)], "none": [], "other container": [form(2160, "vp9", "m", ext="webm", muxed=True)],
    }
    data = [("k", name, n, json.dumps({"entries": [{"url": name, "duration": 100.0, "formats": f}]})) for n, (name, f) in enumerate(sources.items())]
    hits = spark.createDataFrame(data, "k string, term string, term_ord int, body string")
    got = readers.normalize_footage_hits(hits, "k", max_sources=99, clips_per_video=5, max_clips=12)
    assert rows(got, "term", "url", "clips") == [("any codec", "e", 2), ("family first", "a", 5), ("only high", "c", 5)]
    every = {r["term"]: r["url"] for r in readers.normalize_footage_hits(hits, "k", max_sources=99, max_clips=999).collect()}
    assert every == {"family first": "a", "only high": "c", "any codec": "e", "last of equal": "g", "container": "i", "with sound": "k", "other container": "m"}


def test_sidecars_by_place(spark, tmp_path):
    """A moved pair meets; a file without a sidecar has its size and time; one with a broken sidecar too."""
    old, new = tmp_path / "old", tmp_path / "new" / "deep er"
    for folder in (old, new):
        folder.mkdir(parents=True)
    (new / "a.b+c.mp4").write_bytes(b"12345")
    (new / "a.b+c_metadata.json").write_text(json.dumps({"video_path": str(old / "a.b+c.mp4"), "search_term": "goal", "file_size": 7, "created_at": 3.5}, indent=2))
    (old / "a.b+c.mp4").write_bytes(b"1")  # what was left behind has no sidecar
    (old / "é x.JPG").write_bytes(b"123")
    (old / "broken.mp4").write_bytes(b"12")
    (old / "broken_metadata.json").write_text("{")
    os.utime(old / "broken.mp4", (1000, 1000))
    got = {r["path"].removeprefix("file:").replace("//", "").split("/")[-2] + "|" + r["search_term"]: (r["file_size"], r["created_at"]) for r in readers.read_media_sidecars(spark, str(tmp_path), "*.{mp4,JPG}").collect()}
    assert {k: v[0] for k, v in got.items()} == {"deep%20er|goal": 7, "old|a.b+c": 1, "old|é x": 3, "old|broken": 2}
    assert got["deep%20er|goal"][1] == 3.5 and got["old|broken"][1] == 1000.0


# --- timelines


def test_highlights_by_whole_words(spark):
    captions = spark.createDataFrame([(1, 0, 0.0, 4.0, "The cat ran"), (1, 1, 4.0, 6.0, "no words"), (2, 0, 1.0, 2.0, "late"), (3, 0, 1.0, 1.0, "nothing")], "s int, c0 int, start double, end double, text string")
    words = spark.createDataFrame(
        [(1, 0, 2, "a", 1.0, 2.0, "t"), (1, 0, 1, "the ", 0.0, 0.5, "t"), (1, 0, 3, "RAN", 2.0, 9.0, "t"), (1, 0, 4, " ", 3.0, 3.5, "t"), (2, 0, 0, "late", 5.0, 6.0, "t")], "s int, c0 int, word_idx int, word string, start double, end double, text string"
    )
    got = rows(timeline.highlight_spans(captions, words, "s", "c0"), "s", "c0", "from", "to", "kind", "token")
    assert got == [
        (1, 0, 0.0, 0.5, "highlight", "the"), (1, 0, 0.5, 1.0, "plain", None), (1, 0, 2.0, 4.0, "highlight", "RAN"), (1, 0, 3.5, 4.0, "plain", None), (1, 1, 4.0, 6.0, "plain", None), (2, 0, 1.0, 2.0, "plain", None),
    ]


def test_period_bounds(spark):
    pulse = lambda name, n, step: [(name, i, 10.0 if i % step == 0 else 0.0) for i in range(n)]
    df = spark.createDataFrame(pulse("eight", 8, 4) + pulse("ten", 200, 10) + pulse("five", 100, 5) + pulse("eleven", 11, 4), "k string, idx long, v double")
    got = dict(rows(timeline.dominant_period(df, "k", onset="v"), "k", "bpm"))
    assert got["eight"] is None and got["five"] == 120.0 and got["ten"] != 60.0 and got["eleven"] is not None
    assert {r["bpm"] for r in timeline.dominant_period(df, "k", onset="v", fps=0.5).collect()} == {None}


def test_loops_without_a_cap(spark):
    clips = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("b", 1, 1.0), ("z", 0, 0.0)], "k string, ord int, duration double")
    targets = spark.createDataFrame([("a", 500.0, 500.0), ("b", 4.0, 7.5), ("z", 3.0, 3.0)], "k string, speech_s double, audio_s double")
    got = timeline.loop_fill_to_duration(clips, targets, "k", "ord").groupBy("k").agg(F.count("*").alias("n"), F.sum("duration").alias("s"))
    assert rows(got) == [("a", 500, 500.0), ("b", 5, 8.0), ("z", 1, 0.0)]
    limited = timeline.loop_fill_to_duration(clips, targets, "k", "ord", reuse_limit=2).groupBy("k").count()
    assert rows(limited) == [("a", 2), ("b", 4), ("z", 1)]
    enough = targets.withColumn("speech_s", F.lit(0.0)).where("k <> 'z'")
    assert timeline.loop_fill_to_duration(clips, enough, "k", "ord", strict=True).count() == 3
    with pytest.raises(Exception, match="clips are short"):
        timeline.loop_fill_to_duration(clips, targets, "k", "ord", strict=True).collect()
