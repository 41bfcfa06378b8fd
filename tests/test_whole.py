"""Registered queries run over whole rows and all of them: small tables with long values, against plain replays."""

import random

from cutroom.plans import catalog


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_similarity(a, b):
    a, b = a.lower(), b.lower()
    return 1 - plain_distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def documents(spark, path, texts):
    rows = [(i, t, "fr", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_caption_correction_of_long_lines_and_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = ["\n".join([prose(rng, 150), "...", prose(rng, 120), prose(rng, 3)]), "\n".join(prose(rng, rng.randrange(1, 5)) for _ in range(60))]
    documents(spark, tmp_path, texts)
    want = set()
    for script, text in enumerate(texts):
        lines = text.split("\n")
        heard, i = [x.replace(".", "").replace(",", "") for x in lines], 0
        for n, line in enumerate(lines):
            if i >= len(heard):
                want.add((script, n, 0.0, 0.0, line, "extra"))
                continue
            first, said = i, heard[i]
            while said != line and i + 1 < len(heard) and plain_similarity(f"{said} {heard[i + 1]}", line) > plain_similarity(said, line):
                said, i = f"{said} {heard[i + 1]}", i + 1
            verdict = "exact" if said == line else "corrected" if plain_similarity(said, line) > 0.8 else "mismatch"
            want.add((script, n, first * 2.0, i * 2.0 + 1.5, line, verdict))
            i += 1
    got = catalog.QUERIES["caption_correction"](spark, str(tmp_path)).collect()
    assert len(got) == 64 and {tuple(r) for r in got} == want


def test_best_match_is_found_whatever_its_length(spark):
    """Against all candidates: long lines, no candidate near in length, none at all, ties and nulls."""
    from cutroom.functions import text as x

    rng = random.Random(31)
    left, right = [(9, "alone"), (8, None), (None, "no key")], [(7, "other key"), (8, "b")]
    for d in range(6):
        long = prose(rng, 60)
        left += [(d, long), (d, prose(rng, 4)), (d, long)]
        right += [(d, long[: rng.randrange(len(long) // 2, len(long))]) for _ in range(3)] + [(d, prose(rng, rng.randrange(1, 70))) for _ in range(5)] + [(d, "tie one"), (d, "tie two")]
    got = x.best_fuzzy_match(spark.createDataFrame(left, "k long, a string"), spark.createDataFrame(right, "k long, b string"), "k", "a", "b").collect()
    want = set()
    for k, a in set(left):
        found = [(round(plain_similarity(a, b), 6), b) for k2, b in right if k2 == k and a is not None]
        s, b = max(found, default=(None, None))
        want.add((k, a, b, s))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_caption_lines_without_words_are_met_in_turn(spark):
    from cutroom.functions import text as x

    lines = {1: ["...", "Hello there", "--", "?", "the end"], 2: ["one two", "!", "three"], 3: ["so far", "..."]}
    units = {1: ["...", "Hello", "there", "--", "?", "the", "end"], 2: ["one two", "three"], 3: ["so", "far", "...", "more"]}
    df = lambda rows, name: spark.createDataFrame([(k, i, t, *((i * 2.0, i * 2.0 + 1) if name == "unit" else ())) for k, ts in rows.items() for i, t in enumerate(ts)], f"k long, {name}_idx long, {name} string" + (", start double, end double" if name == "unit" else ""))
    got = {tuple(r) for r in x.caption_line_match(df(units, "unit"), df(lines, "line"), "k").collect()}
    assert got == {(1, 0, 0.0, 1.0, "..."), (1, 1, 2.0, 5.0, "Hello there"), (1, 2, 6.0, 7.0, "--"), (1, 3, 8.0, 9.0, "?"), (1, 4, 10.0, 13.0, "the end"), (3, 0, 0.0, 3.0, "so far"), (3, 1, 4.0, 5.0, "...")}


def test_text_queries_of_every_language_and_length(spark, tmp_path):
    rng = random.Random(9)
    texts = ["\n".join([prose(rng, 90), prose(rng, 80) + " É", prose(rng, 2)]), "Court été\nThe only one, on her", "sin líneas"]
    documents(spark, tmp_path, texts)
    run = lambda name: {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    lines = [t.split("\n") for t in texts]
    assert run("levenshtein_similarity") == {(d, n, round(plain_similarity(a, b), 6)) for d, all_ in enumerate(lines) for n, (a, b) in enumerate(zip(all_, all_[1:]))}
    hooks = [None, None, (chr(34) + texts[2]).upper()]  # of an error, of a whole text of two lines in quotes that is too short, of one quote in the other
    assert {(r[0], r[1], r[2]) for r in run("hook_validity")} == {(d, h or " ".join(texts[d][:90].split()[:5]).upper(), h is not None) for d, h in enumerate(hooks)}
    assert run("risky_claims") == {(0, ""), (1, "her|on|only|the"), (2, "")}


def test_caption_correction_of_one_sided_scripts(spark):
    """A script without cues has its lines left over; cues without a script are dropped."""
    from cutroom.functions import text as x

    cues = spark.createDataFrame([(1, 0, "said", 0.0, 1.0), (2, 0, "heard", 2.0, 3.0)], "k int, cue_idx int, text string, start double, end double")
    lines = spark.createDataFrame([(1, 0, "said"), (3, 0, "silent"), (3, 1, "too")], "k int, line_idx int, line string")
    got = {tuple(r) for r in x.caption_correction(cues, lines, "k").collect()}
    assert got == {(1, 0, 0.0, 1.0, "said", "exact"), (3, 0, 0.0, 0.0, "silent", "extra"), (3, 1, 0.0, 0.0, "too", "extra")}


def test_cues_that_lack_marks_are_not_read_by_character(monkeypatch):
    """Neither where lengths rule the next cue out, nor where its characters do; verdicts are those of a plain replay."""
    from cutroom.functions import text as x

    read, count = x.Distances.read, []
    monkeypatch.setattr(x.Distances, "read", lambda self, known, more: count.append(len(more)) or read(self, known, more))
    rng = random.Random(6)
    line = prose(rng, 700).upper()
    bare = line.replace(".", "").replace(",", "")
    assert x._followed(line, [bare, "xyz", "more"], 0.8) == (1, "corrected") and x._followed(bare, [line, line], 0.8) == (1, "corrected")
    assert x._followed("a, b.", ["a, b.", "c"], 0.8) == (1, "exact") and not count
    for _ in range(2000):
        line, *cues = ("".join(rng.choice("abΣ .,AİÉ") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(2, 6)))
        cues[0] = rng.choice([cues[0], line.replace(".", "").replace(",", ""), line[: rng.randrange(9)]])
        used, said = 1, cues[0]
        while said != line and used < len(cues) and plain_similarity(f"{said} {cues[used]}", line) > plain_similarity(said, line):
            said, used = f"{said} {cues[used]}", used + 1
        assert x._followed(line, cues, 0.8) == (used, "exact" if said == line else "corrected" if plain_similarity(said, line) > 0.8 else "mismatch")


def test_captions_of_many_scripts_are_one_stream(spark):
    """Scripts in any order over all partitions, one of them without a key, more scripts than an Arrow batch has rows."""
    from cutroom.functions import text as x

    n = 12_000
    cues = spark.range(3 * n).selectExpr("nullif(id % 12000, 7) as k", "cast(2 - id div 12000 as int) as cue_idx", "concat('cue ', 2 - id div 12000, case when id % 2 = 0 then '' else '!' end) as text", "double(id) as start", "id + 0.5D as end")
    lines = spark.range(2 * n).selectExpr("nullif(id % 12000, 7) as k", "id div 12000 as line_idx", "concat('cue ', id div 12000) as line").repartition(5)
    df = x.caption_correction(cues, lines, "k")
    assert "CoGroups" not in df._jdf.queryExecution().toString()
    want = {(None if k == 7 else k, i, k + (2 - i) * n * 1.0, k + (2 - i) * n + 0.5, f"cue {i}", "corrected" if k % 2 else "exact") for k in range(n) for i in range(2)}
    assert {tuple(r) for r in df.collect()} == want


def test_lanes_give_the_distances_of_all_at_once():
    from cutroom.functions import text as x

    rng = random.Random(12)
    for _ in range(300):
        letters = rng.choice(["ab", "abc é\0", "abcdefgh 日本語😀"])
        word = lambda n, al=letters: "".join(rng.choice(al) for _ in range(rng.randrange(n)))
        others = [word(rng.choice([1, 3, 70])) for _ in range(rng.randrange(1, 12))]
        lanes = x.Lanes(others)
        for text in (word(40), others[0] + word(9), ""):
            assert list(lanes.distances(text)) == [plain_distance(text, o) for o in others]


def test_best_match_over_blocks_of_any_size(spark):
    """A key's candidates in one block, in many, and longer than a block; letters that grow in lower case are below zero."""
    from cutroom.functions import text as x

    rng = random.Random(13)
    left = [(d, prose(rng, rng.randrange(1, 12))) for d in range(5) for _ in range(4)] + [(6, "x"), (7, "m" * 1600), (8, ""), (9, "none"), (None, "x")]
    right = [(d, prose(rng, rng.randrange(1, 30))) for d in range(5) for _ in range(9)] + [(6, "İ" * 30), (7, "z" + "m" * 1599), (7, "a" + "m" * 1600), (8, ""), (9, None), (None, "x")]
    want = set()
    for k, a in set(left):
        found = [(round(1 - plain_distance(a.lower(), b.lower()) / max(len(a), len(b)), 6) if a or b else None, b) for k2, b in right if k2 == k and None not in (k, b)]
        s, b = max(found, default=(None, None), key=lambda f: (f[0] if f[0] is not None else -9, f[1] or ""))
        want.add((k, a, b, s))
    assert (6, "x", "İ" * 30, -1.0) in want and (7, "m" * 1600, "z" + "m" * 1599, 0.999375) in want and (9, "none", None, None) in want
    run = lambda **kw: {tuple(r) for r in x.best_fuzzy_match(spark.createDataFrame(left, "k long, a string"), spark.createDataFrame(right, "k long, b string"), "k", "a", "b", **kw).collect()}
    assert run() == want
    assert all(run(at_once=n) == want for n in (1, 20, 150))
