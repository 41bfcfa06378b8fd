"""Corpus operators against brute force, round trips and held-out labels, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cutroom.llm import chat, crf, decontaminate, html, jaccard, langid, packing, quality, sharding, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, id long, h string, kept string"


def table(spark, texts, langs=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, langs[n] if langs else "en", 0.5, 7, "x", "y") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


VOCABULARY = [a + b for a in ("ba", "ko", "mi", "ru", "te", "zo", "la", "pe") for b in ("n", "r", "st", "lk", "mp", "d", "ss", "x", "v", "g")]
LONG = "".join(random.Random(1).choice("abcdefgh \n") for _ in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!"), (5, "one"), (5, "one"), (6, LONG), (7, LONG), (None, "no id at all"), (8, "Été ñandú 漢字 😀 end")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# --- language


def test_language(spark, odd, empty):
    rng = random.Random(3)
    left, right = [w for w in VOCABULARY if w[0] in "bkmr"], [w for w in VOCABULARY if w[0] in "tzlp"]
    texts = [(i, words(rng, 30, left if i % 2 else right)) for i in range(200)]
    docs = table(spark, texts, ["aa" if i % 2 else "bb" for i, _ in texts])
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(docs, model).where(langid.held_out()).collect()
    assert got and all(r["lang_pred"] == r["lang"] and 0.99 < r["score"] <= 1 for r in got)
    odd_got = langid.identify(odd, model).collect()
    assert len(odd_got) == len(ODD)
    assert {r["lang_pred"] for r in odd_got if r["text"] is None or not re.search(r"[^\W\d_]", r["text"])} == {"und"}
    assert all(r["lang_pred"] in ("aa", "bb") for r in odd_got if r["doc_id"] in (5, 6, 8))
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_language_is_naive_bayes(spark):
    docs = table(spark, [(1, "abab ba"), (2, "cdcd dc")], ["x", "y"])
    langs, logp, orders, bits = langid.fit(docs)
    points, offs = langid._letters_only(["ab dc", "zz"])
    sums = np.zeros((2, 2))
    for bucket, row in langid._grams(points, offs, orders, bits):
        for b, r in zip(bucket, row):
            sums[r] += logp[b]
    got = langid.identify(table(spark, [(1, "ab dc"), (2, "zz")]), (langs, logp, orders, bits)).orderBy("doc_id").collect()
    for r, s in zip(got, sums):
        assert r["lang_pred"] == langs[int(s.argmax())]
        assert r["score"] == pytest.approx(1 / np.exp(s - s.max()).sum(), rel=1e-4)


# --- packing


def test_packing_round_trip(spark, odd, empty):
    rng = random.Random(5)
    docs = table(spark, [*ODD, *((i, words(rng, rng.randrange(1, 900), VOCABULARY)) for i in range(100, 220)), (300, "a <|endoftext|> b, c. 3, x!!, y.")])
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter()
    for r in docs.collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(r["doc_id"], s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    got = packing.pack_documents(docs).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(inside) == list(range(len(inside)))
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=30))
def test_patterns_hold_the_histogram(histogram):
    held = Counter()
    for count, contents in packing.shortest_pack_first(histogram, 64):
        assert sum(n * many for n, many in contents) <= 64
        for n, many in contents:
            held[n] += count * many
    assert held == Counter(histogram)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abT .,!\n'é3_Σ́ ", max_size=60))
def test_word_encoder_is_the_tokenizer(text):
    encoder = packing.WordEncoder.of(packing.tokenizer_file())
    assert encoder.encode([text]) == encoder._whole([text])


# --- repeated substrings


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept))
    return out


@pytest.mark.parametrize(("copies", "at_once"), [(3, suffixes.ROWS_AT_ONCE), (60, suffixes.ROWS_AT_ONCE), (60, 2)])
def test_repeats_are_exact(spark, monkeypatch, copies, at_once):
    """Also with one passage in most documents, so that its keys fill several buckets, and with more rows than a task takes."""
    monkeypatch.setattr(suffixes, "ROWS_AT_ONCE", at_once)
    rng = random.Random(copies)
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    texts = [(n, "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(0, 150))) + passage * (n % 3 != 0) + "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(0, 150)))) for n in range(copies)]
    texts += [(500, "z" * 200), (505, "abc" * 90 + "x" + "abc" * 20), (506, "bca" * 30), (501, None), (502, ""), (503, texts[1][1]), (503, texts[1][1]), (504, texts[1][1][:130] + "#" + texts[1][1][131:])]
    got = suffixes.remove_repeats(table(spark, texts), length=40, gram=12).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "lang").collect()
    want = Counter((i, *x) for (i, t), x in zip(texts, brute_repeats([t for _, t in texts], 40)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_passages_are_counted_and_characters_go_whole(spark):
    rng = random.Random(8)
    passage, long = words(rng, 12, VOCABULARY), words(rng, 30, VOCABULARY)
    texts = [(i, "é漢" + words(rng, 20, VOCABULARY) + " é" + (passage if i < 3 else long if i < 6 else "") + "漢 " + words(rng, 20, VOCABULARY)) for i in range(8)]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(table(spark, texts), length=80, passage=40, whole_characters=True).collect()}
    short = brute_repeats([t for _, t in texts], 40)
    whole = brute_repeats([t for _, t in texts], 80)
    for (i, t), (_, n, _, _), (_, m, _, kept) in zip(texts, short, whole):
        assert got[i]["n_passage"] == n and got[i]["kept"].decode() == kept.decode(errors="ignore"), i
        assert got[i]["n_removed"] >= m
    assert got[0]["n_passage"] and not got[0]["n_removed"] and got[4]["n_removed"]


def test_repeats_of_odd_tables(spark, odd, empty):
    got = suffixes.remove_repeats(odd).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == Counter((i, len(LONG) if i in (6, 7) else 0) for i, _ in ODD)
    assert suffixes.remove_repeats(empty).count() == 0


def test_long_rows_are_cut_into_steps_without_a_trace():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 103, 50_000).astype(np.uint8)
    whole = suffixes.anchors(data, np.array([0, len(data)]))
    steps = [np.concatenate(x) for x in zip(*suffixes.anchors_of_rows(data, np.array([0, len(data)]), step=7000))]
    assert all((a == b).all() for a, b in zip(whole, steps))


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    assert [tuple(int(k[i]) for k in keys) for i in suffixes.multikey_order(*keys)] == sorted(zip(*(k.tolist() for k in keys)))


# --- sharding


def python_jump(key, shards):
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        draw = (int(hashlib.md5(f"{key}:{at}".encode()).hexdigest()[:8], 16) >> 1) + 1
        nxt = int((at + 1) * (2147483648.0 / draw))
    return at


def test_sharding(spark, odd, empty):
    docs = table(spark, [*ODD, *((i, f"t{i % 7}") for i in range(100, 900))])
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == python_jump(key, 8) and r["grown_shard"] == python_jump(key, 9) and r["grown_shard"] in (r["shard"], 8)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 8} == {(len(ODD[-1][1].encode()) + 1, zlib.crc32(ODD[-1][1].encode()))}
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 1} == {(1, 0)}
    assert sharding.shard_documents(empty).count() == 0
    many = spark.range(2000).select(sharding.jump_shard(F.col("id"), 100).alias("s")).collect()
    assert [r["s"] for r in many] == [python_jump(str(i), 100) for i in range(2000)]


# --- decontamination


def test_leaks(spark, odd, empty):
    rng = random.Random(11)
    items = [(i, words(rng, rng.randrange(15, 60), VOCABULARY)) for i in range(60)]
    texts, want = [], set()
    for n in range(80):
        body = words(rng, 300, VOCABULARY).split()
        if n % 4 == 0:
            item = items[n % 60]
            at = rng.randrange(len(body))
            body[at:at] = item[1].upper().split() if n % 8 else item[1].split()
            want.add((n, item[0]))
        texts.append((n, " ".join(body)))
    texts.append((900, items[3][1]))
    edited = items[5][1].split()
    edited[7] = "changed"
    texts.append((901, " ".join(edited)))
    want |= {(900, 3), (901, 5)}
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "?!")], "item_id long, text string")
    got = decontaminate.find_leaks(table(spark, [*texts, *ODD]), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, words(rng, rng.randrange(15, 60), VOCABULARY)) for i in range(50)]
    texts = []
    for n in range(120):
        own = items[n % 50][1].split()
        at = rng.randrange(len(own) // 3)
        texts.append((n, words(rng, 80, VOCABULARY) + " " + " ".join(own[at:])))  # partial copies
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), table(spark, texts)
    one = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", 10)
    assert len(one) > 50 and sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == one


def test_block_max_wand_is_exhaustive_search():
    rng = random.Random(4)
    index = decontaminate.build_index([(i, words(rng, rng.randrange(3, 30), VOCABULARY[:40])) for i in range(150)])
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randrange(1, 25)))
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.postings[t].items] += index.postings[t].impacts
        least = rng.choice([0.1, 0.3, 0.5, 0.8])
        got = decontaminate.block_max_wand(index, terms, least)
        assert [i for i, _ in got] == np.flatnonzero(score >= least - 1e-9).tolist()
        assert np.allclose([s for _, s in got], score[score >= least - 1e-9])


def test_question_and_answer():
    assert decontaminate.question_and_answer("Who is it? Me and you") == ("Who is it?", " Me and you")
    assert decontaminate.question_and_answer("a b c d e f g h") == ("a b c d e f", "g h")


# --- pages


def test_main_text():
    page = "<body class='has-sidebar'><header>S</header><nav>x</nav><main><h1>A  &amp; B</h1><p>one <b>two</b><br>three<p>4 &lt;x&gt; <span class='ad-box'>AD</span> 5</p><div class='comments'><p>c</p></div><aside>s</aside></main><footer>z</footer>"
    assert html.main_text(page) == "A & B\n\none two three\n\n4 <x> 5"
    assert html.main_text("<p>plain <i>page</i></p><script>x<p>y</p></script><ul><li>a<li>b</ul> tail &am") == "plain page\n\na\n\nb\n\ntail &am"
    for torn in ("", "<", "<p", "<p>a<!-- b", "a < b", "</p>x", "<script>", "<p title='>'>q"):
        html.main_text(torn)
    assert html.main_text("<p title='>'>q") == "q"


def test_templates_are_removed_per_host(spark):
    box = "<div><p>Subscribe to us now</p></div>"
    pages = [(n, f"http://a.com/{n}", f"<body>{box}<div><p>Text number {n}</p></div></body>") for n in range(4)]
    pages += [(10, "http://b.com/1", f"<body>{box}</body>"), (11, None, None), (12, "x", ""), (13, "http://a.com/c", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[0]["text"] == "Text number 0" and got[3]["n_chars"] == len("Text number 3") and got[13]["text"] == "Text number 0"
    assert got[10]["text"] == "Subscribe to us now"
    assert got[11]["text"] == "" and got[12]["n_chars"] == 0
    assert html.extract(df.limit(0)).count() == 0


def test_counts_decide_inside_and_outside_an_article(spark):
    box, said, quote = "<div><p>Follow us</p></div>", "<p>Sign up for more</p>", "<p>As they say</p>"
    pages = [(n, f"http://a.com/{n}", f"<body><div>Top</div><div>Lead {n}</div><article><h1>Title {n}</h1><p>One {n}</p>{box}{quote}<p>Two <b>{n}</b></p>{said}</article></body>") for n in range(6)]
    pages += [(n, f"http://a.com/{n}", f"<article><p>Few {n}</p><div>on three</div></article>") for n in (6, 7, 8)]
    pages += [(20, "http://b.com/1", pages[0][2])]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2] == "Lead 2\n\nTitle 2\n\nOne 2\n\nAs they say\n\nTwo 2"
    assert got[7] == "Few 7\n\non three"  # three of nine pages are no half
    assert got[20] == "Title 0\n\nOne 0\n\nFollow us\n\nAs they say\n\nTwo 0\n\nSign up for more"


def test_templates_belong_to_the_host_whatever_the_id(spark):
    box = "<div><p>Subscribe to us now</p></div>"
    pages = [(None if n % 2 else 7, f"http://a.com/{n}", f"<body>{box}<div><p>Text number {n}</p></div></body>") for n in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = Counter(f"Text number {n}" for n in range(6))
    assert Counter(r["text"] for r in html.extract(df).collect()) == want
    few, html.BROADCAST_HASHES = html.BROADCAST_HASHES, -1  # the join by host
    try:
        assert Counter(r["text"] for r in html.extract(df).collect()) == want
    finally:
        html.BROADCAST_HASHES = few


# --- quality


def brute_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdict(spark, odd, empty):
    rng = random.Random(8)
    texts, label = [], []
    for n in range(120):
        bad = n % 3 == 0
        lines = [words(rng, 12, VOCABULARY) + "." if not bad else " | ".join(rng.choice(VOCABULARY) for _ in range(12)) for _ in range(8)]
        texts.append((n, "\n".join(lines)))
        label.append((n, int(not bad)))
    texts += [*ODD, (800, "a b c a b c\n\na b c\nx\nx\n x\nx # <é>")]
    model = quality.fit(table(spark, texts), spark.createDataFrame(label, "doc_id long, quality int"))
    got = quality.judge(table(spark, texts), model).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[x] for x in names)) for r in got) == Counter((i, *brute_quality(t)) for i, t in texts)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        if r["doc_id"] is not None and 8 < r["doc_id"] < 120:
            assert r["kept"] == (r["doc_id"] % 3 != 0)
    assert quality.judge(empty, model).count() == 0
    quality.judge(odd, quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).collect()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=4), st.integers(0, 2**31))
def test_chains_against_enumeration(lengths, seed):
    rng = np.random.default_rng(seed)
    lengths = np.array(lengths)
    emit, move = rng.normal(size=(lengths.sum(), 2)), rng.normal(size=(2, 2))
    label, (p, _) = crf.viterbi(emit, move, crf.Chains(lengths)), crf.marginals(emit, move, crf.Chains(lengths))
    at = 0
    for n in lengths:
        if n:
            paths = list(itertools.product((0, 1), repeat=int(n)))
            scores = np.array([sum(emit[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)) for path in paths])
            assert tuple(label[at : at + n]) == paths[int(scores.argmax())]
            weights = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
            for i in range(n):
                assert p[at + i, 1] == pytest.approx(sum(w for w, path in zip(weights, paths) if path[i]), abs=1e-9)
        at += n


# --- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\\\n<|", max_size=6), st.lists(st.sampled_from([*chat.CONTROL_STRINGS, "\\", "\n", "<", "[", "|", "a"]), max_size=8).map("".join)), max_size=4))
def test_escapes_are_reversible(turns):
    formatted = "".join(chat.format_turn(role, text)[0] for role, text in turns)
    assert chat.parse(formatted) == turns
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL_STRINGS)


def test_best_paths_of_trees(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for tree in [None, *range(6)]:
        nodes = [(0, None, 1.0)] + [(n, rng.randrange(n), rng.choice([0.0, 1.0, 2.0])) for n in range(1, 40)]
        up, score = {n: p for n, p, _ in nodes}, {n: s for n, _, s in nodes}
        paths = []
        for leaf in set(up) - set(up.values()):
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            paths.append((-sum(score[n] for n in path), -len(path), leaf, path[::-1]))
        want[tree] = [p[3] for p in sorted(paths, key=lambda p: p[:3])[:2]]
        rows += [(tree, n, p, s, "assistant" if n % 2 else "user", f"m{n}") for n, p, s in nodes]
    rows += [(50, 1, 2, 1.0, "user", "cycle"), (50, 2, 1, 1.0, "user", "cycle"), (51, 1, 99, 1.0, "user", "orphan")]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = defaultdict(lambda: defaultdict(dict))
    for r in chat.reply_paths(df, "tree", "node", "parent", "score", 2).collect():
        got[r["tree"]][r["branch"]][r["pos"]] = r["node"]
    assert {t: [[b[n][p] for p in range(len(b[n]))] for n in sorted(b)] for t, b in got.items()} == {**want, 51: [[1]]}
    text = {r["tree"]: r["formatted"] for r in chat.format_trees(df, "tree", "node", "parent", "score", "role", "text").collect()}
    assert chat.parse(text[3]) == [("assistant" if n % 2 else "user", f"m{n}") for n in want[3][0]]


def test_chains_of_turns(spark):
    rows = [(1, 0, "user", "</s>[INST]"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 3, "assistant", "<|im_end|>\\"), *((9, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(70))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chains = chat.as_chains(df)
    done = chat.format_trees(chains, "conv_id", "node", "parent", "score", "role", "text").select("tree", chat.read_back("formatted", "loss").alias("r")).collect()
    assert len(done) == 4
    for r in done:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r["tree"]), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert r["r"]["n_turns"] == len(turns)
        assert r["r"]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["r"]["loss_chars"], r["r"]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_trees(chains.limit(0), "conv_id", "node", "parent", "score", "role", "text").count() == 0


# --- near duplicates


def brute_links(texts, size=5):
    sets = []
    for key, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((key, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return Counter((k, len(s), find(k)) for k, s in sets)


@pytest.mark.parametrize("most_edits", [3, 9, 14])
def test_links_are_exact(spark, most_edits):
    """Groups of near copies around the threshold, and many texts that share a passage."""
    rng = random.Random(most_edits)
    base, common, texts = words(rng, 150, VOCABULARY).split(), words(rng, 40, VOCABULARY).split(), []
    for i in range(120):
        w = base[:]
        for _ in range(rng.randrange(most_edits)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(i, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(14))])) for i in range(200, 290)]
    texts += [(400, None), (401, ""), (402, "a b"), (403, "A b"), (404, "a b c d e"), (405, "!!"), (3, texts[5][1]), (406, texts[8][1]), (407, texts[8][1].upper())]
    got = jaccard.link_documents(table(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(texts)


@pytest.mark.parametrize("rare", [None, jaccard.RARE_TOKENS])
def test_long_lists_and_hot_sets_are_dealt_without_loss(spark, monkeypatch, rare):
    """Lists and sets that are longer than a task takes give the same links as short ones, with whole prefixes too."""
    for name, value in (("LIST_AT_ONCE", 8), ("PAIRS_AT_ONCE", 3), ("BLOCK", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(21)
    base, texts = words(rng, 120, VOCABULARY).split(), []
    for i in range(90):
        w = base[:]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    got = jaccard.link_documents(table(spark, texts), rare=rare).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(texts)


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """Where first names of different sets are equal, second names and sizes decide."""
    names = jaccard.names_of
    monkeypatch.setattr(jaccard, "names_of", lambda own: (names(own)[0] % 3, names(own)[1]))
    rng = random.Random(5)
    texts = [(i, words(rng, 20, VOCABULARY)) for i in range(12)]
    texts += [(i + 20, t) for i, t in texts[:4]]
    got = jaccard.link_documents(table(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(texts)


def test_links_of_odd_tables(odd, empty):
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.link_documents(odd).collect()}
    assert got == {(i, 6 if i == 7 else i) for i, _ in ODD}
    assert jaccard.link_documents(empty).count() == 0


def test_links_of_copies_without_an_id(spark):
    rng = random.Random(3)
    copy, other = words(rng, 30, VOCABULARY), words(rng, 30, VOCABULARY)
    got = jaccard.link_documents(table(spark, [(None, copy), (7, copy), (5, copy), (None, other), (9, words(rng, 30, VOCABULARY))])).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(None, 5), (7, 5), (5, 5), (None, None), (9, 9)])


def test_blocks_are_skipped_without_loss():
    rng = np.random.default_rng(9)
    n = 300
    size, cid = rng.integers(5, 60, n), np.arange(n)
    pos, comp, leader, dist = (rng.random(n) * size * 0.3).astype(np.int64), rng.integers(0, 20, n), rng.integers(0, 5, n), rng.random(n)
    i, j = jaccard.candidate_pairs(size, pos, cid, comp, leader, dist)
    want = set()
    for x, y in itertools.combinations(range(n), 2):
        fits = 100 * min(size[x], size[y]) >= 80 * max(size[x], size[y]) and 180 * min(size[x] - pos[x], size[y] - pos[y]) >= 80 * (size[x] + size[y])
        if fits and comp[x] != comp[y] and not (leader[x] == leader[y] and abs(dist[x] - dist[y]) > 0.2 + 1e-9):
            want.add((x, y))
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want


# --- toxicity


def test_toxicity_learns_and_finds_offsets(spark, odd, empty):
    rng = random.Random(6)
    bad = ["grobbel", "snirk", "vuldor"]
    texts, label = [], []
    for n in range(400):
        w = words(rng, 40, VOCABULARY).split()
        if n % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "!", "X"[:0]])
        texts.append((n, "Été " + " ".join(w)))
        label.append((n, int(n % 4 == 0)))
    labels = spark.createDataFrame(label, "doc_id long, toxic int")
    docs = table(spark, texts)
    tagger = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    for r in toxicity.score(docs, tagger).where(toxicity.held_out()).collect():
        assert (r["score"] >= 0.3) == (r["doc_id"] % 4 == 0)
        found = {r["text"][s["start"] : s["end"]] for s in r["toxic_spans"]}
        assert found <= set(bad) and bool(found) == (r["doc_id"] % 4 == 0)
    got = toxicity.score(odd, tagger).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.3 for r in got)
    assert toxicity.score(empty, tagger).count() == 0
    flat = toxicity.fit(empty, labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, flat).collect())


def test_sparse_forward_backward_is_the_full_one():
    rng = random.Random(3)
    texts = [words(rng, n, VOCABULARY) for n in (1, 2, 7, 40, 90)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    _, _, row, found = toxicity.features_of(data, offs)
    keys = np.unique(found[::6, 0])
    weights = np.random.default_rng(1).normal(2, 1, len(keys))
    tagger = toxicity.Tagger(keys, weights, np.array([0.3, -1.2]), np.array([[0.5, -1.0], [-0.3, 0.8]]), (1.0, 1.0, 0.0))
    most, total, at_row, s, e, p = toxicity.tag(tagger, data, offs)
    emit = np.tile(tagger.rest, (len(row), 1))
    hit = np.isin(found[:, 0], keys)
    emit[hit, 1] += weights[np.searchsorted(keys, found[hit, 0])]
    full, _ = crf.marginals(emit, tagger.move, crf.Chains(np.bincount(row, minlength=len(texts))))
    assert np.allclose(p, full[hit, 1], atol=1e-9)
