"""Vector codes, HyperMinHash near duplicates and collocations against brute force, and on awkward tables; leaks by row; page structure."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import LONG, ODD, VOCABULARY, brute_links, table, words

import corpus_pipeline
from cutroom.llm import collocations, common, covertree, decontaminate, html, hyperminhash, jaccard

# --- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error), codebooks' digest of (vec_id, vector) rows, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = len(kept[0][1])
    cut = lambda v: [v[j * width // parts : (j + 1) * width // parts] for j in range(parts)]
    vectors = [(i, cut(v)) for i, v in kept]
    books = [[v[j] for _, v in sorted(vectors)[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for j, book in enumerate(books):
            given = defaultdict(list)
            for _, v in vectors:
                given[nearest(v[j], book)].append(v[j])
            books[j] = [[sum(x) // len(given[e]) for x in zip(*given[e])] if e in given else old for e, old in enumerate(book)]
    out = []
    for i, v in vectors:
        code = [nearest(v[j], books[j]) for j in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e in code), sum(far(v[j], books[j][e]) for j, e in enumerate(code))))
    return out, hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, id long, code string, error long"


def vectors(spark, rows, labels=None):
    return spark.createDataFrame([(i, v, labels(i) if labels else None, 1, "x", 2) for i, v in rows], VECTORS)


@pytest.mark.parametrize("kind", ["spread", "copies", "large", "few", "one"])
def test_codes(spark, kind):
    rng = np.random.default_rng(5)
    n = {"few": 9, "one": 1}.get(kind, 260)
    points = rng.normal(size=(n, 24)).astype(np.float32)
    if kind == "copies":
        points[:120] = points[0]
        points[120:200] = points[rng.integers(120, 130, 80)]
    if kind == "large":
        points[::3] *= np.float32(1e5)  # some errors need more than 64 bits
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(rng.permutation(n), points)]
    label = lambda i: None if i is None or i % 4 == 0 else i % 3
    odd = [(900, None), (901, []), (902, [1.0] * 23 + [None]), (903, [math.nan] * 24), (904, [math.inf] * 24), (905, [1.0] * 23)]
    got = covertree.compress(vectors(spark, [*rows, *odd], label).repartition(3)).collect()
    want, digest = brute_codes(rows)
    want = [(i, c, e if e < 1 << 63 else None) for i, c, e in want]
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got) == Counter(want) and {r["codebooks_sha256"] for r in got} == {digest}
    sums = Counter()
    for i, _, e in want:
        sums[label(i)] += e or 0
    if kind != "large":
        assert {(r["vec_id"], r["label_error"]) for r in got} == {(i, sums[label(i)]) for i, _, _ in want}


def test_codes_of_odd_tables(spark):
    assert covertree.compress(vectors(spark, [])).count() == 0
    assert covertree.compress(vectors(spark, [(1, None), (2, [math.nan] * 8)])).count() == 0
    rows = [(None, [0.5] * 8), (3, [0.25] * 8), (3, [0.25] * 8), (3, [-0.25] * 8)]  # a null key comes last, equal keys by their vectors
    got = covertree.compress(vectors(spark, rows), entries=2, rounds=0).collect()
    assert Counter((r["vec_id"], r["code"]) for r in got) == Counter({(3, "00" * 8): 1, (3, "01" * 8): 2, (None, "01" * 8): 1})
    few = covertree.BROADCAST_LABELS
    try:
        covertree.BROADCAST_LABELS = -1  # labels are joined
        assert Counter((r["vec_id"], r["label_error"]) for r in covertree.compress(vectors(spark, rows), entries=2, rounds=0).collect()) == Counter((r["vec_id"], r["label_error"]) for r in got)
    finally:
        covertree.BROADCAST_LABELS = few


@pytest.mark.parametrize("kind", ["normal", "copies", "grid", "line", "one"])
def test_trees_cover_and_assign(kind):
    rng = np.random.default_rng(2)
    points = {"normal": rng.normal(size=(700, 8)) * 500, "copies": rng.normal(size=(9, 8))[rng.integers(0, 9, 500)] * 500, "grid": rng.integers(0, 3, (600, 8)), "line": np.arange(800)[:, None] * np.ones((1, 3)), "one": np.ones((1, 4))}[kind].astype(np.int64)
    tree = covertree.build_tree(points)
    order, real = tree["order"], points.astype(float)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree["hi"] > tree["lo"]).all()
    for lo, hi, centre, radius, first, last in zip(*(tree[k].tolist() for k in ("lo", "hi", "centre", "radius", "first", "last"))):
        own = order[lo:hi]
        assert centre in own and np.sqrt(((real[own] - real[centre]) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if first < last:
            assert tree["lo"][first] == lo and tree["hi"][last - 1] == hi and (tree["hi"][first : last - 1] == tree["lo"][first + 1 : last]).all()
        else:
            assert hi - lo <= covertree.LEAF or radius == 0
    book = points[rng.integers(0, len(points), 16)]
    nodes, places = covertree.assign(points, tree, book)
    found = places.copy()
    for i in np.flatnonzero(nodes >= 0):
        assert (places[tree["lo"][i] : tree["hi"][i]] == -1).all()
        found[tree["lo"][i] : tree["hi"][i]] = nodes[i]
    d = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)[order]).all()
    assert (covertree.node_sums(points, tree)[0] == points.sum(axis=0)).all()
    if kind == "copies":
        assert (nodes >= 0).sum() < 60 and (places >= 0).mean() < 0.5  # whole nodes go at once


# --- HyperMinHash


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY) + "q" + str(rng.randrange(99))
    return " ".join(w)


def test_near_duplicates(spark):
    rng = random.Random(12)
    texts, n = [*ODD], 100
    for size in (2, 3, 4, 5, 9, 30, 100, 400, 3000):
        base = words(rng, size, VOCABULARY)
        for _ in range(9):
            texts.append((n, edited(rng, base, rng.randrange(0, max(2, size // 12)))))
            n += 1
        texts += [(n, base.upper() + "\t"), (n + 1, base + " tail")]
        n += 2
    star = words(rng, 150, VOCABULARY)
    texts += [(1000 + i, edited(rng, star, i % 30)) for i in range(120)]  # one text with few and with many edits
    got = hyperminhash.near_duplicates(table(spark, texts).withColumn("kept", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(texts, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_many_parts(spark):
    """The same classes where groups, lists and sets are dealt over many tasks, and where nothing stands around a leader."""
    rng = random.Random(13)
    star = words(rng, 120, VOCABULARY)
    texts = [(i, edited(rng, star, i % 40)) for i in range(160)] + [(500 + i, words(rng, 40, VOCABULARY)) for i in range(40)]
    df = table(spark, texts)
    read = lambda: sorted((r["doc_id"], r["component_id"]) for r in hyperminhash.near_duplicates(df).collect())
    want = sorted((i, b) for i, _, b in brute_links(texts, 2).elements())
    assert read() == want
    names = {"SETS_AT_ONCE": 16, "TOKENS_AT_ONCE": 4000, "COLUMNS": 32, "PAIRS_AT_ONCE": 8, "BROADCAST_SETS": -1, "LIST_AT_ONCE": 32}
    before = {x: getattr(jaccard, x) for x in (*names, "AROUND")}
    try:
        for x, v in names.items():
            setattr(jaccard, x, v)
        assert read() == want
        jaccard.AROUND = -1.0
        assert read() == want
    finally:
        for x, v in before.items():
            setattr(jaccard, x, v)


def test_near_duplicates_leave_no_shuffle_files(spark):
    """Files of the steps go as each one ends, not when the driver happens to collect its garbage; the session's setting stays as it was."""
    rng = random.Random(14)
    star = words(rng, 120, VOCABULARY)
    df = table(spark, [(i, edited(rng, star, i % 40)) for i in range(80)] + [(500 + i, words(rng, 40, VOCABULARY)) for i in range(20)])
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {str(f) for d in folders for f in Path(d).rglob("shuffle_*")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(name)
    found = hyperminhash.near_duplicates(df)
    for _ in range(100):  # they are removed beside the work
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left, len(left)
    assert spark.conf.get(name) == was
    assert found.count() == 100


def test_no_documents_have_no_duplicates(spark):
    assert hyperminhash.near_duplicates(table(spark, [])).count() == 0
    got = hyperminhash.near_duplicates(table(spark, [(1, None), (2, ""), (None, "a")])).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(1, 0, 1, True), (2, 0, 2, True), (None, 1, None, True)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 4, 11, 12, 40, 300, 2303, 2304, 9000):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert hyperminhash.LEVELS[hyperminhash.level_of(n)][1] <= n
        errors = []
        for share in (1.0, 0.8, 0.5, 0.0):
            other = np.unique(np.concatenate([own[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share), dtype=np.uint64)]))
            level = hyperminhash.levels_of(n)[-1]
            a, b = (hyperminhash.sketch(x, level)[None] for x in (own, other))
            true = len(np.intersect1d(own, other)) / len(np.union1d(own, other))
            one = np.array([n])
            errors.append(abs(hyperminhash.estimate(a, b, one, one, np.array([hyperminhash.LEVELS[level][0]]))[0] - true))
        assert max(errors) < 0.12 and errors[0] == 0
    for n in range(1, 4000):  # linked sets have a level in common
        for m in (math.ceil(0.8 * n), n):
            assert set(hyperminhash.levels_of(n)) & set(hyperminhash.levels_of(m)), (n, m)


def test_chance_agreement_is_what_is_seen():
    rng = np.random.default_rng(6)
    made = [hyperminhash.sketch(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), 0) for _ in range(70)]
    seen = np.mean([(made[i] == made[j]).mean() for i in range(70) for j in range(i)])
    expected = hyperminhash.chance(np.array([5000]), np.array([5000]), np.array([1]))[0]
    assert 0.8 < seen / expected < 1.25


# --- collocations


def brute_collocations(rows, longest=5, least=100, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: v for k, v in counts.items() if v >= least}
    gone = {(lang, p) for (lang, q), f in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) for p in [q[i : i + k]] if f >= often[(lang, p)]}
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (counts[(lang, p[:k])] * counts[(lang, p[k:])]), k, counts[(lang, p[:k])], counts[(lang, p[k:])]) for k in range(1, len(p)))  # noqa: E741
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows_ in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])}


def spoken(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1, 2) for t, lang in rows], "text string, lang string, phrase string, f long, n long")


@pytest.mark.parametrize("least,top", [(3, 2000), (6, 5), (2, 7)])
def test_collocations(spark, least, top):
    rng = random.Random(least)
    few = VOCABULARY[:9] + ["Été", "漢字", "a b", "x-y"]
    rows = [(rng.choice(["", "…", "\n"]).join([words(rng, rng.randrange(1, 30), few), rng.choice([". ", ", ", "\t ", "\x0b"]), "New York City is big", words(rng, 3, few)]), rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" .\t!", "fr"), ("NEW YORK", "en"), (LONG[:3000], "en"), ("one two " * 50, "xx"), ("one two " * 50, "xx")]
    got = {tuple(r) for r in collocations.collocations(spoken(spark, rows).repartition(3), least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_collocations(rows, least=least, top=top)


def test_collocations_of_few_words_and_none(spark):
    assert collocations.collocations(spoken(spark, [])).count() == 0
    assert collocations.collocations(spoken(spark, [(None, None), ("a b", "en")])).count() == 0
    few, collocations.FEW = collocations.FEW, -1  # languages' totals are joined
    try:
        rows = [("the same words again", "en")] * 100
        got = {tuple(r) for r in collocations.collocations(spoken(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
        assert got == brute_collocations(rows) == {("en", 1, "the same words again", 100, 100, 100, 400, 4000)}
    finally:
        collocations.FEW = few


# --- leaks


ITEM = "Which river runs through the old town of Kelm and why was its bridge closed for years? The river Andra because of floods"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, score int")


def test_leaks_by_row(spark, tmp_path):
    leak, clean = f"{words(random.Random(1), 30, VOCABULARY)} {ITEM} more", words(random.Random(2), 60, VOCABULARY)
    rows = [(None, leak), (None, clean), (7, leak), (7, clean), (8, clean), (9, None), (9, ""), (7, leak), (8, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench(spark, ITEM).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((i, t) for i, t in rows if t != leak)
    bench(spark).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path / "none")).count() == len(rows)
    assert corpus_pipeline.decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_other_items_do_not_decide(spark):
    """The pieces of an item scattered over hundreds of words leak nothing, whatever long items there are."""
    rng = random.Random(3)
    pieces = [ITEM.split()[i : i + 4] for i in range(0, 24, 4)]
    scattered = " ".join(f"{' '.join(p)} {words(rng, 70, VOCABULARY)}" for p in pieces)
    docs = spark.createDataFrame([(1, scattered), (2, f"{words(rng, 500, VOCABULARY)} {ITEM} {words(rng, 500, VOCABULARY)}")], "doc_id long, text string")
    long = words(rng, 3000, [w + "zz" for w in VOCABULARY])
    for items in ((ITEM,), (ITEM, long)):
        got = decontaminate.find_leaks(docs, bench(spark, *items)).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, 0)}
    both = spark.createDataFrame([(3, f"so {words(rng, 700, VOCABULARY)} {long} end")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(both, bench(spark, ITEM, long)).collect()} == {(3, 1)}
    assert [decontaminate.segment_of(n) for n in (1, 64, 65, 128, 129, 300)] == [64, 64, 128, 128, 256, 512]


# --- page structure


def test_structure_decides_where_text_differs(spark):
    """Menus, adverts and boxes that say something else on every page, with and without telling names; long named text stays."""

    def page(n):
        menu = "<ol class='zq1'>" + "".join(f"<li><a href='/{i}{n}'>go {i} {n}</a></li>" for i in range(2 + n % 3)) + "</ol>"
        return f"<body>{menu}<div class='xk-{n}'>Buy {n} now</div><article><h1>Title {n}</h1><p class='notice'>{'Said ' * 40}{n}</p><p>One {n}</p><div class='rel'><a href='/{n}'>more of {n}</a></div></article><div id='b{n}'>c {n}</div></body>"

    pages = [(n, f"http://a.com/{n}", page(n)) for n in range(6)] + [(20, "http://b.com/1", page(20))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = lambda n: f"Title {n}\n\n{'Said ' * 40}{n}\n\nOne {n}"
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[2] == want(2) and got[5] == want(5)
    assert got[20] == "Title 20\n\nOne 20\n\nmore of 20"  # not counted: the lists and the article decide
    alone = {r["page_id"]: r["text"] for r in html.extract(df, rules=False).collect()}
    assert {n: alone[n] for n in range(6)} == {n: got[n] for n in range(6)}
    off = {r["page_id"]: r["text"] for r in html.extract(df, template_pages=1 << 40, rules=False).collect()}
    assert all(off[n] != got[n] and "Buy" in off[n] for n in range(6))


def test_counts_make_the_given_pages(spark):
    """On hosts that are counted the counts alone give the text that the rules give too; without counts nothing goes."""
    import os

    data = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(data):
        pytest.skip("driver tables are not here")
    pages = spark.read.parquet(data)
    read = lambda **more: {r["page_id"]: (r["url"], r["text"]) for r in html.extract(pages, **more).collect()}
    both, counts, none = read(), read(rules=False), read(rules=False, template_pages=1 << 40)
    host = lambda u: re.match(r"[^/]*//(?:[^/?#@]*@)?([^/?#:]+)", u)[1]
    many = Counter(host(u) for u, _ in both.values())
    counted = [k for k, (u, _) in both.items() if many[host(u)] >= html.TEMPLATE_PAGES]
    assert len(counted) > 200 and all(counts[k] == both[k] for k in counted)
    assert sum(none[k] != both[k] for k in counted) >= 0.9 * len(counted)


# --- batches


def test_batches_are_bounded_by_bytes(spark):
    """Long texts in batches of so many rows would fill an executor's memory; smaller settings stay."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    was = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.unset(n)
        docs = common.small_batches(spark.range(1500, numPartitions=1).select(F.repeat(F.lit("a"), 20_000).alias("text")))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 1500
        assert max(r["bytes"] for r in got) <= 2 << 20
        assert int(spark.conf.get(names[2])) <= 1000
        spark.conf.set(names[1], "300k")
        common.small_batches(docs)
        assert spark.conf.get(names[1]) == "300k"
    finally:
        for n, value in zip(names, was, strict=True):
            spark.conf.set(n, value)
