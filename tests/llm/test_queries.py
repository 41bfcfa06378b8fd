"""The registered corpus queries over the smallest driver tables and the pipeline, against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_corpus import VOCABULARY, brute_links, brute_quality, brute_repeats, python_jump, words

import corpus_pipeline
from cutroom.llm import chat, packing, queries

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def crc(key, m):
    return zlib.crc32(str(key).encode()) % m


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@here
def test_sql(spark):
    """DuckDB gives the rows of the queries that have SQL."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df, found = queries.QUERIES[name](spark, DATA), con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns), name
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(found.fetchall()), name


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@here
def test_leaks(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op1_leaks")}
    assert {(d, i) for d, t in docs for i, x in items if t and x in t} == got


@here
def test_language(spark, docs):
    got = run(spark, "op2_language_id")
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


@here
def test_packing(spark, docs):
    from tokenizers import Tokenizer

    model, want = Tokenizer.from_file(packing.tokenizer_file()), Counter()
    for d, t in docs:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(d, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    got = run(spark, "op3_pack")
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert sum(r["length"] for r in got) > 0.97 * 2048 * (1 + max(r["sequence_id"] for r in got))


@here
def test_repeats(spark, docs):
    rows = run(spark, "op4_repeats")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == Counter((d, a, b, c, hashlib.sha256(k).hexdigest()) for (d, _), (a, b, c, k) in zip(docs, brute_repeats([t for _, t in docs], 400)))


@here
def test_sharding(spark, docs):
    got = run(spark, "op5_shard")
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), python_jump(str(d), 8), python_jump(str(d), 9)) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want


@here
def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in run(spark, "op6_main_text")}
    assert len(got) == len(pages)
    for p in pages:  # a plain reading of this table's markup: the article's tags are block ends, <b> and <br> are not
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", p["html"])[1]
        body = re.sub(r"<[a-z/][^>]*\Z", "", body)
        blocks = re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", body)
        plain = [re.sub(r"[ \t\n\r\f\v]+", " ", __import__("html").unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip(" ") for b in blocks]
        assert got[p["page_id"]] == "\n\n".join(b for b in plain if b), p["page_id"]


@here
def test_quality(spark, docs):
    got = run(spark, "op7_quality")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((d, *brute_quality(t)) for d, t in docs)
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(r["kept"], good[r["doc_id"]]) for r in got if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.9


@here
def test_chat(spark):
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    want = set()
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        want.add((c, len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(*x)[0]) for x in t)))
    assert {tuple(r[x] for x in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in run(spark, "op8_chat")} == want


@here
def test_links(spark, docs):
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, "op9_jaccard")) == brute_links(docs)


@here
def test_toxicity(spark, docs):
    got = run(spark, "op10_toxicity")
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_toxicity_of_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{where}/labels.parquet").where("toxic is not null").collect()}
    held = [(r["predicted"], label[r["doc_id"]]) for r in queries.QUERIES["op10_toxicity"](spark, where).collect() if r["held_out"] and r["doc_id"] in label]
    right = sum(p and y for p, y in held)
    assert right >= 0.5 * sum(y for _, y in held) > 3 and right >= 0.9 * sum(p for p, _ in held)


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    texts = {i: words(rng, 200, VOCABULARY) for i in range(40)}
    passage = words(rng, 62, VOCABULARY)
    assert 250 < len(passage) < 400
    item = words(rng, 40, VOCABULARY)
    texts[100] = texts[3]  # copy
    texts[101] = texts[4] + " changed"  # near copy
    texts[102], texts[103] = words(rng, 90, VOCABULARY) + " " + passage, passage + " " + words(rng, 70, VOCABULARY)  # a passage that repeats
    texts[104] = words(rng, 60, VOCABULARY) + " " + item  # a leak
    texts[105], texts[106] = None, "123 !!"  # no language
    rows = [(i, t, "xx", "src", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    left = {i: left[i] for (i, _, c), _ in brute_links(list(left.items())).items() if i == c}
    kept = brute_repeats(list(left.values()), corpus_pipeline.PASSAGE_BYTES)
    left = {i: k.decode() for i, (_, _, _, k) in zip(left, kept) if k.strip()}
    left = {i: t for i, t in left.items() if item not in t}
    assert not {100, 101, 104, 105, 106} & set(left) and passage not in left[102]
    encoder = packing.WordEncoder.of(packing.tokenizer_file())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(i, len(encoder.encode([t])[0]) // 4 + 1) for i, t in left.items()}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "packing":
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    a, b, c, d, e = (words(rng, 60, VOCABULARY) for _ in range(5))
    texts = [(None, a), (None, a), (None, b), (None, b + " more"), (None, c), (7, d), (7, d), (7, e), (7, e + " more"), (5, c), (8, a + " more"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "xx", "src", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    left = next(t for t in (b, b + " more") if (None, t) in got), next(t for t in (e, e + " more") if (7, t) in got)
    assert got == Counter([(8, a + " more"), (None, left[0]), (5, c), (7, d), (7, left[1]), (9, None), (None, "")])
