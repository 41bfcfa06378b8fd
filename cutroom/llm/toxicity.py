"""Toxicity: a two-label linear-chain CRF tags toxic words; marginals aggregate to scores and offending offsets.

Training words are labelled from a bounded sample of labelled documents: a word of a toxic document is toxic if it, or
a prefix of it, is far more frequent in toxic than in clean documents. Those words and prefixes are the CRF's lexicon.
All other words share one potential, so a run of them between two lexicon words is a power of one 2 x 2 matrix, and
forward-backward walks the lexicon words only, with the same result as over all words.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import blocks, id_crc, mix, prefix_hash, runs, settle, small_batches, span_hash, utf8
from .decontaminate import WORD, fold

CLEAN, TOXIC = 0, 1
#: Bytes of the prefixes that are looked at besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Tagger:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # toxic minus clean potential of each
    rest: np.ndarray  # potentials of a word without a feature
    move: np.ndarray
    scale: tuple[float, float, float]  # logistic weights of the largest marginal and of log(1 + sum), and the constant


def features_of(data: np.ndarray, offs: np.ndarray):
    """Start, end and row of every word; feature hashes (words x 1 + prefixes; 0: none)."""
    low = fold(data)
    s, e, row = runs(WORD[data], offs)
    total, down = prefix_hash(low)
    found = np.zeros((len(s), 1 + len(PREFIXES)), np.uint64)
    found[:, 0] = span_hash(total, down, s, e)
    for j, n in enumerate(PREFIXES):
        long = e - s > n
        found[long, j + 1] = mix(span_hash(total, down, s[long], s[long] + n) + np.uint64(1))
    return s, e, row, found


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Newton steps on the log-likelihood with a small ridge; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def learn(texts: list[str], toxic: np.ndarray, least_docs: int = 4, least_odds: float = 3.0, lexicon: int = 4096, window: int = 64) -> Tagger:
    """A tagger from labelled texts. Without both labels no word is toxic and the score is the share of toxic texts."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=offs[1:])
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    rate = (n1 + 0.5) / (n1 + n0 + 1)
    nothing = Tagger(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0, -6.0]), np.zeros((2, 2)), (0.0, 0.0, float(np.log(rate / (1 - rate)))))
    if not n1 or not n0:
        return nothing
    data = np.frombuffer(b"".join(raw), np.uint8)
    per_row = {0: [], 1: []}  # feature hashes, once per text, of toxic and clean texts
    spans = list(blocks(offs))
    for a, z in spans:
        _, _, row, found = features_of(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
        for k in (0, 1):
            mine = toxic[a:z][row] == k
            f, r = found[mine].ravel(), np.repeat(row[mine], found.shape[1])
            order = np.lexsort((r, f))
            f, r = f[order], r[order]
            once = np.ones(len(f), bool)
            once[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
            per_row[k].append(f[once & (f > 0)])
    keys, hits = np.unique(np.concatenate(per_row[1]), return_counts=True)
    keys, hits = keys[hits >= least_docs], hits[hits >= least_docs]
    clean = np.zeros(len(keys), np.int64)
    for f in per_row[0]:
        at = np.searchsorted(keys, f)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == f)] if len(keys) else at[:0]
        clean += np.bincount(at, minlength=len(keys))
    odds = np.log((hits + 0.5) / n1) - np.log((clean + 0.5) / n0)
    strong = np.flatnonzero(odds >= least_odds)
    strong = np.sort(strong[np.argsort(-(odds * hits)[strong], kind="stable")[:lexicon]])
    keys, odds = keys[strong], odds[strong]
    if not len(keys):
        return nothing

    scores, labels, at_row, edges = [], [], [], []
    for a, z in spans:
        _, _, row, found = features_of(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
        best = _strongest(found, keys, odds)
        scores.append(best)
        labels.append((best >= least_odds) & (toxic[a:z][row] == 1))
        at_row.append(a + row)
    score, label, row = np.concatenate(scores), np.concatenate(labels), np.concatenate(at_row)
    # chains for training: windows of words that hold a lexicon word, of all texts
    edge = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(edge, np.diff(np.append(edge, len(row))))
    chain = np.cumsum((place % window == 0))
    wanted = np.zeros(chain.max(initial=0) + 1, bool)
    wanted[chain[score > 0]] = True
    wanted[np.arange(0, len(wanted), 16)] = True  # and a sixteenth of the others
    use = wanted[chain]
    x = np.stack([np.ones(use.sum()), score[use] > 0, np.maximum(score[use], 0)], 1).astype(float)
    lengths = np.unique(chain[use], return_counts=True)[1]
    w, move = crf.fit(x, label[use].astype(np.int64), lengths, rounds=40)
    tagger = Tagger(keys, (w[1, TOXIC] - w[1, CLEAN]) + odds * (w[2, TOXIC] - w[2, CLEAN]), w[0], move, (0.0, 0.0, 0.0))
    most, total = np.zeros(len(texts)), np.zeros(len(texts))
    for a, z in spans:
        m, t, *_ = tag(tagger, data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
        most[a:z], total[a:z] = m, t
    tagger.scale = tuple(_logistic(np.stack([most, np.log1p(total), np.ones(len(most))], 1), toxic.astype(float)).tolist())
    return tagger


def _strongest(found: np.ndarray, keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The largest value of each word's features, 0 where it has none."""
    best = np.zeros(len(found))
    for j in range(found.shape[1]):
        at = np.minimum(np.searchsorted(keys, found[:, j]), len(keys) - 1)
        best = np.where(keys[at] == found[:, j], np.maximum(best, value[at]), best)
    return best


def tag(tagger: Tagger, data: np.ndarray, offs: np.ndarray):
    """Largest toxic marginal and their sum for every row; row, start, end and marginal of every lexicon word."""
    n = len(offs) - 1
    s, e, row, found = features_of(data, offs)
    if not len(tagger.keys) or not len(s):
        return np.zeros(n), np.zeros(n), row[:0], s[:0], e[:0], np.zeros(0)
    gain = np.full(len(s), -np.inf)
    for j in range(found.shape[1]):
        at = np.minimum(np.searchsorted(tagger.keys, found[:, j]), len(tagger.keys) - 1)
        gain = np.where(tagger.keys[at] == found[:, j], np.maximum(gain, tagger.weights[at]), gain)
    hit = np.flatnonzero(gain > -np.inf)
    hit_row = row[hit]
    words = np.bincount(row, minlength=n)
    begin = np.cumsum(words) - words
    place = hit - begin[hit_row]
    # potentials of a plain word: P[i, j] = exp(move[i, j] + rest[j]), scaled to largest eigenvalue 1
    plain = np.exp(tagger.move - tagger.move.max() + tagger.rest - tagger.rest.max())
    values, right = np.linalg.eig(plain)
    plain, values, left = plain / values.max(), values / values.max(), np.linalg.inv(right)

    def power(g: np.ndarray) -> np.ndarray:
        return np.einsum("ij,nj,jk->nik", right, values[None, :] ** g[:, None], left)

    start = np.exp(tagger.rest - tagger.rest.max())  # a chain's first word has no move into it
    step = np.exp(tagger.move - tagger.move.max())
    own = np.exp(tagger.rest - tagger.rest.max() + np.stack([np.zeros(len(hit)), np.clip(gain[hit], -50, 50)], 1))
    first = np.ones(len(hit), bool)
    first[1:] = hit_row[1:] != hit_row[:-1]
    gap = np.where(first, place - 1, np.diff(place, prepend=0) - 1)
    chains = crf.Chains(np.bincount(hit_row, minlength=n))
    fore = np.empty((len(hit), 2))
    between = power(np.maximum(gap, 0).astype(float))
    for t in range(chains.steps):
        now = chains.at(t)
        if t == 0:
            into = np.einsum("i,nij,jk->nk", start, between[now], step)
            fore[now] = np.where((place[now] == 0)[:, None], 1.0, into) * own[now]
        else:
            fore[now] = np.einsum("ni,nij,jk->nk", fore[chains.at(t - 1)[: len(now)]], between[now], step) * own[now]
        fore[now] /= fore[now].sum(1, keepdims=True)
    after = np.ones((len(hit), 2))
    last = np.append(first[1:], True)
    if len(hit):
        after[last] = power((words[hit_row[last]] - 1 - place[last]).astype(float)).sum(2)
        after[last] /= after[last].sum(1, keepdims=True)
    for t in range(chains.steps - 1, 0, -1):
        now, before = chains.at(t), chains.at(t - 1)[: chains.active[t]]
        after[before] = np.einsum("nij,jk,nk->ni", between[now], step, own[now] * after[now])
        after[before] /= after[before].sum(1, keepdims=True)
    p = fore * after
    p = p[:, TOXIC] / p.sum(1)
    most, total = np.zeros(n), np.zeros(n)
    np.maximum.at(most, hit_row, p)
    np.add.at(total, hit_row, p)
    return most, total, hit_row, s[hit], e[hit], p


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = 6000, fit_bytes: int = 1 << 26) -> Tagger:
    """A tagger learned in one task from a sample of labelled documents.

    The documented bound: about ``fit_docs`` documents of ``fit_bytes`` of text in all, none longer than a 64th of that.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropDuplicates(["k"])
    n = known.count()
    if n > fit_docs:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.octet_length("text") <= fit_bytes // 64)
    rows = settle(rows.join(F.broadcast(known), "k").select("k", "text", "y"))  # as many rows as the sample
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > fit_bytes:
        rows = rows.where(F.pmod(F.xxhash64("text", "k"), F.lit(1 << 30)) < int((1 << 30) * fit_bytes / size))
    rows = rows.select("text", "y")

    def train(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(texts, np.array(y, np.int64)))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(train, "model binary").collect()  # the sample is bounded
    return pickle.loads(made[0]["model"]) if made else learn([], np.zeros(0, np.int64))


def score(docs: DataFrame, tagger: Tagger, text: str = "text", least_span: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and toxic_spans (code point offsets and marginal of each offending word).

    A null or empty text scores as one without lexicon words. Texts are read whole; repeated rows score alike. A column
    of an output's name is replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    @F.arrow_udf("struct<score: double, spans: array<struct<start: bigint, end: bigint, p: double>>>")
    def measure(column: pa.Array) -> pa.Array:
        t = shared.value
        data, offs = utf8(column)
        result, spans = np.zeros(len(column)), [[] for _ in range(len(column))]
        for a, z in blocks(offs):
            part = data[offs[a] : offs[z]]
            most, total, row, s, e, p = tag(t, part, offs[a : z + 1] - offs[a])
            result[a:z] = 1 / (1 + np.exp(-np.clip(t.scale[0] * most + t.scale[1] * np.log1p(total) + t.scale[2], -30, 30)))
            bad = np.flatnonzero(p >= least_span)
            if len(bad):
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                zero = points[offs[a:z] - offs[a]]
                for i in bad.tolist():
                    spans[a + row[i]].append({"start": int(points[s[i]] - zero[row[i]]), "end": int(points[e[i]] - zero[row[i]]), "p": float(p[i])})
        return pa.StructArray.from_arrays([pa.array(result), pa.array(spans, pa.list_(span))], fields=[pa.field("score", pa.float64()), pa.field("spans", pa.list_(span))])

    got = small_batches(docs).withColumn("__t", measure(F.col(text)))
    return got.withColumns({"score": F.col("__t.score"), "toxic_spans": F.col("__t.spans")}).drop("__t")


def held_out(key: str = "doc_id"):
    return F.coalesce(id_crc(key) % 4 == 2, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    done = score(docs.select("doc_id", "text"), fit(docs, labels.where(~held_out())))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"))
