"""Language-model scores: counts by brute force, the model by a plain loop and by held-out text."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pixelweave.llm import op4_lm as op4

WORDS = ["the", "of", "Und", "der", "été", "x-1,", "tion", "ing"]


def rows(seed=1, n=240):
    r = random.Random(seed)
    out = []
    for i in range(n):
        half = WORDS[:4] if i % 2 else WORDS[4:]
        t = []
        while len(t) < r.randint(1, 60):
            t += [half[len(t) % 4]] if r.random() < 0.9 else ["".join(r.choice("abcé") for _ in range(5))]
        out.append((i, r.choice([" ", "\n"]).join(t)))
    return out + [(500, None), (501, ""), (None, "The of the"), (502, "a   b  c"), (503, "w " * 20_000), (7, out[7][1])]


def test_counts_and_base(spark, monkeypatch):
    monkeypatch.setattr(op4, "EVERY", 1)
    data = rows()
    df = spark.createDataFrame([(*d, "c", 1) for d in data], "doc_id bigint, text string, rare string, n int")
    got = op4.score(df).collect()
    assert len(got) == len(data)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in data]
    count = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(ws), sum(w in count for w in ws), n,
                    round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in toks), key=str)
    assert sorted(((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got), key=str) == want
    assert all(g["score"] < 0 and math.isfinite(g["score"]) for g in got)
    # trained on texts like these, the model beats the base counts on held-out texts
    mine = [g for g in got if g["held_out"] and g["doc_id"] < 500]
    assert sum(g["score"] for g in mine) > sum(g["base_score"] for g in mine)
    few = op4.frequent_words(op4.word_counts(df.selectExpr("cast(text as binary) text")), 6)
    assert 0 < len(few[0]) <= 6 and (np.diff(few[0].astype(float)) > 0).all()


def test_few_frequent_words_give_the_same_base(spark, monkeypatch):
    df = spark.createDataFrame(rows(3, 60), "doc_id bigint, text string")
    a = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in op4.score(df).collect()}
    whole = op4.frequent_words
    monkeypatch.setattr(op4, "frequent_words", lambda counts: whole(counts, 2))
    assert {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in op4.score(df).collect()} == a


def test_all_training_documents_learn(spark, monkeypatch):
    data = [(i, f"word{i} the of") for i in range(50)] + [(None, "only here"), (None, "x"), *[(None, "one text of many copies")] * 200]
    seen, whole = [], op4._followed
    monkeypatch.setattr(op4, "_followed", lambda encoded, count: seen.append(encoded) or whole(encoded, count))
    monkeypatch.setattr(op4, "SHARD_IDS", 200)
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = op4.score(df).collect()
    training = [i for i, _ in data if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(got) == len(data) and seen[0].count() == len(training)
    laid, shards = op4.laid_out(seen[0])
    sizes = [len(p) for p in laid.select("ids").rdd.glom().collect()]
    assert shards > 4 and sum(sizes) == len(training) and max(sizes) < len(training) / 2      # copies don't meet in one shard


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    got = op4.score(df).collect()
    assert [(g["n_tokens"], g["n_known"]) for g in got] == [(1, 1)]
    assert op4.score(df.limit(0)).count() == 0


@pytest.fixture
def model():
    r = np.random.default_rng(3)
    m = op4.Attention(50, 9, np.full(9, 1 / 9))
    m.load(r.normal(0, 0.5, len(m.flat())))
    return m


def test_windows_score_each_id_once_like_a_loop(model):
    r = np.random.default_rng(4)
    cls = r.integers(0, 9, 50)
    docs = [r.integers(0, 50, n).astype(np.int32) for n in (1, 7, 8, 9, 16, 33)]
    x, y, owner = model.windows(docs)
    model.tables()
    got = np.where(y >= 0, model.class_scores(x, cls[np.maximum(y, 0)]), 0).sum(1)
    for d, ids in enumerate(docs):
        assert [i for i in y[owner == d].ravel() if i >= 0] == ids.tolist()
        line, total = [50, *ids.tolist()], 0.0
        for t in range(len(ids)):
            first = max(0, t - t % op4.HALF - op4.HALF)
            s = np.array([model.e[line[t]] @ model.wq @ (model.e[line[j]] @ model.wk) / 4 + model.near[t - j] for j in range(first, t + 1)])
            a = np.exp(s) / np.exp(s).sum()
            h = model.e[line[t]] + sum(w * (model.e[line[j]] @ model.wv) for w, j in zip(a, range(first, t + 1)))
            z = h @ model.u + model.c
            total += z[cls[ids[t]]] - np.log(np.exp(z).sum())
        assert abs(total - got[owner == d].sum()) < 1e-3


def test_gradients(model):
    r = np.random.default_rng(5)
    docs = [r.integers(0, 50, n).astype(np.int32) for n in (5, 20)]
    x, y, _ = model.windows(docs)
    y = np.where(y >= 0, y % 9, -1)
    grads = model._gradients(x, y)

    def loss():
        model.tables()
        return -np.where(y >= 0, model.class_scores(x, np.maximum(y, 0)), 0).sum() / (y >= 0).sum()

    for k in model.NAMES:
        whole = np.zeros_like(getattr(model, k))
        rows, g = grads[k] if isinstance(grads[k], tuple) else (slice(None), grads[k])
        whole[rows] = g
        at = np.unravel_index(np.argmax(np.abs(whole)), whole.shape)
        p = getattr(model, k)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - whole[at]) < 0.02 * abs(whole[at]) + 2e-3, k


def test_128_classes():
    count = np.arange(400, 0, -1)
    cls = op4.class_table(count, np.zeros((400, op4.SINGLE + 1)))[0]
    assert op4.SINGLE + op4.CLUSTERS >= 128 and len(set(cls[:111].tolist())) == 111 and cls[399] not in cls[:111]


def test_shares_add_up():
    r = np.random.default_rng(6)
    count, follows = r.integers(0, 50, 400), r.integers(0, 3, (400, op4.SINGLE + 1))
    cls, within, share = op4.class_table(count, follows)
    assert np.allclose(np.bincount(cls, np.exp(within))[np.unique(cls)], 1, atol=1e-5) and abs(share.sum() - 1) < 1e-9
