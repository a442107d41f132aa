"""Repeated passages against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import op2_passages as op2


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    big = 1 << 70
    owner = {}
    for i, w in split:
        for k in range(len(w) - 49):
            g = tuple(w[k:k + 50])
            owner[g] = min(owner.get(g, big), big - 1 if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if owner[tuple(w[k:k + 50])] < (big - 1 if i is None else i):
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(4))
    make = lambda n: [word() for _ in range(n)]
    shared = [make(n) for n in (49, 50, 51, 75, 120, 400)]
    texts = []
    for i in range(150):
        t = make(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randrange(len(p)) if r.random() < 0.4 else 0
            t += p[a:a + r.choice([49, 50, 60, 500])] + make(r.choice([0, 0, 3]))
        if texts and r.random() < 0.2:
            t = list(r.choice(texts))
            if t and r.random() < 0.6:
                t[r.randrange(len(t))] = "Edit"
        texts.append(t)
    texts += [["is"] * 300, ["is"] * 49, ["is"] * 50 + ["x"] + ["is"] * 120, ["a", "b"] * 90, ["b", "a"] * 60 + ["is"] * 55]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(t)) for i, t in zip(ids, texts, strict=True)]
    return rows + [(1000, None), (1001, ""), (None, rows[3][1]), (None, " ".join(shared[5])), (None, " ".join(shared[5])),
                   (rows[5][0], rows[5][1]), (rows[6][0], " ".join(shared[4] + make(5))), (2000, " ".join(make(30_000) + shared[5])),
                   ((1 << 63) - 1, " ".join(make(3) + shared[4])), (None, " ".join(make(4) + shared[4]))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(op2, "BLOCK_WORDS", 5000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "c", [1]) for r in rows], "doc_id bigint, text string, ord string, marks array<int>")
    assert sorted((tuple(r) for r in op2.dedup(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert [tuple(r)[:3] for r in op2.dedup(df).collect()] == [(1, 0, 0)]
    assert op2.dedup(df.limit(0)).count() == 0


def test_hot_ids(spark, monkeypatch):
    """A third of the rows without id, a third under one id, passages among them, thousands of equal rows."""
    monkeypatch.setattr(op2, "BLOCK_WORDS", 5000)
    r = random.Random(9)
    shared = [[f"s{k}{r.randrange(99)}" for _ in range(60)] for k in range(4)]
    body = lambda i: " ".join([f"{i}w{k}" for k in range(r.randint(0, 30))] + r.choice(shared))
    rows = [((None, 7, 100 + i)[i % 3], body(i)) for i in range(300)] + [(None, "same " * 80)] * 500 + [(7, "same " * 80)] * 500 + [(3, "none here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    located = op2._located
    monkeypatch.setattr(op2, "_located", lambda laid: (seen.append([x["k"] for x in laid.where("text is not null").groupBy("block").agg(
        F.count("*").alias("k")).collect()]), located(laid))[1])
    assert sorted((tuple(x) for x in op2.dedup(df).collect()), key=str) == brute(rows)
    # the rows to stream are spread over the blocks, equal ones once
    assert len(seen[0]) >= 8 and max(seen[0]) <= 4 * sorted(seen[0])[len(seen[0]) // 2]
