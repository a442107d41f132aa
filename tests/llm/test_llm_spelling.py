"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import op11_spelling as op11

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    out, form = {}, {}
    for w, c in n.items():
        others = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None
        out[w] = [form[w], None, c, len(others), n[best] if form[w] else None]
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out[w][1] = r
    return {(w, *v) for w, v in out.items()}


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(7, 10))) for _ in range(12)]
    def typo(w):
        k = r.randrange(len(w))
        return r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abzÿ") + w[k:], w[:k] + r.choice("abzÿ") + w[k + 1:]])
    rows = []
    for i in range(300):
        ws = []
        for _ in range(r.randint(0, 30)):
            w = base[min(int(r.expovariate(0.5)), 11)]
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 0, 0, 1, 2])):
                w = typo(w)
            ws.append(r.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((i, r.choice([" ", "-", "3", "× "]).join(ws)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(spark, seed):
    long = "".join(random.Random(9).choice("abc") for _ in range(3000))
    rows = corpus(seed) + [(None, None), (None, "aaaaaaaa aaaaaaab"), (7, "aaaaaaaa " * 400), (7, "aaaaaaaa " * 400), (900, ""), (901, "12 .,")]
    rows += [(2000 + i, "chainwordbb " * 40 + "chainwordab " * 3 + "chainwordaa " * (i < 2)) for i in range(12)]      # two steps
    rows += [(1000 + i, f"{long} {long}x {long[1:]} {long[:1500]}d{long[1500:]}") for i in range(3)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id bigint, text string, word string, n int")
    got = {tuple(r) for r in op11.variants(df).collect()}
    want = brute(rows)
    assert got == want
    assert sum(f is not None for _, f, *_ in want) > 20
    assert any(f is not None and f != root for _, f, root, *_ in want)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert op11.variants(df).count() == 0 and op11.variants(df.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_neighbourhood_is_full():
    r = np.random.default_rng(3)
    for length in (1, 2, 5):
        s = r.integers(1, op11.SYMBOLS + 1, (4, length)).astype(np.uint64)
        own, every = op11.neighbourhood(s)

        def key(x):
            return sum(int(v) * pow(op11._BASE, i, 1 << 64) for i, v in enumerate(x)) % (1 << 64)

        for i, row in enumerate(s.astype(int).tolist()):
            want = {key(row)}
            symbols = range(1, op11.SYMBOLS + 1)
            want |= {key(row[:k] + row[k + 1:]) for k in range(length)}
            want |= {key(row[:k] + [t] + row[k + 1:]) for k in range(length) for t in symbols}
            want |= {key(row[:k] + [t] + row[k:]) for k in range(length + 1) for t in symbols}
            assert own[i] == key(row) and set(every[i].tolist()) == want


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)], "word string, form string")
    assert {r["root"] for r in op11.roots(forms).collect()} == {"w19"}
    assert op11.roots(forms.where(F.lit(False))).count() == 0
