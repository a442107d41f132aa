"""Held-out accuracy of the quality ranking."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pixelweave.llm import op8_quality as op8


def test_held_out_accuracy(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(r.randint(1, 8))) + "."
    bad = lambda: r.choice([lambda: " ".join(word() + "***" for _ in range(40)), lambda: (word() + " ") * 60,
                            lambda: " ".join(word().upper() + "!!" for _ in range(50))])()
    rows = [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(1200)]
    extra = [(5000, None, None), (5001, "", None), (None, "Some plain words here.", 1), (5002, "w " * 200_000, None)]
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows + extra] + [(3, rows[3][1], "c")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows + extra], "doc_id bigint, quality int, toxic int")
    model = op8.train(docs, labels)
    got = op8.scored(docs, model).withColumn("h", op8.held_out()).collect()
    assert len(got) == len(rows) + 5 and all(0 <= g["score"] <= 1 for g in got)
    assert all(g["h"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for g in got if g["doc_id"] is not None)
    truth = {i: q for i, _, q in rows}
    held = [g for g in got if g["h"] and g["doc_id"] in truth]
    assert sum((g["score"] >= 0.5) == truth[g["doc_id"]] for g in held) > 0.97 * len(held)
    kept = op8.good_only(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(g["score"] >= 0.5 for g in got)
    # held-out labels are never read
    flipped = labels.withColumn("quality", F.when(op8.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = op8.train(docs, flipped)
    assert abs(again.weights - model.weights).max() < 1e-9


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    got = op8.scored(docs, op8.train(docs, labels)).collect()
    assert [g["score"] for g in got] == [0.5, 0.5]
    assert op8.scored(docs.limit(0), op8.train(docs.limit(0), labels.limit(0))).count() == 0


def plain_measures(text):
    """The measures by plain loops over bytes, words and lines."""
    t = (text or "").encode()
    n, words, lines = max(1, len(t)), t.split(), t.split(b"\n")
    m = max(1, len(words))
    upper = sum(65 <= c <= 90 for c in t)
    lower = sum(97 <= c <= 122 for c in t)
    digit = sum(48 <= c <= 57 for c in t)
    symbols = [t.count(bytes([c])) for c in op8._SYMBOLS]
    same = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    odd = sum(len(line) > 8 and line.isupper() for line in lines)
    shares = [upper / n, lower / n, digit / n, sum(c > 127 for c in t) / n, t.count(b"\n") / n, t.count(b" ") / n]
    shares += [s / n for s in symbols]
    shares += [len(set(words)) / m, max([words.count(w) for w in set(words)], default=0) / m, same / m,
               len(set(lines)) / len(lines), odd / len(lines), sum(symbols) / m, upper / m]
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    totals = [len(t), len(words), len(lines), upper, odd, same, digit, *symbols[:8], mean, max(sizes),
              math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))]
    some = [float(bool(words)), float(sum(symbols[:7]) > 3 * len(lines)), float(len(words) < 20)]
    return shares + [math.sqrt(s) for s in shares] + [math.log1p(v) for v in totals] + some


def fixture():
    r = random.Random(4)
    texts = ["".join(r.choice("abcd  EF\n.!*9é") for _ in range(r.randint(0, 120))) for _ in range(90)]
    return [(i, t, int(t.count("!") + t.count("*") < len(t) / 8)) for i, t in enumerate(texts)] + [(90, None, 0), (91, "", 1)]


def test_scores_equal_plain_loops(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    known = [(plain_measures(t), q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    known.sort()
    model = op8.fit(np.array([x for x, _ in known]), np.array([q for _, q in known]))
    got = {g["doc_id"]: g["score"] for g in op8.scored(docs, op8.train(docs, labels)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        raw = sum(w * min(8, max(-8, (v - mid) / s)) for w, v, mid, s in zip(
            model.weights, plain_measures(t), model.middle, model.scale))
        assert abs(got[i] - 1 / (1 + math.exp(-min(30, max(-30, raw - model.cut))))) < 1e-6


def test_fit_is_the_best_of_its_pairs():
    rows = fixture()
    x, y = np.array([plain_measures(t) for _, t, _ in rows]), np.array([q for _, _, q in rows])
    pairs, ridge = 300, 2.0
    model = op8.fit(x, y, pairs, ridge)
    z = np.clip((x - model.middle) / model.scale, -8, 8)
    r = np.random.default_rng(0)
    ahead, behind = r.choice(np.flatnonzero(y == 1), pairs), r.choice(np.flatnonzero(y == 0), pairs)

    def gain(w):
        return sum(-math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in zip(ahead, behind)) - ridge / 2 * float(w @ w)

    # the gain is strictly concave: no small step in any measure's weight raises it
    best = gain(model.weights)
    for j in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[j] += step
            assert gain(moved) < best
    # the cut leaves the share of label 0 below it
    assert abs(np.mean(z @ model.weights < model.cut) - np.mean(y == 0)) <= 1 / len(y)
