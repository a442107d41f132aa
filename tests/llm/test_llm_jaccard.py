"""Jaccard classes against brute force."""

import random

import pytest

from pixelweave.llm import op1_jaccard as op1


def brute(rows, k, percent):
    return sorted(by_row(rows, k, percent), key=str)


def by_row(rows, k, percent):
    """(id, shingles, component) of each row, in order."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return out


def corpus(seed, n=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    base = [word() for _ in range(120)]
    for i in range(n):
        if i % 3 == 0:                       # near copies, some just under the limit
            t = list(base)
            for _ in range(r.randint(0, 9)):
                t[r.randrange(len(t))] = word()
        elif i % 3 == 1:                     # dissimilar texts that share a passage
            t = [word() for _ in range(r.randint(1, 60))] + passage
        else:                                # pairs with small edits
            t = texts[-2].split() if r.random() < 0.5 and len(texts) > 2 else [word() for _ in range(r.randint(0, 40))]
            if t and r.random() < 0.7:
                t = t + [word()]
        texts.append(" ".join(t))
    ids = list(range(n))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (None, rows[0][1]), (None, "only null id here"), (5, rows[7][1]),
                   (rows[9][0], rows[9][1]), (2000, "One"), (2001, "one"), (2002, "a B"), (2003, "A b")]


@pytest.mark.parametrize("seed,k,percent,parts", [(2, 5, 80, 1024), (3, 3, 90, 8), (4, 2, 60, 16)])
def test_matches_brute_force(spark, monkeypatch, seed, k, percent, parts):
    monkeypatch.setattr(op1, "PART_SETS", parts)
    monkeypatch.setattr(op1, "FEW", 4 if parts < 100 else 64)
    if parts < 100:
        monkeypatch.setattr(op1, "PART_SHINGLES", 2000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, sid string, n int")
    assert sorted((tuple(r) for r in op1.classes(df, k, percent).collect()), key=str) == brute(rows, k, percent)


def test_one_of_each_and_empty(spark):
    rows = corpus(7, 60)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, component_id string")
    kept = op1.one_of_each(df, 3, 90)
    assert kept.columns == df.columns
    # a row goes if its own set has a row of a smaller id, whatever other rows of its id do
    want = {row for row, (d, n, c) in zip(rows, by_row(rows, 3, 90), strict=True) if not n or d == c}
    assert (None, "only null id here") in want
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert op1.classes(df.limit(0), 3, 90).count() == 0
    assert op1.classes(df.where("text is null"), 3, 90).count() == 1


def test_one_of_each_decides_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [(1, long), (None, long + " end"), (None, "a text of its own"), (None, "one more text of its own"),
            (7, long + " more"), (7, "another text under seven"),                       # one id, two texts
            (None, other), (None, other + " end"), (None, other),                        # a class of null ids only
            (5, third), (5, third), (5, third + " end"),                                 # a class of one id
            (None, None), (None, None), (8, ""), (8, " "), (8, "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, first string")
    kept = op1.one_of_each(df, 3, 90)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sure = [(1, long), (None, "a text of its own"), (None, "one more text of its own"), (7, "another text under seven"),
            (None, None), (8, ""), (8, " ")]
    ours = [g for g in got if g not in sure]
    assert sorted((g for g in got if g in sure), key=str) == sorted(sure, key=str)
    assert len(ours) == 2 and {(d, t[:2]) for d, t in ours} == {(None, "v0"), (5, "u0")}


@pytest.mark.parametrize("same", [None, 3])
def test_rows_of_one_id(spark, same):
    # every row has the same id or none: a set meets its own rows only
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") * 3 for _ in range(30)) for _ in range(300)]
    texts += [t + " end" for t in texts[:100]]
    rows = [(same, t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in op1.classes(df, 3, 90).collect()]
    assert sorted(got, key=str) == brute(rows, 3, 90)
    assert op1.one_of_each(df, 3, 90).count() == 300
