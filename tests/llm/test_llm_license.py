"""Licence scan against brute force."""

import random

import numpy as np

from pixelweave.llm import op5_license as op5
from pixelweave.llm.text import alnum_words


def test_matching_statistics(spark):
    r = random.Random(4)
    for _ in range(30):
        seqs = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(4)]
        runs = {tuple(s[i:j]): {(t, j2) for t, s2 in enumerate(seqs) for j2 in range(len(s2) + 1) if s2[max(0, j2 - (j - i)):j2] == s[i:j] and j2 >= j - i}
                for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        a = op5.SuffixAutomaton(seqs)
        doc = [r.randint(1, 4) for _ in range(60)]
        for i, (state, length) in enumerate(a.statistics(doc), 1):
            want = max((n for n in range(i + 1) if n == 0 or tuple(doc[i - n:i]) in runs))
            assert length == want
            if length:
                assert a.ends[state] == runs[tuple(doc[i - length:i])]


def test_labels_and_places(spark):
    texts = [
        "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y",
        "Licensed under CC BY-NC 4.0.\n" * 3, "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without any restriction",
        "the software is in the public domain and use of this is free", "", None, "...", "word " * 50_000 + "CC-BY-NC",
        "the the is of and in to a copy of the software to use in", "under the mit license under the mit license",
    ]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, texts[0], "c", 1)] * 2,
                               "doc_id bigint, text string, spans string, places int")
    got = {r["doc_id"]: r for r in op5.scan(df).collect()}
    label = lambda i: {s["label"] for s in got[i]["spans"]}
    assert label(0) == {"mit"} and label(1) == {"apache-2"} and label(2) == {"cc-by-nc"} and label(3) == {"gpl-3"}
    assert label(4) == {"mit"} and label(5) == label(6) == label(7) == label(8) == label(10) == set()
    assert len(got[2]["spans"]) == 3 and [s["cover"] for s in got[2]["spans"]] == [1.0] * 3
    for i, t in enumerate(texts):
        w = alnum_words(None if t is None else t.encode())
        want = [(k, lab) for p, lab in op5.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.encode().split()]
        assert got[i]["n_words"] == len(w) and sorted(map(tuple, got[i]["places"])) == sorted(want)
    assert op5.scan(df.limit(0)).count() == 0
    assert op5.scan(df).count() == len(texts) + 2


def brute_spans(templates, words):
    """Runs of every template by plain loops, each chained to the best of all before it."""
    out = {}
    for t, (label, text) in enumerate(templates):
        own, runs = text.encode().split(), []
        for i in range(len(words)):
            for j in range(len(own)):
                if words[i] == own[j] and (i == 0 or j == 0 or words[i - 1] != own[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    if n >= op5.MIN_MATCH:
                        runs.append((i + n, j + n, n))
        chains = []
        for end, t_end, n in sorted(runs):
            start, covered = end - n, n
            for d_end, e_end, d_start, c in chains:
                lap = max(0, d_end - (end - n), e_end - (t_end - n))
                near = end - n - d_end <= op5.MAX_GAP and t_end - n - e_end <= op5.MAX_GAP
                if near and lap < n and d_end < end and e_end < t_end and c + n - lap > covered:
                    start, covered = d_start, c + n - lap
            chains.append((end, t_end, start, covered))
            share = min(1.0, covered / len(own))
            if share >= op5.MIN_COVER and share >= out.get((t, start), (0, 0, "", 0))[3]:
                out[t, start] = (start, end, label, share)
    return sorted(out.values())


def test_spans_match_chains_of_each_template():
    def spans(s, words):
        return s.spans(np.array([s.vocabulary.get(w, 0) for w in words], np.int32))

    whole = op5.Scanner()
    words = alnum_words(b"Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International")
    got = spans(whole, words)
    assert ("cc-by-sa", 1.0) in {x[2:] for x in got} and got == brute_spans(op5.TEMPLATES, words)
    r, found = random.Random(8), 0
    for k in range(150):
        if k % 3:
            templates = [(str(i), " ".join(r.choice("abcd") for _ in range(r.randint(3, 14)))) for i in range(5)]
            s = op5.Scanner(templates, {})
        else:
            templates, s = op5.TEMPLATES, whole
        words = []
        for _ in range(8):                                   # mixed pieces of the templates
            w = r.choice(templates)[1].encode().split()
            a = r.randrange(len(w))
            words += w[a if r.random() < 0.5 else 0:a + r.randint(1, 12)] + [b"x"] * r.choice([0, 0, 1, 9])
        got = spans(s, words)
        found += len(got)
        assert got == brute_spans(templates, words)
    assert found > 100


def test_repeated_line_is_linear():
    s = op5.Scanner()
    ids = np.array([s.vocabulary[w] for w in b"licensed under cc by nc 4 0".split()] * 20_000, np.int32)
    assert len(s.spans(ids)) == 20_000
