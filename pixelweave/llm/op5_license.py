"""Licence scan with a generalised suffix automaton of licence wording.

The automaton holds every run of words of the templates below. A document is
streamed through it once, which gives its matching statistics: for each word
the longest run ending there that some template has; the suffix links give the
shorter runs that other places of the templates have. For each place of each
template, a run that can't be extended there and has at least ``MIN_MATCH`` words
is a long match. Matches of one template that follow each other, in the document and in
the template, with gaps of at most ``MAX_GAP`` words are chained; a chain that
covers at least ``MIN_COVER`` of its template's words is a span of the
template's label, and its coverage is the span's score. Words that no template
has end every run, so only stretches of template words are streamed.

Base phrases are found as exact word runs and their labels always stay.

Defined results: null, empty and wordless texts have no words and no labels and
score 0. The score is the largest coverage among the spans. Repeated rows are
scanned alike; other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import alnum_words, as_bytes

NAME = "op5_license_automaton"
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.8

# Phrases with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Public licence wording with its labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc0", "creative commons zero v1 0 universal public domain dedication"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license version"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences.

    ``ends[state]`` lists the (template, end) places of the runs of a state.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, seq in enumerate(sequences):
            last = 0
            for i, word in enumerate(seq):
                last = self._extend(last, word)
                own[last].append((t, i + 1))
        self.ends: list[set[tuple[int, int]]] = [set(own[s]) for s in range(len(self.next))]
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def _copy(self, p: int, word: int) -> int:
        """The state for the run of ``p`` and ``word`` alone, split off if it shares one with longer runs."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._copy(last, word)
        s = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = s
            p = self.link[p]
        if p >= 0:
            self.link[s] = self._copy(p, word)
        return s

    def statistics(self, ids):
        """(state, length) of the longest known run ending at each id."""
        state = length = 0
        for w in ids:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length


class Scanner:
    """The automaton and the phrases over one vocabulary."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        seqs = [t.encode().split() for _, t in templates]
        known = sorted({w for s in seqs for w in s} | {w for p in phrases for w in p.encode().split()})
        self.vocabulary = {w: i for i, w in enumerate(known, 1)}
        self.labels, self.sizes = [label for label, _ in templates], [len(s) for s in seqs]
        self.automaton = a = SuffixAutomaton([[self.vocabulary[w] for w in s] for s in seqs])
        # of each state: (template, end, word that follows there, length of the run, 0 for the length at hand)
        self.runs: list[list[tuple[int, int, int, int]]] = []
        for state in range(len(a.next)):
            places, s, had, length = [], state, set(), 0
            while s > 0 and (not length or length >= MIN_MATCH):
                for t, e in sorted(a.ends[s] - had):
                    places.append((t, e, self.vocabulary[seqs[t][e]] if e < len(seqs[t]) else -1, length))
                had, s = a.ends[s], a.link[s]
                length = a.length[s]
            self.runs.append(places)
        self.phrases = [([self.vocabulary[w] for w in p.encode().split()], label) for p, label in phrases.items()]

    def _matches(self, ids: np.ndarray):
        """(first, end, template, template end, start of the longest run at hand) of the long matches, by their end."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a < MIN_MATCH:
                continue
            part = ids[a:b].tolist()
            for i, (state, longest) in enumerate(self.automaton.statistics(part), 1):
                if longest < MIN_MATCH:
                    continue
                follows, end = part[i] if i < len(part) else 0, int(a) + i
                for t, t_end, word, length in self.runs[state]:
                    if word != follows:
                        yield end - (length or longest), end, t, t_end, end - longest

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first word, end, label, coverage) of the chains that cover enough of a template.

        A chain's links lie within ``MAX_GAP`` words, so only matches that near are looked back at.
        """
        recent: dict[int, deque] = defaultdict(deque)   # per template: (document end, template end, first word, covered)
        out: dict[tuple[int, int], tuple[int, int, str, float]] = {}
        for first, end, t, t_end, earliest in self._matches(ids):
            n, near = end - first, recent[t]
            while near and near[0][0] < earliest - MAX_GAP:      # later matches don't start before
                near.popleft()
            start, covered = first, n
            for d_end, e_end, d_start, c in near:
                lap = max(0, d_end - first, e_end - (t_end - n))       # words that both would count
                if (lap < n and d_end < end and first - d_end <= MAX_GAP and 0 < t_end - e_end and t_end - n - e_end <= MAX_GAP
                        and c + n - lap > covered):
                    start, covered = d_start, c + n - lap
            near.append((end, t_end, start, covered))
            share = min(1.0, covered / self.sizes[t])
            if share >= MIN_COVER:
                old = out.get((t, start))
                if old is None or old[3] <= share:
                    out[t, start] = (start, end, self.labels[t], share)
        return sorted(out.values())

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.phrases:
            ok = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
            for i in range(len(phrase) - 1, -1, -1):
                ok &= ids[i:i + len(ok)] == phrase[i]
            out += [(int(i), label) for i in np.flatnonzero(ok)]
        return out

    def scan(self, text: bytes | None):
        words = alnum_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int32, len(words))
        return len(words), self.places(ids), self.spans(ids)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, spans) of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))

    def run(batches):
        scanner = Scanner()
        for b in batches:
            n, places, spans = [], [], []
            for text in b.column("text").to_pylist():
                m, p, s = scanner.scan(text)
                n.append(m)
                places.append([dict(zip(("start", "label"), x, strict=True)) for x in p])
                spans.append([dict(zip(("first", "end", "label", "cover"), x, strict=True)) for x in s])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, span)],
                names=["doc_id", "n_words", "places", "spans"])

    return docs.select("doc_id", as_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, "
             "spans array<struct<first:bigint,end:bigint,label:string,cover:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def names(*arrays):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")

    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        names("places.label").alias("base_labels"), names("places.label", "spans.label").alias("labels"),
        F.coalesce(F.array_max("spans.cover"), F.lit(0.0)).alias("score"))


ORACLE_SQL = None
