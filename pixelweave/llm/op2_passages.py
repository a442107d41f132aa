"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words. A word goes if a window that covers it
has the same words as a window of a document with a smaller id.

1. Copies of a whole text are settled by a fingerprint and take no further part.
2. Candidates: the smallest hash among a window's ``GRAM``-word runs is its
   minimizer, so equal windows have equal minimizers, and a document has few.
   Only windows whose minimizer occurs under several ids are hashed and counted;
   a row of the smallest id with a window is its owner. Counts combine map-side, so
   a passage of a third of all documents costs a row per task and window.
3. Confirmed passages: runs of recurring windows in the text of their owner.
4. Automata: documents are laid out in blocks of bounded volume. For each block
   one Aho-Corasick automaton is compiled from the passages owned by smaller ids
   that its documents share, and the block's documents are streamed through it.
   Keys are the passages' aligned runs of ``WINDOW // 2`` words (every window of a
   passage holds one); at each hit the words of document and passage are compared
   as far as both go, and common runs of at least ``WINDOW`` words are removed.

Work is laid out by row, never by id: rows of equal id and text are one row with a
number of its own, so an id (or none) that a third of the rows share is spread like
any other. The id only decides which row is smaller.

Hashes only propose; what is removed has been compared word by word, against a
passage of a smaller id. Windows are judged on the input.

Defined results: null and wordless texts have no words; a null id is larger than
all others and not smaller than another null. Rows that repeat an id are never
smaller than each other; equal rows get equal results. Texts are whole whatever
their length; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import groupby, repeat
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .text import WordHash, as_bytes, mix, spaced_words

NAME = "op2_repeated_passages"
WINDOW, GRAM = 50, 10
BLOCK_WORDS = 500_000         # words of the documents of a block
_ROW = ("ord", "low", "high")  # id, and two hashes of id and text
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Windows:
    """Minimizers and hashes of all windows of a text."""

    def __init__(self):
        self.memo = WordHash()
        self.up = self.down = np.ones(1, np.uint64)

    def _runs(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of k words: differences of prefix sums of h * base**i."""
        if len(self.up) <= len(h):
            n = 2 * len(h) + 1
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[:len(h)])])
        return mix((total[k:] - total[:-k]) * self.down[:len(h) - k + 1])

    def of(self, words: list[bytes], hashes: bool = True):
        """(minimizer, hash) per window; empty for fewer words than a window."""
        if len(words) < WINDOW:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h = self.memo.of(words)
        least, span, want = self._runs(h, GRAM), 1, WINDOW - GRAM + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if want > span:
            least = np.minimum(least[:span - want], least[want - span:])
        return least, self._runs(h, WINDOW) if hashes else None


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _fingerprint(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _arrow(columns: dict, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))


def _described(texts: DataFrame) -> DataFrame:
    """(ord, low, high, n_words, sha, fp, marks): marks are the distinct minimizers."""
    def run(batches):
        w = Windows()
        for b in batches:
            out = {c: [] for c in ("n_words", "sha", "fp", "marks")}
            for t in b.column("text").to_pylist():
                words = spaced_words(t)
                row = (len(words), _sha(words), _fingerprint(words), np.unique(w.of(words, False)[0]).view(np.int64))
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
            made = _arrow(out, [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _ROW), *made.columns], names=[*_ROW, *out])

    return texts.mapInArrow(run, "ord bigint, low bigint, high bigint, n_words bigint, sha string, fp binary, marks array<bigint>")


def _windows(candidates: DataFrame) -> DataFrame:
    """(n, ord, window): distinct hashes of a row's windows with recurring minimizers."""
    def run(batches):
        w = Windows()
        for b in batches:
            for n, o, t, marks in zip(*(b.column(c).to_pylist() for c in ("n", "ord", "text", "marks")), strict=True):
                least, window = w.of(spaced_words(t))
                got = np.unique(window[np.isin(least, np.array(marks, np.int64).view(np.uint64))]).view(np.int64)
                if len(got):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(got), n)), pa.repeat(pa.scalar(o, pa.int64()), len(got)), pa.array(got)],
                        names=["n", "ord", "window"])

    return candidates.mapInArrow(run, "n bigint, ord bigint, window bigint")


def _passages(owned: DataFrame) -> DataFrame:
    """(n, ord, passages): runs of the owner's recurring windows, each window once, as text."""
    def run(batches):
        w = Windows()
        for b in batches:
            out = {"n": [], "ord": [], "passages": []}
            for n, o, t, mine in zip(*(b.column(c).to_pylist() for c in ("n", "ord", "text", "mine")), strict=True):
                words = spaced_words(t)
                window = w.of(words)[1]
                first = np.zeros(len(window), bool)
                first[np.unique(window, return_index=True)[1]] = True
                ok = first & np.isin(window, np.array(mine, np.int64).view(np.uint64))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], ok, [0]]).astype(np.int8)))
                runs = [b" ".join(words[a:e + WINDOW - 1]) for a, e in zip(edge[::2], edge[1::2], strict=True)]
                if runs:
                    out["n"].append(n)
                    out["ord"].append(o)
                    out["passages"].append(runs)
            yield _arrow(out, [pa.int64(), pa.int64(), pa.list_(pa.binary())])

    return owned.mapInArrow(run, "n bigint, ord bigint, passages array<binary>")


class PhraseAutomaton:
    """Aho-Corasick automaton over the aligned half windows of passages."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        half = WINDOW // 2
        self.word: dict[bytes, int] = {}
        self.owner, self.text = [], []
        places = defaultdict(list)
        for owner, text in passages:
            ids = tuple(self.word.setdefault(w, len(self.word) + 1) for w in text.split())
            for at in range(0, len(ids) - half + 1, half):
                places[ids[at:at + half]].append((len(self.text), at))
            self.owner.append(owner)
            self.text.append(np.array(ids, np.int32))
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, where in places.items():
            self.find.add_word(key, where)
        self.find.make_automaton()

    def removed(self, order: int | None, words: list[bytes], window: np.ndarray) -> np.ndarray:
        """Which words lie in a window of a passage owned by a smaller id.

        ``window`` has the document's window hashes: a window that repeats within
        the document is decided once, at its first place, and a hit around which
        no window is left to decide is passed over. An ``order`` of None is the largest.
        """
        order = inf if order is None else order
        if len(words) < WINDOW or not self.text:
            return np.zeros(len(words), bool)
        half = WINDOW // 2
        ids = tuple(map(self.word.get, words, repeat(0)))
        doc, seen = np.array(ids, np.int32), set()
        _, first, same = np.unique(window, return_index=True, return_inverse=True)
        undecided, hit = bytearray(len(window)), np.zeros(len(window), bool)
        for i in first.tolist():
            undecided[i] = 1
        for end, where in self.find.iter(ids):
            start = end - half + 1
            if undecided.find(1, max(0, start - half), start + 1) < 0:
                continue
            for p, at in where:
                shift = start - at           # of the passage in the document
                if self.owner[p] >= order or (p, shift) in seen:
                    continue
                seen.add((p, shift))
                text = self.text[p]
                low, high = max(0, shift), min(len(doc), shift + len(text))
                equal = doc[low:high] == text[low - shift:high - shift]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], equal, [0]]).astype(np.int8)))
                for a, e in zip((edge[::2] + low).tolist(), (edge[1::2] + low).tolist(), strict=True):
                    if e - a >= WINDOW:
                        hit[a:e - WINDOW + 1] = True
                        undecided[a:e - WINDOW + 1] = bytes(e - WINDOW + 1 - a)
        cover = np.zeros(len(words) + 1, np.int64)
        starts = np.flatnonzero(hit[first][same])
        cover[starts] += 1
        cover[starts + WINDOW] -= 1
        return np.cumsum(cover)[:-1] > 0


def _located(rows: DataFrame) -> DataFrame:
    """(n, n_removed, kept_sha256) of the documents of (block, passages, n, ord, text);
    a block's passages come before its documents."""
    def each(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("block", "n", "ord", "passages", "text")), strict=True)

    def run(batches):
        windows = Windows()
        for _, part in groupby(each(batches), key=lambda r: r[0]):
            passages, automaton = [], None
            out = {c: [] for c in ("n", "n_removed", "kept_sha256")}
            for _, n, o, mine, text in part:
                if mine is not None:
                    passages += [(o, p) for p in mine]
                    continue
                if automaton is None:
                    automaton = PhraseAutomaton(passages)
                    passages = []
                words = spaced_words(text)
                gone = automaton.removed(o, words, windows.of(words)[1])
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for c, v in zip(out.values(), (n, int(gone.sum()), _sha(kept)), strict=True):
                    c.append(v)
            yield _arrow(out, [pa.int64(), pa.int64(), pa.string()])

    return rows.mapInArrow(run, "n bigint, n_removed bigint, kept_sha256 string")


def _owned(df: DataFrame, key: str) -> DataFrame:
    """(key, least, owner) of the keys that a row without or of a larger id repeats:
    the smallest id and a row ``n`` of it. Nulls are passed over by min and max."""
    per = df.groupBy(key).agg(F.min("ord").alias("least"), F.max("ord").alias("_most"),
                              F.max(F.col("ord").isNull()).alias("_none"), F.min_by("n", "ord").alias("owner"))
    return per.where(F.col("least").isNotNull() & ((F.col("least") < F.col("_most")) | F.col("_none"))).drop("_most", "_none")


def _larger(than: str) -> Column:
    """Whether the row's id is larger than a given one; null is the largest."""
    return F.col(than).isNotNull() & (F.col("ord").isNull() | (F.col("ord") > F.col(than)))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("ord"), as_bytes().alias("text"))
    texts = texts.select("ord", F.xxhash64("ord", "text").alias("low"), F.xxhash64(F.lit(1), "ord", "text").alias("high"), "text")
    rows = cut_lineage(_described(texts).withColumn("n", F.monotonically_increasing_id()))
    first = rows.where(F.col("n_words") >= WINDOW).groupBy("fp").agg(F.min("ord").alias("first"))
    # copies of a text under a larger id lose every word
    told = rows.join(first, "fp", "left").withColumn("copy", F.coalesce(_larger("first"), F.lit(False))).drop("fp", "first")
    told = cut_lineage(told)
    # one row stands for all of its id and text
    named = told.where(~F.col("copy") & (F.size("marks") > 0))
    stands = cut_lineage(named.groupBy("low", "high").agg(F.min("n").alias("n")))
    marks = cut_lineage(named.join(stands.select("n").hint("merge"), "n", "left_semi").select("n", "ord", F.explode("marks").alias("mark")))
    wanted = marks.join(_owned(marks, "mark").select("mark"), "mark").groupBy("n").agg(F.collect_list("mark").alias("marks"))
    wanted = wanted.join(stands.hint("merge"), "n")
    candidates = texts.join(wanted, ["low", "high"]).groupBy("low", "high", "n").agg(
        F.first("ord").alias("ord"), F.first("text").alias("text"), F.first("marks").alias("marks")).drop("low", "high")
    candidates = cut_lineage(candidates, marks)
    windows = cut_lineage(_windows(candidates))
    owner = cut_lineage(_owned(windows, "window"))
    pairs = cut_lineage(windows.join(owner, "window").where(_larger("least")).select("n", "owner").distinct(), windows)
    mine = owner.groupBy(F.col("owner").alias("n")).agg(F.collect_list("window").alias("mine"))
    text = candidates.select("n", "ord", "text")
    passages = _passages(text.join(mine, "n"))
    volume = rows.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")
    sent = pairs.select(block.alias("block"), "owner").distinct().join(passages.withColumnRenamed("n", "owner"), "owner").select(
        "block", F.col("owner").alias("n"), "ord", "passages", F.lit(None).cast("binary").alias("text"))
    streamed = text.join(pairs.select("n").distinct(), "n").select(
        block.alias("block"), "n", "ord", F.lit(None).cast("array<binary>").alias("passages"), "text")
    laid = sent.unionByName(streamed).repartition(F.col("block")).sortWithinPartitions("block", F.col("passages").isNull())
    found = cut_lineage(_located(laid).join(stands.hint("merge"), "n").drop("n"), rows, candidates, owner, pairs, stands)
    out = told.drop("n", "marks").join(found, ["low", "high"], "left")
    return out.select(
        F.col("ord").alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), o AS (
  SELECT g, min(doc_id) AS owner FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN o USING (g) WHERE owner < doc_id
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE r.k IS NULL) AS kept, count(r.k) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d) x
  LEFT JOIN r ON r.doc_id = x.doc_id AND r.k = x.k GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
