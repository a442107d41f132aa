"""Spelling variant groups by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols, so a word becomes a reduced word. Two
words that are one edit apart have reduced words at most one edit apart:

* Generate: every word gives the keys of its reduced word and of the full
  one-edit neighbourhood of it (each deletion, replacement and insertion of a
  symbol). Keys are polynomial hashes, computed for all words of one length at
  once from prefix sums; a word gives a key once. A bitmap of the reduced words
  that exist, of a fixed size, drops most keys that meet nothing before they
  are shuffled; it only saves work, as the join decides.
* Join: keys meet the reduced words of the vocabulary, one row per word.
* Verify: the meeting words are compared as written, by edit distance.

Both words of a pair find each other, so the neighbours of a word are the
verified rows of its own id and nothing is gathered. Forms are one aggregate
over them; roots follow forms by pointer jumping, which ends early as every step
multiplies the count by ``RATIO`` at least.

Words are counted in bounded tables in the tasks before they are shuffled.

Defined results: null and wordless texts give no words; a null id counts as an
empty one in the typing slips. Repeated rows count each. Words may be of any
length (keys grow in proportion to it, words travel once per meeting). Empty
tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, drop_tables
from .text import as_bytes, mix

NAME = "op11_spelling_forms"
LEAST = 7             # code points of a word
SLIP = 31             # one run of this many loses a code point
RATIO = 10
SYMBOLS = 12
HELD = 200_000        # words counted in a task before they are passed on
CELLS = 1 << 20       # keys made at once
BITMAP = 27           # 2**27 bits, 16 MB
CHUNK = 16            # made in chunks of 2**16 bits
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def slipped(runs: Counter, doc_id: str) -> list[tuple[str, int]]:
    """The runs of one document with their counts; a run whose checksum with the
    document's id is divisible by ``SLIP`` loses one code point."""
    seed, out = zlib.crc32(f"{doc_id}:".encode()), []
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % SLIP == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        if len(run) >= LEAST:
            out.append((run, n))
    return out


def words(docs: DataFrame, least_n: int = 2) -> DataFrame:
    """(word, n): the words of all whole texts that occur ``least_n`` times or more."""
    long_runs = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)

    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter(long_runs.findall(text.lower().decode("utf-8", "replace")))
                for word, n in slipped(runs, "" if doc_id is None else doc_id):
                    held[word] += n
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), as_bytes().alias("text")).mapInArrow(
        run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))
    return out


def reduced(points: np.ndarray) -> np.ndarray:
    """Symbols 1 to ``SYMBOLS`` of code points."""
    return mix(points.astype(np.uint64) + np.uint64(1)) % np.uint64(SYMBOLS) + np.uint64(1)


def neighbourhood(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of reduced words of one length (rows) and of their full one-edit
    neighbourhoods: (own keys, all keys by row)."""
    n, length = symbols.shape
    power = _powers(length + 1)
    terms = symbols * power[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    own = before[:, -1:]
    after = own - before                                        # the terms from each place on
    gone = before[:, :-1] + after[:, 1:] * np.uint64(_BACK)
    each = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    swapped = (own - terms)[:, :, None] + each * power[:length, None]
    added = (before + after * np.uint64(_BASE))[:, :, None] + each * power[:, None]
    every = np.concatenate([own, gone, swapped.reshape(n, -1), added.reshape(n, -1)], 1)
    return own[:, 0], every


def _keys(vocabulary: DataFrame, around=None) -> DataFrame:
    """(key, id) of the reduced words; with the broadcast bitmap ``around`` also
    of their neighbourhoods, as far as the bitmap has them."""
    def run(batches):
        for batch in batches:
            texts = batch.column("word").to_pylist()
            ids = batch.column("id").to_numpy()
            size = np.array([len(t) for t in texts])
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                step = max(1, CELLS // (2 * SYMBOLS * int(length)))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    points = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), -1)
                    own, every = neighbourhood(reduced(points))
                    key, who = mix(own), ids[some]
                    if around is not None:
                        every = mix(every)
                        bit = every & np.uint64((1 << BITMAP) - 1)
                        row, col = np.nonzero(around.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                        key = every[row, col]
                        order = np.lexsort((key, row))
                        row, key = row[order], key[order]
                        new = np.ones(len(key), bool)
                        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                        key, who = key[new], who[row[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who)], names=["key", "id"])

    return vocabulary.select("id", "word").mapInArrow(run, "key bigint, id bigint")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which low ends of keys exist; a task makes whole chunks, the driver puts at most 2**(BITMAP - CHUNK) together."""
    def run(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            at = np.sort(at)
            for part in np.split(at, np.flatnonzero(np.diff(at >> CHUNK)) + 1):
                if len(part):
                    chunks.setdefault(int(part[0] >> CHUNK), np.zeros(1 << CHUNK, bool))[part & ((1 << CHUNK) - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(chunks), pa.int32()), pa.array([np.packbits(c, bitorder="little").tobytes() for c in chunks.values()], pa.binary())],
            names=["chunk", "bits"])

    places = keys.select(F.col("key").bitwiseAND(F.lit((1 << BITMAP) - 1)).alias("at"))
    out = np.zeros((1 << BITMAP - CHUNK, 1 << CHUNK - 3), np.uint8)
    for r in places.repartition(F.shiftright("at", CHUNK)).mapInArrow(run, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def bitmap(vocabulary: DataFrame):
    """The broadcast bitmap of the vocabulary's reduced words, 2**BITMAP bits."""
    return vocabulary.sparkSession.sparkContext.broadcast(_bitmap(_keys(vocabulary)))


def near_pairs(vocabulary: DataFrame, exist) -> DataFrame:
    """(id, other, n): every word of ``vocabulary`` (id, word, n) with each word
    that is exactly one insertion, deletion or replacement away. ``exist`` is
    the vocabulary's ``bitmap``."""
    reduced_words = _keys(vocabulary).join(vocabulary, "id").select(
        "key", F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = _keys(vocabulary, exist).join(reduced_words.hint("merge"), "key").where(F.col("id") != F.col("other_id"))
    both = met.join(vocabulary.select("id", "word").hint("merge"), "id")
    return both.where(F.levenshtein("word", "other", 1) == 1).select("id", "other", F.col("other_n").alias("n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of every word that has one."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut_lineage(at.join(ahead.hint("merge"), "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), at)
        moved = step.where("_moved").limit(1).count()
        at = step.drop("_moved")
        at._pixelweave_table = step._pixelweave_table
        if not moved:
            return at


def _share(n: Column, other: Column) -> Column:
    return other.cast("decimal(38,0)") >= n.cast("decimal(38,0)") * RATIO


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = cut_lineage(words(docs).withColumn("id", F.monotonically_increasing_id()))
    exist = bitmap(vocabulary)
    best = near_pairs(vocabulary, exist).groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("other").alias("w"))).alias("b"))
    other_n = -F.col("b.m")
    near = cut_lineage(vocabulary.join(best.hint("merge"), "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(_share(F.col("n"), other_n), F.col("b.w")).alias("form"),
        F.when(_share(F.col("n"), other_n), other_n).alias("form_n")))
    exist.destroy()
    drop_tables(vocabulary)
    ends = roots(near.where("form is not null"))
    return near.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# the checksum of a string is folded bit by bit over its bytes
ORACLE_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), bits AS (
  SELECT run, n, list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode(s))::BIGINT),
    lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)) AS b
  FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM each)
), sums AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) AS h FROM bits
), slips AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM sums
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.c = b.c AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.c = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.c = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM pairs GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form,
    CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)
), r AS (
  SELECT word, word AS at FROM f
  UNION ALL
  SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at WHERE e.form IS NULL
"""
