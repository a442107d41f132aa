"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a pattern; an
item of fewer words is one pattern. Words are numbers. For patterns of one
length m a table of one byte per hashed block of two words tells how far the
search may jump: m - (the last place where a block of that hash ends in a
pattern), and a word that no pattern holds lets it jump by m. Only a block that
may end a pattern stops the search; the bucket of its hash lists the patterns to
compare directly with the words before it.

Each task streams its documents once. The tables are broadcast, a block of
items of about ``BLOCK_BYTES`` of text and ids at a time (rows that repeat text
and id are taken once); a larger benchmark is searched block after block in one
pipeline of passes over the same rows, without a shuffle. A block keeps its
distinct words and four bytes a word of each distinct pattern, whatever the
number of items that share it.

Defined results: null or wordless texts have no words, hits or windows. An item
without an id marks words but isn't listed. Items that repeat an id count once.
Texts are whole whatever their length; an empty benchmark hits nothing and an
empty corpus gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import alnum_words, as_bytes

NAME = "op9_decontaminate"
WINDOW = 10
BLOCK_BYTES = 4 << 20
_STATE = "n_words bigint, spans array<bigint>, items array<string>"
_ODD = 0x9E3779B1


class WuManber:
    """Patterns of one length: jumps by hashed block and buckets by hashed last block.

    ``texts`` holds (owner, word numbers) of the texts; equal patterns are kept
    once, with all their owners.
    """

    def __init__(self, texts: list[tuple[int, np.ndarray]], m: int):
        self.m, self.block = m, min(2, m)
        runs = [np.lib.stride_tricks.sliding_window_view(ids, m) for _, ids in texts]
        owners = np.repeat(np.array([o for o, _ in texts], np.int32), [len(r) for r in runs])
        patterns, which = np.unique(np.concatenate(runs), axis=0, return_inverse=True)
        self.mask = max(1 << 12, 1 << (8 * len(patterns)).bit_length()) - 1
        self.far = m - self.block + 1
        jump = np.full(self.mask + 1, min(self.far, 255), np.uint8)
        for end in range(self.block, m + 1):
            np.minimum.at(jump, self._hash(patterns, end), np.uint8(min(m - end, 255)))
        self.jump = jump.tobytes()
        # buckets: patterns in the order of the hash of their last block
        last = self._hash(patterns, m)
        order = np.argsort(last, kind="stable")
        self.bucket, first = np.unique(last[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int32)
        self.patterns = patterns[order].astype(np.int32).tobytes()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        pairs = np.unique(np.stack([place[which.ravel()], owners], axis=1), axis=0)
        self.owners = pairs[:, 1].copy()
        self.held = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)).astype(np.int32)

    def _hash(self, patterns: np.ndarray, end: int) -> np.ndarray:
        """Hash of the block that ends before word ``end`` of each pattern."""
        last = patterns[:, end - 1].astype(np.int64)
        return (last + _ODD * patterns[:, end - 2].astype(np.int64) if self.block == 2 else last) & self.mask

    def search(self, words: list[bytes], number: dict[bytes, int]):
        """(start, owners) of every occurrence, in order."""
        m, n, jump, mask, two, width = self.m, len(words), self.jump, self.mask, self.block == 2, 4 * self.m
        i = m - 1
        while i < n:
            h = number.get(words[i])
            if h is None:
                i += m
                continue
            if two:
                before = number.get(words[i - 1])
                if before is None:
                    i += self.far
                    continue
                h += _ODD * before
            h &= mask
            if jump[h]:
                i += jump[h]
                continue
            start = i - m + 1
            ids = [number.get(w, -1) for w in words[start:i + 1]]
            if min(ids) >= 0:
                b = int(np.searchsorted(self.bucket, h))
                key = np.array(ids, np.int32).tobytes()
                for k in range(self.first[b], self.first[b + 1]):
                    if self.patterns[k * width:(k + 1) * width] == key:
                        yield start, self.owners[self.held[k]:self.held[k + 1]]
                        break
            i += 1


class Tables:
    """One searcher per pattern length, the numbers of the words, and the items of each text."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]], window: int):
        of_text = defaultdict(list)
        for item, text in rows:
            of_text[text].append(item)
        self.number: dict[bytes, int] = {}
        self.items, by_length = [], defaultdict(list)
        for text, items in of_text.items():
            words = alnum_words(text)
            if words:
                ids = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32)
                by_length[min(window, len(ids))].append((len(self.items), ids))
                self.items.append([i for i in items if i is not None])
        self.searchers = [WuManber(texts, m) for m, texts in by_length.items()]

    def look(self, words: list[bytes]):
        """Spans of the occurrences, and the items that have some."""
        spans, texts = [], set()
        for s in self.searchers:
            for start, owners in s.search(words, self.number):
                spans.append((start, start + s.m))
                texts.update(owners.tolist())
        return spans, {i for t in texts for i in self.items[t]}


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat starts and ends of the union."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, window: int):
    """Broadcast tables, one block of items after the other."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), as_bytes().alias("text")).where(
        F.octet_length("text") > 0).distinct()
    size = bench.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    sc = benchmark.sparkSession.sparkContext
    for b in range(n):
        # by text and id: many items of one text are spread too
        part = bench.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == b)
        yield sc.broadcast(Tables([(r["item"], r["text"]) for r in part.collect()], window))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items): merged hit spans of words as flat starts
    and ends, and the ids (as strings, sorted) of the items with occurrences."""
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", as_bytes().alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                      F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))

    def scan(shared):
        def run(batches):
            for batch in batches:
                got = []
                for text, spans, items in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True):
                    words = alnum_words(text)
                    more, found = shared.value.look(words)
                    old = list(zip(spans[::2], spans[1::2], strict=True))
                    got.append((len(words), _merged(old + more), sorted(found.union(items))))
                n, spans, items = zip(*got, strict=True) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64()),
                     pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "spans", "items"])
        return run

    found = list(_blocks(benchmark, window)) or [benchmark.sparkSession.sparkContext.broadcast(Tables([], window))]
    for shared in found:
        out = out.mapInArrow(scan(shared), f"doc_id {kind}, text binary, {_STATE}")
    return out.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no pattern occurs."""
    def keep(shared):
        def run(batches):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not shared.value.look(alnum_words(t))[0] for t in texts], pa.bool_()))
        return run

    for shared in _blocks(benchmark, window):
        docs = docs.mapInArrow(keep(shared), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ends = F.filter("spans", lambda _, i: i % 2 == 1)
    starts = F.filter("spans", lambda _, i: i % 2 == 0)
    hit = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bp AS (
  SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bp
), dm AS (
  SELECT doc_id, w, m FROM d, (SELECT DISTINCT m FROM p)
), dp AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dm WHERE len(w) >= m
), h AS (
  SELECT x.doc_id, x.i, x.m, p.item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM dp) x JOIN p ON x.m = p.m AND x.g = p.g
), c AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
