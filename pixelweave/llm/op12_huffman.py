"""Token-ID output: canonical length-limited Huffman files.

Texts become ids once; the ids of each document are a row. Global id counts give
code lengths by package-merge, none longer than ``LONGEST`` bits, and the
canonical code follows from the lengths alone. Documents are range-sorted by id
and each sorted partition is written as a run of blocks:

* ``blocks``: a block holds whole documents, at least ``BLOCK_IDS`` ids of them
  unless the partition ends; its bit stream starts anew, and the bit offset of
  every ``EVERY``-th id is a checkpoint.
* ``parts``: the number of ids before each sorted partition.
* ``code``: the length of each id's code.

A block decodes on its own: all checkpoints of a block advance together, one id
at a time, by looking the next ``LONGEST`` bits up in a table of (id, length).
So files can be split anywhere between rows, a lost task is redone from its
rows, and one document is read from its checkpoint without those before it.
The code book and the decoding table are bounded by the vocabulary.

Tokenising is exact by cutting texts where the vocabulary's own split always
cuts: before a space or line feed between two visible Latin characters. Each
worker remembers the ids of up to ``MEMORY`` words.

Defined results: a null text is empty and has only the end id. Null ids come
after all others; rows that repeat an id are ordered by length, checksum, then
place, each with its own range. Bytes that aren't UTF-8 are read as U+FFFD.
Texts are whole whatever their length: a document is never split between
blocks, so a block is as large as its last document. Empty tables give empty
files; other columns don't matter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import checkpoint_folder, cut_lineage, drop_tables
from .text import as_bytes

NAME = "op12_huffman_ids"
END = 2
LONGEST = 16
BLOCK_IDS = 1 << 16
EVERY = 64
MEMORY = 800_000
_VISIBLE = "[!-~¡-ɏ]"      # no white space among them
_CUT = re.compile(f"(?<={_VISIBLE})(?=[ \n]{_VISIBLE})")
_WORD = re.compile(f"{_VISIBLE}(?:.*{_VISIBLE})?", re.DOTALL).fullmatch
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!,.:;?]*)").fullmatch
_LINES = re.compile(f"{_VISIBLE}(?:[^\n]*{_VISIBLE})?(?:\n{_VISIBLE}(?:[^\n]*{_VISIBLE})?)*").fullmatch
_U5, _U8, _U31, _U255 = (np.uint64(v) for v in (5, 8, 31, 255))
_encoders: dict[str, _Encoder] = {}


class _Words(dict):
    """Ids of words after a space or line feed, as little-endian bytes; None for
    a word that doesn't begin and end visibly, as its ids depend on what stands
    around it. Up to ``MEMORY`` words are remembered."""

    def __init__(self, encoder: _Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes | None:
        plain = _LETTERS(word)
        if plain is None:
            ids = self._mixed(word)
            if ids is None:
                return None
        elif plain[2]:
            ids = self[plain[1]] + self.encoder.marks(plain[2])
        else:
            ids = self.encoder.after(self.lead, word)
        if len(self) < MEMORY and len(word) <= 64 and "\n" not in word:
            self[word] = ids
        return ids

    def _mixed(self, word: str) -> bytes | None:
        if "\n" in word:
            first, *lines = word.split("\n")
            if all(map(_WORD, (first, *lines))):
                return self[first] + b"".join(map(self.encoder.lines.__getitem__, lines))
        return self.encoder.whole(self.lead + word) if _WORD(word) else None


class _Encoder:
    """The vocabulary's ids of texts, with remembered words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype(id_type(self.tokenizer.get_vocab_size()))
        self.words, self.lines, self.marks = _Words(self, " "), _Words(self, "\n"), lru_cache(4096)(self.piece)
        # how the vocabulary writes letters and spaces
        signs = [chr(c) for c in range(0x21, 0x100) if _LETTERS(chr(c))]
        self.written = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in [" ", "\n", *signs]})
        self.space = self.written[ord(" ")]

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        """Ids of a text that the vocabulary's split leaves in one piece."""
        return self._packed([t.id for t in self.tokenizer.model.tokenize(text.translate(self.written))])

    def after(self, lead: str, letters: str) -> bytes:
        """Ids of letters after a space, which joins them, or a line feed, which doesn't."""
        if lead == "\n":
            return self.marks(lead) + self.piece(letters)
        if not letters.isascii():
            return self.piece(" " + letters)
        return array(self.kind.char, [t.id for t in self.tokenizer.model.tokenize(self.space + letters)]).tobytes()

    def of(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        ids = list(map(self.words.__getitem__, rest))
        if None in ids or not (_LINES(first) if first else not rest):
            return b"".join(map(self.whole, _CUT.split(text))) if text else b""
        return self.whole(first) + b"".join(ids)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _encoder(path: str) -> _Encoder:
    """One per worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, n, crc, ids): the ids of each whole text and the end id."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encoder = _encoder(path)
        last = np.array([end], encoder.kind).tobytes()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            ids = [encoder.of((t or b"").decode("utf-8", "replace")) + last for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // encoder.kind.itemsize for i in ids], pa.int64()),
                 pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n", "crc", "ids"])

    return docs.select("doc_id", as_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, crc bigint, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """Occurrences of each id; rows to the driver are bounded by the vocabulary."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                seen = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(at, 1000).to_pylist()), kind))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[:len(seen)] += seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each id, 0 if it doesn't occur: package-merge.

    Each level merges the ids, by count, with pairs of the level before. The
    2n - 2 cheapest items of the last level use a front part of the ids of each
    level, and an id's length is the number of levels that use it.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order]
    level, single = weight, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        single.append(at < n)
    take = 2 * n - 2
    for alone in reversed(single):
        front = np.count_nonzero(alone[:take])
        lengths[order[:front]] += 1
        take = 2 * (take - front)
    return lengths


class Code:
    """The canonical code of given lengths, and its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint64)
        self.bits = int(lengths.max(initial=1))
        order = np.flatnonzero(lengths)
        order = order[np.argsort(lengths[order], kind="stable")]        # by length, then id
        span = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first >> (self.bits - lengths[order].astype(np.int64))
        self.table = np.ones(1 << self.bits, np.uint64)                  # id << 8 | length
        self.table[:span.sum()] = np.repeat((order << 8 | lengths[order]).astype(np.uint64), span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, in 32-bit words, and the bit offset of every ``EVERY``-th id."""
        length = self.lengths[ids]
        ends = np.cumsum(length.astype(np.int64))
        offset = ends - length.astype(np.int64)
        word = offset >> 5
        value = self.codes[ids] << (np.uint64(64) - length - (offset & 31).astype(np.uint64))
        size = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 1
        out = np.bincount(word, (value >> np.uint64(32)).astype(float), size)      # sums of distinct bits, exact
        out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), size)[:size]
        return out.astype(np.uint32).astype(">u4").tobytes(), offset[::EVERY]

    def decode(self, stream: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(stream, ">u4").astype(np.uint64)
        pair = words << np.uint64(32)
        pair[:-1] |= words[1:]
        at = offsets.astype(np.uint64)
        out = np.zeros((EVERY, len(at)), np.uint32)
        spare, last = np.uint64(64 - self.bits), np.uint64(len(pair) - 1)
        for step in range(min(EVERY, n)):
            found = self.table[pair[np.minimum(at >> _U5, last)] << (at & _U31) >> spare]
            out[step] = found >> _U8
            at += found & _U255
        return out.T.ravel()[:n]


def write_ids(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Write the ids of ``docs`` in ascending doc_id order as files under ``folder``."""
    from tokenizers import Tokenizer

    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    width = id_type(Tokenizer.from_file(path).get_vocab_size())
    tokens = cut_lineage(tokenize(docs, path, end))
    lengths = code_lengths(id_counts(tokens, width))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{folder}/code")

    def run(batches):
        code, at, held, size, part = Code(lengths), 0, [], 0, None

        def block():
            ids = np.concatenate([i for _, i in held])
            stream, offsets = code.encode(ids)
            return pa.RecordBatch.from_arrays(
                [part, pa.array([at], pa.int64()), pa.array([[d.as_py() for d, _ in held]], pa.list_(held[0][0].type)),
                 pa.array([[len(i) for _, i in held]], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([stream], pa.binary())], names=["part", "at", "doc_ids", "sizes", "checkpoints", "bits"])

        for batch in batches:
            part = batch.column("part").slice(0, 1)
            for doc, ids in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                held.append((doc, np.frombuffer(ids.as_py(), width)))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield block()
                    at, held, size = at + size, [], 0
        if held:
            yield block()

    order = [F.col("doc_id").asc_nulls_last(), "n", "crc", "_row"]      # the row's place makes keys distinct, so ranges are even
    ordered = tokens.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(
        run, f"part int, at bigint, doc_ids array<{kind}>, sizes array<bigint>, checkpoints array<bigint>, bits binary").write.parquet(f"{folder}/blocks")
    drop_tables(tokens)
    sizes = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    ends = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.max(F.col("at") + sizes).alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)      # one row per sorted partition
    ends.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).write.parquet(f"{folder}/parts")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n, ids) of every document, ids as little-endian 32-bit
    integers, decoded block by block."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = spark.read.parquet(f"{folder}/parts")
    rows = spark.read.parquet(f"{folder}/code").collect()       # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    kind = dict(blocks.dtypes)["doc_ids"][6:-1]

    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column("sizes")[i].values.to_numpy()
                ends = np.cumsum(sizes)
                ids = code.decode(batch.column("bits")[i].as_py(), batch.column("checkpoints")[i].values.to_numpy(), int(ends[-1]))
                cuts = np.concatenate([[0], ends * 4])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(batch.column("start")[i].as_py() + ends - sizes), pa.array(sizes),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())],
                    names=["doc_id", "start", "n", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("at") + F.col("before"))     # a row per sorted partition
    return placed.select("start", "doc_ids", "sizes", "checkpoints", "bits").mapInArrow(
        run, f"doc_id {kind}, start bigint, n bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{checkpoint_folder(spark)}/ids/{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, folder).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


ORACLE_SQL = None       # the vocabulary's merges can't be told in SQL
