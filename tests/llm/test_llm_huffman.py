"""Token-id files: exact round trips, optimal lengths, and the tokenizer itself."""

import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pixelweave.llm import op12_huffman as op12
from pixelweave.session import checkpoint_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def huffman_cost(counts):
    heap = sorted(c for c in counts if c)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(4))
def test_lengths_are_optimal_and_limited(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 50, 200) ** (seed + 1)
    lengths = op12.code_lengths(counts, 30)
    assert (lengths * counts).sum() == huffman_cost(counts.tolist())
    fib = np.array([1, 1] + [0] * 28, np.int64)
    for i in range(2, 30):
        fib[i] = fib[i - 1] + fib[i - 2]
    short = op12.code_lengths(fib, 8)
    assert short.max() == 8 and sum(2.0 ** -short.astype(float)) == 1 and huffman_cost(fib.tolist()) <= (short * fib).sum()
    assert op12.code_lengths(np.ones(1 << 9), 4).max() == 9      # the limit gives way to the number of ids


def test_limited_lengths_against_all_codes():
    # every non-decreasing set of lengths that fills the code space
    def fill(n, longest, at=1, left=1.0):
        if n == 0:
            if left == 0:
                yield ()
            return
        for length in range(at, longest + 1):
            if 2.0 ** -length <= left:
                for rest in fill(n - 1, longest, length, left - 2.0 ** -length):
                    yield (length, *rest)

    r = random.Random(1)
    for _ in range(20):
        counts = sorted((r.randint(1, 40) ** 2 for _ in range(7)), reverse=True)
        best = min(sum(a * b for a, b in zip(counts, f, strict=True)) for f in fill(7, 4))
        assert (op12.code_lengths(np.array(counts), 4) * np.array(counts)).sum() == best


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_code_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.05, n), 300)
    code = op12.Code(op12.code_lengths(np.bincount(ids)))
    stream, offsets = code.encode(ids)
    assert code.decode(stream, offsets, n).tolist() == ids.tolist()
    # any checkpoint starts a decoding of its own
    assert code.decode(stream, offsets[-1:], n - (len(offsets) - 1) * op12.EVERY).tolist() == ids[(len(offsets) - 1) * op12.EVERY:].tolist()


def test_pieces_equal_the_tokenizer(tokenizer):
    r = random.Random(4)
    signs = ["a", "b", "é", "the", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "　", "​", "'s", "9", "½", "漢", "я", "can't", "I", "!", "?!", ",", ".", ";'", "😀", "É", "ß", "ÿ", "×", "÷", "ª", "º", "<|endoftext|>", "́"]
    encoder = op12._Encoder(PATH)
    for _ in range(20000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(encoder.of(t), encoder.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def expected(tokenizer, rows):
    out, at = [], 0
    coded = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [op12.END]) for d, t in rows]
    crc = lambda ids, kind: zlib.crc32(np.array(ids, kind).tobytes())
    for d, ids in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), crc(r[1], "<u2"))):
        out.append((d, at, len(ids), crc(ids, "<u4")))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 300, 1 << 16])
def test_files_round_trip(spark, tokenizer, monkeypatch, block):
    monkeypatch.setattr(op12, "BLOCK_IDS", block)
    r = random.Random(block)
    word = lambda: "".join(r.choice("aeioubcé") for _ in range(r.randint(1, 7)))
    rows = [(r.randint(-50, 400), " ".join(word() for _ in range(r.randint(0, 60)))) for _ in range(300)]
    rows += [(None, None), (None, "x y"), (5, None), (5, ""), (6, "same"), (6, "same"), (700, "long text\n" * 30_000), (1 << 40, "<|endoftext|>")]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id bigint, text string, ids int, part string").repartition(5)
    folder = f"{checkpoint_folder(spark)}/test-ids-{block}-{random.random()}"
    op12.write_ids(df, folder, PATH)
    got = op12.read_ids(spark, folder).withColumn("c", F.crc32("ids")).collect()
    assert sorted(((g["doc_id"], g["start"], g["n"], g["c"]) for g in got), key=str) == expected(tokenizer, rows)
    if block == 1:
        assert spark.read.parquet(f"{folder}/blocks").count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string").limit(0)
    folder = f"{checkpoint_folder(spark)}/test-ids-{random.random()}"
    op12.write_ids(df, folder, PATH)
    assert op12.read_ids(spark, folder).count() == 0
