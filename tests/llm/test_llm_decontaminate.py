"""Decontamination against brute force."""

import pickle
import random
import tracemalloc

import pytest

from pixelweave.llm import op9_decontaminate as op9
from pixelweave.llm.text import alnum_words


def brute(docs, bench, window):
    out = []
    for doc_id, text in docs:
        w = alnum_words(None if text is None else text.encode())
        hit, items = set(), set()
        for item, t in bench:
            p = alnum_words(None if t is None else t.encode())
            m = min(window, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j:j + m] == p[i:i + m]:
                        hit |= set(range(j, j + m))
                        items |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op9, "BLOCK_BYTES", block)
    r = random.Random(2)
    w = ["the", "of", "Été", "x1", "is"]
    text = lambda n: " ".join(r.choice(w) for _ in range(n))
    bench = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 4, 6])] + [(50, None), (51, "--"), (None, "zz yy"), (3, "q r s")]
    docs = [(i, text(r.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (None, "zz, YY!"), (5, "Q-r-s " * 3000), (5, "Q-r-s " * 3000)]
    df = spark.createDataFrame([(*d, "c", [1]) for d in docs], "doc_id bigint, text string, items string, spans array<int>")
    bf = spark.createDataFrame([(*b, "c") for b in bench], "item_id bigint, text string, doc_id string")
    got = op9.find(df, bf, 4).collect()
    want = brute(docs, bench, 4)
    assert sorted(((g["doc_id"], g["n_words"], sum(g["spans"][1::2]) - sum(g["spans"][::2]), g["items"]) for g in got), key=str) == want
    kept = op9.clean(df, bf, 4).collect()
    assert sorted((k["doc_id"] for k in kept), key=str) == sorted((d for d, _, h, _ in want if not h), key=str)
    assert op9.find(df.limit(0), bf, 4).count() == 0
    assert op9.clean(df, bf.limit(0), 4).count() == len(docs)
    assert [g["items"] for g in op9.find(df, bf.limit(0), 4).where("size(spans) > 0").collect()] == []


def test_tables_are_small():
    """A full block of the benchmark: 4 MB of text, and one text under many items."""
    r = random.Random(4)
    words = [f"w{r.randrange(1 << 40):x}" for _ in range(60_000)]
    rows, size = [], 0
    while size < op9.BLOCK_BYTES:
        rows.append((str(len(rows)), " ".join(r.choice(words) for _ in range(200)).encode()))
        size += len(rows[-1][1])
    rows += [(f"same {i}", rows[0][1]) for i in range(20_000)]
    tracemalloc.start()
    tables = op9.Tables(rows, 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100e6 and len(pickle.dumps(tables)) < 60e6
    spans, items = tables.look([b"zz", *rows[0][1].split()[5:30], b"yy"])
    assert spans[0] == (1, 11) and spans[-1] == (16, 26) and len(spans) == 16 and len(items) == 20_001
