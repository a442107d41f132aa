"""The pipeline's stages, each judged on its own input by brute force."""

import random

import pytest

import corpus_pipeline
from pixelweave.llm.text import alnum_words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(r.randint(2, 8))) + "."
    bad = lambda: " ".join(word() + "***" for _ in range(40))
    bench = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts = []
    for i in range(400):
        t = bad() if i % 5 == 0 else good()
        if i % 20 == 7:
            t += " " + bench[i % 5][1].upper()
        if i % 20 == 9:
            t = texts[-1] + " extra"
        texts.append(t)
    docs = [(i, t, "en", r.choice(["a"] * 6 + ["b", "c"]), len(t)) for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), bench


def test_stages(spark, tables, tmp_path):
    sf, bench = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, accepted, single, clean, mixed, placed = seen
    assert {r["doc_id"] for r in accepted} == {r["doc_id"] for r in first if r["doc_id"] % 5}
    grams = {r["doc_id"]: set(zip(*[r["text"].lower().split()[k:] for k in range(5)])) for r in accepted}
    gone = {b for b in grams if any(a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]) for a in grams)}
    assert gone and {r["doc_id"] for r in single} == set(grams) - gone
    windows = {tuple(w[i:i + 10]) for _, t in bench for w in [alnum_words(t.encode())] for i in range(len(w) - 9)}
    hit = {r["doc_id"] for r in single for w in [alnum_words(r["text"].encode())] if windows & {tuple(w[i:i + 10]) for i in range(len(w))}}
    assert hit and {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} - hit
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean} and len(mixed) == len(placed)
    assert sorted(r["doc_id"] for r in mixed) == sorted(r["doc_id"] for r in placed)
    words = {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in "abc"}
    assert words["a"] < words["b"] and {r["shard"] for r in placed} <= set(range(24))
    for s in {r["shard"] for r in placed}:
        slots = sorted(r["slot"] for r in placed if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert corpus_pipeline.run(spark, sf).count() == len(placed)
