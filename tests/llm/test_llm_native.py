"""Mixing, sharding and the archive against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import op3_mix, op6_shard, op7_warc, prefix
from pixelweave.session import checkpoint_folder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def test_mix_targets_and_repeats(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(r.randint(0, 30))), r.choice(["a"] * 8 + ["b", "c", None])) for i in range(600)]
    got = op3_mix.mix(op3_mix.sized(docs(spark, rows))).collect()
    assert len(got) == 600
    total = sum(g["size"] for g in got)
    size = {}
    for g in got:
        size[g["source"]] = size.get(g["source"], 0) + g["size"]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    goal, open_ = {}, set(size)
    while True:  # share the rest by weight, cap, share anew
        rest = total - sum(goal.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        goal |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    goal |= {s: level * weight[s] for s in open_}
    for s in size:
        mine = [g for g in got if g["source"] == s]
        assert all(abs(g["target"] - goal[s]) < 1e-6 and g["source_size"] == size[s] for g in mine)
        assert sum(g["taken"] for g in mine) == int(goal[s] + 1e-9)
        assert all(0 <= g["taken"] <= 3 * g["size"] for g in mine)


def test_mix_edge_cases(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, "x " * 50_000, "a"), (2, "x " * 50_000, "a")]
    df = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("_n", F.lit(7))
    got = op3_mix.mix(op3_mix.sized(df)).collect()
    assert len(got) == 5 and sum(g["taken"] for g in got) == 100_000
    assert op3_mix.mix(op3_mix.sized(df.limit(0))).count() == 0
    assert op3_mix.mix(op3_mix.sized(df.where("text is null"))).where("taken > 0 or target > 0").count() == 0
    whole = op3_mix.mixed(df.withColumn("_id", F.lit(1)))
    assert whole.columns == [*df.columns, "_id"] and whole.where("doc_id is null").count() == 0 and whole.count() == 2


@pytest.mark.parametrize("same", [None, 5])
def test_mixed_meets_its_targets_by_row(spark, same):
    """Half of the rows share one id or have none; every row counts by itself."""
    r = random.Random(3)
    rows = [(same if i % 2 else 1000 + i, " ".join(f"w{i}" for _ in range(r.randint(1, 20))), r.choice(["a", "a", "b", "b", "b", "b", "c"])) for i in range(400)]
    df = docs(spark, rows).withColumn("n", F.monotonically_increasing_id()).withColumn("_b", F.lit(2)).withColumn("size", F.lit("x"))
    goal = {g["source"]: g["target"] for g in op3_mix.targets(op3_mix.sized(df)).collect()}
    out = op3_mix.mixed(df)
    assert out.columns == df.columns
    got = out.collect()
    for s, t in goal.items():
        words = sum(len(g["text"].split()) for g in got if g["source"] == s)
        assert t - 20 <= words <= t + 20                         # the row at the cut stays whole
    copies = {}
    for g in got:
        copies[g["n"]] = copies.get(g["n"], 0) + 1
    assert max(copies.values()) <= 3
    assert sorted(map(str, op3_mix.mixed(df).collect())) == sorted(map(str, got))


def smallest_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, at = (n, at + s) if at + s <= c else (n + 1, s)
        return n <= shards

    c = 0
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("seed", range(3))
def test_shard_capacity_is_minimal(spark, seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 40) for _ in range(300)]
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), s) for i, s in enumerate(sizes)]
    groups = spark.createDataFrame(rows, "key string, bytes bigint")
    own, cuts, capacity = op6_shard.partition(groups, 7)
    ordered = [s for k, s in sorted(rows)]
    assert own == [] and capacity == smallest_capacity(ordered, 7)
    got = groups.withColumn("s", op6_shard.shard_of(own, cuts, 7)).groupBy("s").agg(F.sum("bytes").alias("b")).collect()
    assert max(g["b"] for g in got) <= capacity and {g["s"] for g in got} <= set(range(7))


def test_shard_rows(spark):
    r = random.Random(5)
    texts = ["hot text " * 30] * 300 + ["".join(r.choice("abcé ") for _ in range(r.randint(0, 90))) for _ in range(600)] + [None, "", None]
    df = docs(spark, [(i if i % 7 else None, t, "s") for i, t in enumerate(texts)]).withColumn("shard", F.lit(1)).withColumn("key", F.lit("x"))
    got = op6_shard.shard(df, 6).collect()
    assert len(got) == len(texts)
    assert sorted((g["size"], g["text_crc32"]) for g in got) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    by = {}
    for g in got:
        by.setdefault(g["shard"], []).append(g)
    assert set(by) == set(range(6))
    for s in by.values():
        assert sorted(g["slot"] for g in s) == list(range(len(s)))
    where = {}
    for g in got:
        if g["size"] > 8:
            assert where.setdefault((g["size"], g["text_crc32"]), g["shard"]) == g["shard"]
    hot = where[(278, zlib.crc32(("hot text " * 30).encode()))]
    rest = sorted(sum(g["size"] for g in s) for k, s in by.items() if k != hot)
    assert rest[-1] - rest[0] <= 2 * 200
    assert op6_shard.shard(df.limit(0), 6).count() == 0


def test_archive_round_trip(spark):
    big, small = "<p>" + "x" * 200, "tiny é"
    rows = [(5, "http://a", big), (3, "http://b\r\nWARC-Type: revisit", big), (None, None, big), (3, "http://c", big),
            (7, "u", small), (8, "u", small), (9, "u", None), (10, "u", ""), (None, "u", "y" * 300), (11, "u", "z" * 2_000_000)]
    df = spark.createDataFrame([(*r, "clash", "c2") for r in rows],
                               "page_id bigint, url string, html string, digest string, payload string")
    odd = [f"http://x{sep}WARC-Refers-To: <urn:page:77>{sep}y" for sep in ("\u2028", "\u2029", "\u0085", "\x0b", "\x0c")] + ["", None]
    more = spark.createDataFrame([(100 + i, u, f"page {i} " * 30, "c", "c2") for i, u in enumerate(odd)], df.schema)
    folder = f"{checkpoint_folder(spark)}/test-archive-{random.random()}"
    op7_warc.write_archive(more, folder)
    back = {g["page_id"]: g for g in op7_warc.read_records(spark, folder).collect()}
    assert [back[100 + i]["url"] for i in range(len(odd))] == odd
    assert all(g["record_type"] == "response" and g["refers_to"] is None for g in back.values())
    folder = f"{checkpoint_folder(spark)}/test-archive-{random.random()}"
    op7_warc.write_archive(df, folder)
    got = op7_warc.read_records(spark, folder).collect()
    assert sorted((g["page_id"] or -1, bytes(g["payload"])) for g in got) == sorted(
        (p or -1, (h or "").encode()) for p, _, h in rows)
    for g in got:
        body = bytes(g["payload"])
        head = bytes(g["header"])
        assert g["payload_digest"] == g["digest"] == hashlib.sha256(body).hexdigest()
        assert bytes(g["record"]) == head + (b"" if g["record_type"] == "revisit" else body) + b"\r\n\r\n"
        assert f"Content-Length: {0 if g['record_type'] == 'revisit' else len(body)}\r\n".encode() in head
        again = body == big.encode() and g["page_id"] != 3
        assert g["record_type"] == ("revisit" if again else "response") and g["refers_to"] == (3 if again else None)
    assert spark.read.parquet(f"{folder}/payloads").count() == 5
    empty = f"{folder}-empty"
    op7_warc.write_archive(df.limit(0), empty)
    assert op7_warc.read_records(spark, empty).count() == 0


def test_hot_ids_are_spread(spark, monkeypatch):
    """A third of the rows without id, a third equal in id and text: no bucket grows with them."""
    r = random.Random(8)
    rows = [(None, "w " * r.randint(0, 9) + str(i), "a") for i in range(9_000)] + [(7, "same text", "a")] * 9_000 + [(100 + i, f"x {i}", "a") for i in range(9_000)]
    df = docs(spark, rows)
    held, plain = [], prefix.running_sum

    def watched(df, group, key, size, order, value, name):
        head = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.ceil(F.col(size) / prefix.BUCKET_ROWS).cast("bigint"), 32)
        held.append(df.groupBy(*group, head.alias("b")).count().agg(F.max("count")).first()[0])
        return plain(df, group, key, size, order, value, name)

    for module in (op3_mix, op6_shard):
        monkeypatch.setattr(module, "running_sum", watched)
    mixed = op3_mix.mix(op3_mix.sized(df))
    assert mixed.count() == len(rows) and mixed.agg(F.sum("taken")).first()[0] == sum(len(t.split()) for _, t, _ in rows)
    by = {}
    for g in op6_shard.shard(df, 4).collect():
        by.setdefault(g["shard"], []).append(g["slot"])
    assert sum(map(len, by.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(held) <= 1.2 * prefix.BUCKET_ROWS
