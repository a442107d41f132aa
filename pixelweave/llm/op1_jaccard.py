"""N-gram Jaccard join over a token-group matrix.

A document is the set of its distinct word shingles. Two documents link when
100 * intersection >= percent * union; the classes of linked documents are
returned. Copies with equal sets are reduced to one set first.

* Tokens (shingle hashes) have one global order: rarest first, by a sketch of
  document frequencies over the whole corpus, then by hash. Sets that link share
  at least L tokens among their first |X| - ceil(percent |X|) + L tokens (their
  signature), whatever the order is; the order only makes hits rare.
* Groups: each set joins the group of the pivot, the first set holding a token,
  with which it shares most signature tokens. Large groups are split into parts
  of bounded size. The token-group matrix has a row for each token in the union
  of the signatures of a group.
* Bound: a set can link into a group only if the group's union has at least L
  tokens of its signature and the sizes fit. Only such groups are opened to it,
  and of two groups only the sets of the smaller one ask the larger one. In the
  opened group a set is compared only if the union of the whole sets holds
  enough of its tokens.
* Opened groups: one task holds a group's sets (bounded by the split) and streams
  the sets that query it past them, in slices of bounded volume; intersections
  are counted exactly, by sorted lookups or block products of membership
  matrices. It returns a forest of links, at most one row per set, never pairs.
* The links of all groups are solved by alternating large-star and small-star steps.

So exact copies, hot passages and large near-copy groups cost rows in
proportion to sets times groups met, and every link between different texts is
kept up to its class. Sets are compared by 64-bit shingle hashes: within a pair
two different shingles collide with a chance of about |A||B| / 2**64.

Defined results: null and wordless texts have an empty set and link with
nothing, so they are their own class; a text of fewer words than a shingle is
one shingle. ``component_id`` is the smallest id of the class; null ids count as
larger than all others (null only if the class has no other). Repeated rows and
ids are returned as often as they occur; other columns don't matter.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.components import solve_edges
from ..session import cut_lineage, drop_tables
from .text import WordHash, as_bytes, gram_hashes, spaced_words

NAME = "op1_jaccard_groups"
SKETCH = 1 << 20          # counters of document frequency
FAN_IN = 32               # sketches that a task sums
PART_SHINGLES = 1 << 19   # shingles of a group's part, and of the queries of a slice
PART_SETS = 1024          # sets of a group's part
FEW = 64                  # pairs that are looked up one by one


def _table(df: DataFrame) -> DataFrame:
    """``df`` as a table; the shuffles behind it are deleted as soon as the
    driver's collector has let go of their plans, so it runs here."""
    out = cut_lineage(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def shingles(text: bytes | None, k: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased text."""
    h = np.sort(gram_hashes(memo.of(spaced_words(text.lower() if text else None)), k))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, hash, n, fp, sketch): a row per document, and one with the frequency sketch per task."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, hash bigint, n bigint, fp binary, sketch binary"

    def run(batches):
        memo, sketch, ids = WordHash(), np.zeros(SKETCH, np.uint32), None
        for b in batches:
            n, fp, ids = [], [], b.schema.field("doc_id").type
            for t in b.column("text").to_pylist():
                s = shingles(t, k, memo)
                np.add.at(sketch, s % np.uint64(SKETCH), 1)
                n.append(len(s))
                fp.append(_fingerprint(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hash"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.nulls(len(n), pa.binary())],
                names=["doc_id", "hash", "n", "fp", "sketch"])
        if ids is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ids), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([_packed(sketch)], pa.binary())],
                names=["doc_id", "hash", "n", "fp", "sketch"])

    return docs.select("doc_id", _text_hash().alias("hash"), as_bytes().alias("text")).mapInArrow(run, schema)


def _text_hash() -> Column:
    return F.xxhash64(as_bytes())


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed 32-bit numbers; higher ones stay at the largest."""
    return zlib.compress(np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)


def _frequencies(sketches: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches, in levels; its size is fixed."""
    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for s in b.column("sketch").to_pylist():
                total += _unpacked(s)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], names=["sketch"])

    n = sketches.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        sketches = sketches.repartition(n).mapInArrow(run, "sketch binary")
    rows = sketches.coalesce(1).mapInArrow(run, "sketch binary").collect()
    return _unpacked(rows[0][0]) if rows else np.zeros(SKETCH, np.int64)


def _depth(n):
    """Signature tokens that two sets must share (L), by size."""
    return n * 3 // 100 + 1


def _ranks(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)


def _signatures(docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """(fp, tokens) of every document with words; ``shared`` has the broadcast ranks, SKETCH numbers."""

    def run(batches):
        memo, rank = WordHash(), shared.value
        for b in batches:
            fp, tokens = [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, k, memo)
                n = len(s)
                if not n:
                    continue
                key = rank[s % np.uint64(SKETCH)] | (s >> np.uint64(20))
                most = min(n, n - (percent * n + 99) // 100 + _depth(n))
                fp.append(_fingerprint(s))
                tokens.append(s[key <= np.partition(key, most - 1)[most - 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
                                             names=["fp", "tokens"])

    return docs.select(as_bytes().alias("text")).mapInArrow(run, "fp binary, tokens array<bigint>")


def _routes(tokens: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(sid, routes) and the tables that it reads: the opened groups each set goes to, as member or query, from (token, sid, n, pivot).

    Of two groups the sets of the one of less volume ask the other, so those of
    a large group don't ask the many small ones around it.
    """
    best = tokens.groupBy("sid", "n", "pivot").agg(F.count("*").alias("c")).groupBy("sid", "n").agg(
        F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot"))
    parts = best.groupBy("pivot").agg(F.greatest(F.ceil(F.sum("n") / PART_SHINGLES), F.ceil(F.count("*") / PART_SETS)).alias("parts"))
    member = cut_lineage(best.join(parts.hint("merge"), "pivot").select(
        "sid", "n", F.xxhash64("pivot", F.pmod(F.xxhash64("sid"), "parts")).alias("g")))
    groups = cut_lineage(member.groupBy("g").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("sets"), F.sum("n").alias("volume")))
    held = _table(tokens.select("token", "sid").join(member.join(groups.select("g", "volume").hint("merge"), "g").hint("merge"), "sid"))
    # the token-group matrix
    matrix = held.select("token", "g").distinct().join(groups.hint("merge"), "g").select(
        "token", F.col("g").alias("to"), "least", "most", F.col("volume").alias("to_volume"))
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
    met = held.join(matrix.hint("merge"), "token").where((F.struct("to_volume", "to") > F.struct("volume", "g")) & fits)
    depth = F.floor(F.least(F.col("n"), F.greatest(F.col("least"), F.floor((F.col("n") * percent + 99) / 100))) * 3 / 100) + 1
    asks = _table(met.groupBy("sid", "n", "to", "least").agg(F.count("*").alias("c")).where(F.col("c") >= depth).select(
        "sid", "n", F.col("to").alias("g")))
    drop_tables(held)
    slices = asks.groupBy("g").agg(F.ceil(F.sum("n") / PART_SHINGLES).cast("int").alias("slices"))
    opened = groups.select("g", "sets").join(slices.hint("merge"), "g", "left").where((F.col("sets") > 1) | F.col("slices").isNotNull()).select(
        "g", F.coalesce("slices", F.lit(1)).alias("slices"))
    as_member = member.join(opened.hint("merge"), "g").select(
        "sid", "g", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asks"))
    as_query = asks.join(opened.hint("merge"), "g").select(
        "sid", "g", F.pmod(F.xxhash64("sid", "g"), "slices").cast("int").alias("slice"), F.lit(True).alias("asks"))
    routes = as_member.unionByName(as_query).groupBy("sid").agg(F.collect_list(F.struct("g", "slice", "asks")).alias("routes"))
    return routes, [member, groups, asks]


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of ``a`` with all of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    if len(a) * len(b) <= FEW:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                s, t = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                out[i, j] = np.count_nonzero(t[at] == s)
        return out
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def places(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        ok = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (ra, ca), (rb, cb) = places(a), places(b)
    for low in range(0, len(both), 4096):
        def block(row, col, n, low=low):
            s, e = np.searchsorted(col, [low, low + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[row[s:e], col[s:e] - low] = 1
            return m
        out += (block(ra, ca, len(a)) @ block(rb, cb, len(b)).T).astype(np.int64)
    return out


def _classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's class under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(members, queries, percent: int, among: bool):
    """Links (u, v) that join the classes among members, and of queries with members.

    A query of which the group's union holds too few tokens is not compared.
    """
    if queries:
        union = np.unique(np.concatenate([s for _, s in members]))
        overlap = [np.count_nonzero(union[np.minimum(np.searchsorted(union, s), len(union) - 1)] == s) for _, s in queries]
        queries = [q for q, c in zip(queries, overlap, strict=True) if 100 * c >= percent * len(q[1])]
    ids = np.array([s for s, _ in members + queries])
    links = [np.zeros((2, 0), np.int64)]
    m = [s for _, s in members]

    def add(other, offset):
        common = _common(m, other)
        union = np.array([len(s) for s in m])[:, None] + np.array([len(s) for s in other])[None] - common
        i, j = np.nonzero((100 * common >= percent * union) & (common > 0))
        links.append(np.stack([i, j + offset]))

    if among:
        add(m, 0)
    for at in range(0, len(queries), PART_SETS):
        add([s for _, s in queries[at:at + PART_SETS]], len(members) + at)
    a, b = np.concatenate(links, axis=1)
    label = _classes(len(ids), a, b)
    off = np.flatnonzero(label != np.arange(len(ids)))
    return ids[off], ids[label[off]]


def _links(docs: DataFrame, needed: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) links of set ids; ``needed`` has (first, text, fp, sid, routes): a
    set comes from a row with its first id and that text hash, so that rows
    which share an id, or have none, meet only their own set."""
    rows = docs.select("doc_id", _text_hash().alias("_hash"), as_bytes().alias("_text"))
    pairs = rows.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("_hash") == F.col("text"))).select(
        F.col("_text").alias("text"), "fp", "sid", "routes")

    def send(batches):
        memo = WordHash()
        for b in batches:
            out = {c: [] for c in ("g", "slice", "asks", "sid", "tokens")}
            for t, fp, sid, routes in zip(*(b.column(c).to_pylist() for c in ("text", "fp", "sid", "routes")), strict=True):
                s = shingles(t, k, memo)
                if _fingerprint(s) != fp:      # another text with the same id and hash
                    continue
                for r in routes:
                    for c in ("g", "slice", "asks"):
                        out[c].append(r[c])
                    out["sid"].append(sid)
                    out["tokens"].append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["g"], pa.int64()), pa.array(out["slice"], pa.int32()), pa.array(out["asks"], pa.bool_()),
                 pa.array(out["sid"], pa.int64()), pa.array(out["tokens"], pa.binary())], names=list(out))

    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("g", "slice", "asks", "sid", "tokens")), strict=True)

    def open_groups(batches):
        u, v = [], []
        for _, part in groupby(rows(batches), key=lambda r: r[:2]):
            members, queries, seen, got = [], [], set(), []
            first = True
            for _, slice_, asks, sid, tokens in part:
                if (sid, asks) in seen:        # repeated rows
                    continue
                seen.add((sid, asks))
                if asks and first:             # all members are there
                    first = False
                    if slice_ == 0:
                        got.append(_forest(members, [], percent, True))
                (queries if asks else members).append((sid, np.frombuffer(tokens, np.uint64)))
            if first and slice_ == 0:
                got.append(_forest(members, [], percent, True))
            if queries:
                got.append(_forest(members, queries, percent, False))
            for a, b in got:
                u.append(a)
                v.append(b)
            if len(u) > 1000:
                yield _edges(u, v)
                u, v = [], []
        yield _edges(u, v)

    return pairs.mapInArrow(send, "g bigint, slice int, asks boolean, sid bigint, tokens binary").repartition(
        F.col("g"), F.col("slice")).sortWithinPartitions("g", "slice", "asks").mapInArrow(open_groups, "u bigint, v bigint")


def _edges(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (u, v)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["u", "v"])


def _named(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, fp) of every row, and (fp, first, root) of every set with words: its smallest id and its class."""
    described = _table(_described(docs, k))
    counts = _frequencies(described.where("sketch is not null").select("sketch"))
    rows = described.where("sketch is null").select("doc_id", "hash", "n", "fp")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    sets = cut_lineage(rows.where("n > 0").groupBy("fp").agg(one.alias("one"), F.max("n").alias("n"))
                       .select("fp", F.col("one.doc_id").alias("first"), F.col("one.hash").alias("text"), "n")
                       .withColumn("sid", F.monotonically_increasing_id()))
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(counts))
    signed = _signatures(docs, k, percent, shared).groupBy("fp").agg(F.first("tokens").alias("tokens"))
    each = signed.join(sets.hint("merge"), "fp").select("sid", "n", F.explode("tokens").alias("token"))
    many = each.groupBy("token").agg(F.min("sid").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    tokens = _table(each.join(many.hint("merge"), "token").select("token", "sid", "n", "pivot"))
    shared.destroy()
    routes, used = _routes(tokens, percent)
    needed = sets.join(routes.hint("merge"), "sid").select("first", "text", "fp", "sid", "routes")
    links = _table(_links(docs, needed, k, percent))
    drop_tables(tokens, *used)
    root = solve_edges(links.select(F.lit(0).alias("scene_id"), "u", "v")).select(F.col("u").alias("sid"), F.col("v").alias("root"))
    return rows, sets.join(root.hint("merge"), "sid", "left").select("fp", "first", F.coalesce("root", "sid").alias("root"))


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    rows, named = _named(docs, k, percent)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, all columns: of the smallest id, a null id only if the class has no other.

    Rows are judged by id and set, so rows that share an id, or have none, don't
    go with each other. Texts without words stay, once for each id and text.
    """
    _, named = _named(docs, k, percent)
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("kept")).select(
        F.col("kept.first").alias("__first"), F.col("kept.fp").alias("__kept"))

    @F.pandas_udf("binary")
    def fingerprints(texts: pd.Series) -> pd.Series:
        memo = WordHash()
        return pd.Series([_fingerprint(shingles(t, k, memo)) for t in texts], dtype=object)

    wordless = F.col("__fp") == F.lit(_fingerprint(np.zeros(0, np.uint64)))
    marked = docs.withColumn("__fp", fingerprints(as_bytes())).withColumn("__row", F.when(wordless, F.struct("doc_id", "text")))
    found = marked.join(kept.hint("merge"), (F.col("__fp") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__first")), "left")
    return found.where(F.col("__kept").isNotNull() | wordless).dropDuplicates(["__fp", "__row"]).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM n
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) USING (doc_id)
"""
