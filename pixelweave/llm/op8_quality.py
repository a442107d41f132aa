"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in measures of its text (shares of letter cases,
symbols, repeated words and lines, word lengths and their transforms). Weights
are learnt from preference pairs: in each pair a document labelled 1 is
preferred to one labelled 0, and the logistic loss of the pair depends on the
difference of their measures alone. Scores are then cut at a quantile: the share
of label 0 among the training rows gives the quantile of the training scores at
which the reported score is 0.5.

Training uses at most about ``TRAIN_ROWS`` labelled rows (taken by hash of the
id at an even rate; the bound is a parameter) from the documents whose crc32 of
the id is not 1 modulo 3. Their ids are few enough to be broadcast, so the
documents aren't shuffled: one pass measures the sample, a second one scores
every document whole. Labels, language, source and id are no inputs.

Defined results: null and empty texts have all measures 0 and get the score of
that point; ids with several labels count with each; without both labels in the
sample every score is 0.5. Rows that repeat are scored alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import as_bytes

NAME = "op8_quality_pairwise"
TRAIN_ROWS = 20_000
PAIRS = 60_000
_SYMBOLS = b"!#$%&*|.,?:;@/\\<>=_-+()[]{}\"'~^"


def measures(text: bytes | None) -> np.ndarray:
    """The measures of one text."""
    text = text or b""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    symbols = count[list(_SYMBOLS)]
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = text.split(b"\n")
    same = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(1 for line in lines if len(line) > 8 and line.isupper())
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    shares = np.concatenate([
        [upper / n, lower / n, digit / n, count[128:].sum() / n, count[10] / n, count[32] / n], symbols / n,
        [len(seen) / m, max(seen.values(), default=0) / m, same / m, len(set(lines)) / len(lines), odd / len(lines),
         symbols.sum() / m, upper / m]])
    totals = np.log1p(np.concatenate([[len(text), len(words), len(lines), upper, odd, same, digit], symbols[:8],
                                      [lengths.mean(), lengths.max(), lengths.std()]]))
    some = [float(bool(words)), float(symbols[:7].sum() > 3 * len(lines)), float(len(words) < 20)]
    return np.concatenate([shares, np.sqrt(shares), totals, some])


class Ranker:
    """Weights of the scaled measures and the cut."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.middle, self.scale, self.weights, self.cut = middle, scale, weights, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 2.0) -> Ranker:
    """Newton steps on the pairwise logistic loss of random preference pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    size = x.shape[1] if x.ndim == 2 else len(measures(None))
    if not len(good) or not len(bad):
        return Ranker(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    middle, scale = x.mean(0), x.std(0)
    model = Ranker(middle, np.where(scale > 1e-9, scale, 1), np.zeros(size), 0.0)
    z = np.clip((x - model.middle) / model.scale, -8, 8)
    r = np.random.default_rng(0)
    ahead, behind = r.choice(good, pairs), r.choice(bad, pairs)
    w = np.zeros(size)
    for _ in range(12):
        curve, slope = ridge * np.eye(size), -ridge * w
        for at in range(0, pairs, 4096):
            d = z[ahead[at:at + 4096]] - z[behind[at:at + 4096]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))      # probability of the wrong order
            curve += (d * (p * (1 - p))[:, None]).T @ d
            slope += d.T @ p
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    model.cut = float(np.quantile(z @ w, len(bad) / (len(good) + len(bad))))
    return model


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ranker:
    """Learn from the labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & ~held_out())
    n = known.count()
    rate = min(1.0, rows / max(n, 1))
    # at most 2 * rows ids, so they can be broadcast
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).limit(2 * rows)
    chosen = docs.select("doc_id", as_bytes().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "quality")

    def measure(batches):
        for b in batches:
            x = [measures(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("quality")], names=["x", "y"])

    # ids may repeat; the numbers of a bounded count of rows come back
    got = chosen.mapInArrow(measure, "x array<double>, y int").limit(4 * rows).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(measures(None)))
    y = got.column("y").to_numpy()
    order = np.lexsort((y, *x.T[::-1]))
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score) of every document."""
    def run(batches):
        for b in batches:
            x = np.array([measures(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(model.weights))
            s = model.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", as_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def good_only(docs: DataFrame, model: Ranker) -> DataFrame:
    """The documents, all columns, with a score of at least 0.5."""
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            x = np.array([measures(t) for t in texts]).reshape(b.num_rows, len(model.weights))
            yield b.filter(pa.array(model.score(x) >= 0.5 if b.num_rows else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


ORACLE_SQL = None
