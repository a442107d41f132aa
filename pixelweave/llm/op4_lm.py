"""Language-model scores: causal self-attention over subword ids, in numpy.

Tokens of a text are its lower-cased words and one end. Words are cut into
subword ids by a public byte-level BPE vocabulary (a file whose path is a
parameter; the driver reads it once and broadcasts it).

Model: the next subword id's class follows from ``h = e[x_t] + attention`` by a
softmax over classes, and the id from its share within the class. Frequent ids
are classes of their own; the others are clustered by the classes they follow.
Attention has one head with a learnt bias per distance. A text is laid out in
windows of 2 * HALF positions that overlap by half: each window scores its last
HALF ids, so every id is scored once and sees HALF to 2 * HALF - 1 ids before it;
a mask hides later ids and the padding before a text.

What is learnt from the corpus, each from all training documents: word counts and
subword counts; the classes that ids follow; attention weights by rounds of
distributed gradient steps. In a round each shard of bounded volume starts from the common weights, and the
shards' weights are averaged on the executors. The driver holds tables of the
vocabulary's size only.

Base scores need the count of every word of every document. Counts of frequent
words (a bounded number) are broadcast; the other words are joined by hash.

Defined results: null text is empty and has its end as only token; a null id is
never held out; without training documents every count is 0 and weights stay at
their start. Equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .text import WordHash, as_bytes, spaced_words

NAME = "op4_attention_lm"
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
HALF, WIDTH = 8, 16             # scored positions of a window; width of embeddings
SINGLE, CLUSTERS = 112, 16      # ids with a class of their own; classes of the others
EVERY, ROUNDS, SHARD_IDS = 1, 2, 1_600_000     # every training document; rounds; ids of a shard
FAN_IN = 32                     # shards whose weights a task averages
FREQUENT = 200_000              # words whose counts are broadcast, at most
_PATTERN = r" [^ ]+"          # a word and the space before it is one piece
_END_WORD = b"\n"               # no word has a line end


class Subwords:
    """Subword ids of words, remembered for up to ``limit`` words.

    A word's number leads to its ids, which lie one after the other in one array,
    and to ``hashes``; so a text becomes arrays with one look-up per word.
    """

    def __init__(self, file: bytes, limit: int = 400_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.encoding = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.spaced = np.zeros(self.end, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        """Forget all words but the end of a text, number 0."""
        self.number = {_END_WORD: 0}
        self.flat, self.used = np.full(1 << 18, self.end, np.int32), 1
        self.start, self.size = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.hashes[0] = WordHash(0).of([_END_WORD])[0]

    def learn(self, words) -> bool:
        """Encode the new words; True if all others were forgotten for it.

        They are encoded together: an id that starts with a space starts a word.
        """
        words = set(words)
        new = [w for w in words if w not in self.number]
        full = len(self.number) + len(new) > self.limit
        if full:
            self.clear()
            new = [w for w in words if w != _END_WORD]
        for at in range(0, len(new), 32_768):
            part = new[at:at + 32_768]
            ids = np.array(self.encoding.encode_ordinary(b"".join(b" " + w for w in part).decode()), np.int32)
            start = np.flatnonzero(self.spaced[ids])
            n = len(self.number)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.tile(self.flat, 2)
            while n + len(part) > len(self.start):
                self.start, self.size, self.hashes = (np.tile(a, 2) for a in (self.start, self.size, self.hashes))
            self.flat[self.used:self.used + len(ids)] = ids
            self.start[n:n + len(part)] = start + self.used
            self.size[n:n + len(part)] = np.diff(np.append(start, len(ids)))
            self.hashes[n:n + len(part)] = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part))
            self.number.update(zip(part, range(n, n + len(part))))
            self.used += len(ids)
        return full

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of known words and the end."""
        return np.fromiter(map(self.number.__getitem__, [*words, _END_WORD]), np.int64, len(words) + 1)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        return np.take(self.flat, np.repeat(self.start[numbers] - ends + size, size) + np.arange(ends[-1]))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _words(text: bytes | None) -> list[bytes]:
    return spaced_words(text.lower() if text else None)


def _portions(batch: pa.RecordBatch, most: int = 1 << 21):
    """Slices of about ``most`` bytes of text, or one longer text."""
    size = np.cumsum([len(t or b"") for t in batch.column("text").to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, word, c) over all texts, the end included. Tasks send partial counts."""
    def run(batches):
        count, memo = Counter(), WordHash()

        def sent():
            words = list(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(memo.of(words).view(np.int64)), pa.array(words, pa.binary()), pa.array(list(count.values()), pa.int64())],
                names=["h", "word", "c"])

        for b in batches:
            for t in b.column("text").to_pylist():
                count.update(_words(t))
                count[_END_WORD] += 1
                if len(count) > 400_000:
                    yield sent()
                    count.clear()
        yield sent()

    return texts.mapInArrow(run, "h bigint, word binary, c bigint").groupBy("h", "word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, file) -> np.ndarray:
    """Corpus counts of the subword ids and the end, from the word counts."""
    def run(batches):
        sub = Subwords(file.value)
        total = np.zeros(sub.end + 1, np.int64)
        for b in batches:
            words = b.column("word").to_pylist()
            sub.learn(words)
            at = sub.numbers(words)[:-1]
            c = np.repeat(b.column("c").to_numpy(), sub.size[at])
            total += np.bincount(sub.ids(at), c, len(total)).astype(np.int64) if len(at) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])

    got = counts.select("word", "c").mapInArrow(run, "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(Subwords(file.value).end + 1, np.int64)
    for r in got:
        out[r["id"]] = r["c"]
    return out


class Attention:
    """Weights and the forward and backward passes over windows.

    Id ``n`` of ``n`` known ids is the start of a text, ``n + 1`` the padding before it.
    """

    NAMES = ("e", "wq", "wk", "wv", "near", "u", "c")

    def __init__(self, n: int, classes: int, share: np.ndarray):
        r = np.random.default_rng(7)
        small = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        self.e, self.wq, self.wk, self.wv = small(n + 2, WIDTH), small(WIDTH, WIDTH), small(WIDTH, WIDTH), small(WIDTH, WIDTH)
        self.near, self.u, self.c = np.zeros(2 * HALF, np.float32), small(WIDTH, classes), np.log(share).astype(np.float32)
        self.n = n
        # distance of key j from query i (position HALF + i); later keys are masked
        gap = HALF + np.arange(HALF)[:, None] - np.arange(2 * HALF)[None]
        self.gap, self.later = np.maximum(gap, 0), np.where(gap < 0, np.float32(-1e9), np.float32(0))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at:at + old.size].reshape(old.shape).astype(np.float32, copy=True))
            at += old.size

    def windows(self, docs: list[np.ndarray]):
        """(inputs (w, 2 HALF), targets (w, HALF) with -1 for none, document of each window)."""
        blocks, targets, owner, first = [], [], [], []
        for d, ids in enumerate(docs):
            m = -(-len(ids) // HALF)
            x, y = np.full((m + 1) * HALF, self.n + 1, np.int32), np.full(m * HALF, -1, np.int32)
            x[HALF] = self.n
            x[HALF + 1:HALF + len(ids)] = ids[:-1]
            y[:len(ids)] = ids
            blocks.append(x.reshape(-1, HALF))
            targets.append(y.reshape(-1, HALF))
            owner.append(np.full(m, d))
            first.append(np.arange(m + 1) < m)
        b, i = np.concatenate(blocks), np.flatnonzero(np.concatenate(first))
        return np.concatenate([b[i], b[i + 1]], axis=1), np.concatenate(targets), np.concatenate(owner)

    def tables(self) -> None:
        """Queries, keys and values of every id, for scoring.

        Their norms bound the exponents, which trained weights keep far below overflow; it is checked here.
        """
        self.q, self.k, self.v = self.e @ self.wq / math.sqrt(WIDTH), self.e @ self.wk, self.e @ self.wv
        self.hide = np.zeros(self.n + 2, np.float32)
        self.hide[self.n + 1] = -1e9
        self.bias = self.near[self.gap] + self.later
        norm = lambda m: float(np.linalg.norm(m, axis=1).max())
        if max(norm(self.q) * norm(self.k) + np.abs(self.near).max(),
               (norm(self.e) + norm(self.v)) * norm(self.u.T) + np.abs(self.c).max()) > 80:
            self._shrink()

    def _shrink(self) -> None:
        """Rows of ids whose norm stands out are scaled down until no exponent can overflow."""
        def capped(m, most):
            return m * np.minimum(1, most / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)

        self.near, self.c = np.clip(self.near, -10, 10), np.clip(self.c, -40, 40)
        self.q, self.k = capped(self.q, 8), capped(self.k, 8)
        most = (80 - float(np.abs(self.c).max())) / 2 / float(np.linalg.norm(self.u, axis=0).max())
        self.e, self.v = capped(self.e, most), capped(self.v, most)

    def class_scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log probability of class ``y`` (w, HALF) after inputs ``x``, by batched masked attention."""
        own = x[:, HALF:]
        s = np.take(self.q, own, 0) @ np.take(self.k, x, 0).transpose(0, 2, 1)
        s += self.bias
        s += np.take(self.hide, x)[:, None]
        np.exp(s, out=s)
        seen = s @ np.take(self.v, x, 0)
        seen /= s.sum(2, keepdims=True)
        seen += np.take(self.e, own, 0)
        z = seen.reshape(-1, WIDTH) @ self.u
        z += self.c
        at = np.take(z, np.arange(0, z.size, z.shape[1]) + y.ravel())
        np.exp(z, out=z)
        return (at - np.log(z @ np.ones(z.shape[1], z.dtype))).reshape(y.shape)

    def steps(self, x: np.ndarray, y: np.ndarray, rate: float = 0.2, batch: int = 128) -> None:
        """One pass of Adagrad steps; ``y`` are classes, -1 for none."""
        state = {k: np.full_like(getattr(self, k), 1e-4) for k in self.NAMES}
        order = np.random.default_rng(1).permutation(len(x))
        for at in range(0, len(order), batch):
            for k, g in self._gradients(x[order[at:at + batch]], y[order[at:at + batch]]).items():
                weights, past = getattr(self, k), state[k]
                if isinstance(g, tuple):
                    rows, g = g
                    seen = np.take(past, rows, 0) + g * g
                    past[rows] = seen
                    weights[rows] = np.take(weights, rows, 0) - rate * g / np.sqrt(seen)
                else:
                    past += g * g
                    weights -= rate * g / np.sqrt(past)

    def _gradients(self, x, y):
        # products of few large matrices; classes lie along the first axis, where sums and maxima are cheap
        two = lambda m: m.reshape(-1, WIDTH)
        scale = np.float32(1 / math.sqrt(WIDTH))
        e = np.take(self.e, x, 0)
        eq = np.ascontiguousarray(e[:, HALF:])
        q, k, v = ((two(m) @ w).reshape(m.shape) for m, w in ((eq, self.wq * scale), (e, self.wk), (e, self.wv)))
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        a += self.near[self.gap] + self.later
        a += np.where(x == self.n + 1, np.float32(-1e9), np.float32(0))[:, None]
        a -= np.ascontiguousarray(a.reshape(-1, 2 * HALF).T).max(0).reshape(*a.shape[:2], 1)
        np.exp(a, out=a)
        a /= (a.reshape(-1, 2 * HALF) @ np.ones(2 * HALF, a.dtype)).reshape(*a.shape[:2], 1)
        h = two(eq + a @ v)
        yy = y.ravel()
        known = (yy >= 0).astype(np.float32)
        known /= max(1, np.count_nonzero(known))
        p = self.u.T @ h.T
        p += self.c[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p *= known / p.sum(0)
        p[np.maximum(yy, 0), np.arange(len(yy))] -= known
        out = {"u": (p @ h).T, "c": p.sum(1)}
        dh = np.ascontiguousarray((self.u @ p).T).reshape(eq.shape)
        da, dv = dh @ np.ascontiguousarray(v.transpose(0, 2, 1)), a.transpose(0, 2, 1) @ dh
        da -= ((da * a).reshape(-1, 2 * HALF) @ np.ones(2 * HALF, a.dtype)).reshape(*a.shape[:2], 1)
        ds = np.multiply(a, da, out=da)         # 0 for later ids, as their attention is
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        dq *= scale
        out |= {"wq": two(eq).T @ two(dq), "wk": two(e).T @ two(dk), "wv": two(e).T @ two(dv),
                "near": np.bincount(self.gap.ravel(), ds.sum(0).ravel(), 2 * HALF).astype(np.float32)}
        de = (two(dk) @ self.wk.T + two(dv) @ self.wv.T).reshape(e.shape)
        de[:, HALF:] += dh + (two(dq) @ self.wq.T).reshape(dq.shape)
        # by id, equal ones in their order
        place = np.sort(x.ravel().astype(np.int64) * x.size + np.arange(x.size))
        ids = place // x.size
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out["e"] = (ids[start], np.add.reduceat(np.take(two(de), place - ids * x.size, 0), start))
        return out


def class_table(count: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each id, log share within its class, share of each class).

    ``follows`` (ids, SINGLE + 1) counts the single classes (last: others) each id follows.
    """
    n = len(count)
    order = np.argsort(-count, kind="stable")
    top = np.array([n - 1, *[i for i in order if i != n - 1][:SINGLE - 1]])       # the end first
    cls = np.full(n, SINGLE)
    cls[top] = np.arange(len(top))
    rest = np.flatnonzero((cls == SINGLE) & (follows.sum(1) >= 4))
    f = np.sqrt(follows[rest] / np.maximum(follows[rest].sum(1, keepdims=True), 1))
    centre = f[np.argsort(-count[rest], kind="stable")[:CLUSTERS]]
    for _ in range(10 if len(centre) else 0):
        near = (f @ centre.T).argmax(1)
        mean = np.stack([f[near == i].mean(0) if (near == i).any() else centre[i] for i in range(len(centre))])
        centre = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    if len(centre):
        cls[rest] = SINGLE + (f @ centre.T).argmax(1)
    smooth = count + 0.5
    total = np.bincount(cls, smooth, SINGLE + CLUSTERS)
    return cls.astype(np.int16), np.log(smooth / total[cls]).astype(np.float32), np.maximum(total, 0.5) / np.maximum(total, 0.5).sum()


def _single_classes(count: np.ndarray) -> np.ndarray:
    """Single class of each id, SINGLE for the others."""
    return np.minimum(class_table(count, np.zeros((len(count), SINGLE + 1)))[0], SINGLE)


def _followed(encoded: DataFrame, count: np.ndarray) -> np.ndarray:
    """For every id the classes before it, summed over the texts."""
    single = encoded.sparkSession.sparkContext.broadcast(_single_classes(count))

    def run(batches):
        total = np.zeros(len(single.value) * (SINGLE + 1), np.int64)
        for b in batches:
            for raw in b.column("ids").to_pylist():
                ids = np.frombuffer(raw, np.int32).astype(np.int64)
                np.add.at(total, ids[1:] * (SINGLE + 1) + single.value[ids[:-1]], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "c"])

    got = encoded.select("ids").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(len(count) * (SINGLE + 1))
    out[got["pair"].to_numpy(np.int64)] = got["c"].to_numpy()
    return out.reshape(len(count), SINGLE + 1)


def laid_out(encoded: DataFrame) -> tuple[DataFrame, int]:
    """The texts dealt by the hash of their row number, so that copies spread, and the number of shards."""
    volume = (encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 4
    shards = max(1, -(-volume // SHARD_IDS))
    return encoded.repartition(shards, "row").sortWithinPartitions("row"), shards


def train(texts: DataFrame, count: np.ndarray, file) -> tuple[Attention, np.ndarray, np.ndarray]:
    """(weights, class of each id, log share of each id) from all training texts."""
    spark = texts.sparkSession

    def encode(batches):
        sub = Subwords(file.value)
        for b in chain.from_iterable(map(_portions, batches)):
            texts = [_words(t) for t in b.column("text").to_pylist()]
            sub.learn(chain.from_iterable(texts))
            out = [sub.ids(sub.numbers(words)).tobytes() for words in texts]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.binary())], names=["row", "ids"])

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "text").where(F.col("row") % EVERY == 0)
    encoded = cut_lineage(rows.mapInArrow(encode, "row bigint, ids binary"))
    cls, within, share = class_table(count, _followed(encoded, count))
    model = Attention(len(count), SINGLE + CLUSTERS, share)
    laid, shards = laid_out(encoded)
    laid = cut_lineage(laid)

    def mean(batches):
        """The mean of the weights, by ids seen."""
        weights, n = 0.0, 0
        for b in batches:
            for w, k in zip(b.column("weights").to_pylist(), b.column("n").to_pylist(), strict=True):
                weights, n = weights + np.frombuffer(w, np.float32).astype(np.float64) * k, n + k
        if n:
            flat = (weights / n).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

    for _ in range(ROUNDS):
        begun = spark.sparkContext.broadcast((model, cls))

        def steps(batches, begun=begun):
            docs = [np.frombuffer(raw, np.int32) for b in batches for raw in b.column("ids").to_pylist()]
            for at in range(0, len(docs), 100_000):
                mine, (start, classes) = docs[at:at + 100_000], begun.value
                own = Attention(start.n, len(start.c), np.ones(len(start.c)))
                own.load(start.flat())
                x, y, _ = own.windows(mine)
                own.steps(x, np.where(y >= 0, classes[y], -1))
                n = int(sum(map(len, mine)))
                yield pa.RecordBatch.from_arrays([pa.array([own.flat().tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

        kind = "weights binary, n bigint"
        got = laid.select("ids").mapInArrow(steps, kind)
        n = shards
        while n > FAN_IN:          # levels, so that no task averages many shards
            n = -(-n // FAN_IN)
            got = got.repartition(n).mapInArrow(mean, kind)
        got = got.coalesce(1).mapInArrow(mean, kind).collect()
        if got:
            model.load(np.frombuffer(got[0]["weights"], np.float32))
    return model, cls, within


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the words of the highest powers of two that number ``most`` at most."""
    level = F.floor(F.log2("c"))
    found, least = 0, 64
    for r in counts.groupBy(level.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        found += r["n"]
        if found > most:
            break
        least = r["b"]
    rows = counts.where(level >= least).select("h", "c").collect()
    h, c = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def score(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    texts = docs.select("doc_id", as_bytes().alias("text"))
    training = texts.where(~held_out())
    counts = cut_lineage(word_counts(training.select("text")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    subwords = subword_counts(counts, file)
    model, cls, within = train(training, subwords, file)
    common = frequent_words(counts)
    shared = spark.sparkContext.broadcast((model, cls, within, common))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        model, cls, within, (known, c) = shared.value
        model.tables()
        sub = Subwords(file.value)
        hit, worth = np.zeros(0, bool), np.zeros(0)      # of the words' numbers: broadcast count, its logarithm
        for b in batches:
            for part in _portions(b):
                words = [_words(t) for t in part.column("text").to_pylist()]
                if sub.learn(chain.from_iterable(words)):
                    hit, worth = hit[:0], worth[:0]
                new = sub.hashes[len(hit):len(sub.number)]
                i = np.searchsorted(known, new)
                ok = np.append(known, np.uint64(0))[i] == new
                ok &= i < len(known)
                hit, worth = np.append(hit, ok), np.append(worth, np.where(ok, np.append(np.log10(c + 0.5), 0.0)[i], 0.0))
                numbers = [sub.numbers(w) for w in words]
                x, y, owner = model.windows([sub.ids(k) for k in numbers])
                total = np.zeros(len(words))
                for s in range(0, len(x), 256):
                    ys = y[s:s + 256]
                    ok, safe = ys >= 0, np.maximum(ys, 0)
                    got = model.class_scores(x[s:s + 256], np.take(cls, safe)) + np.take(within, safe)
                    total += np.bincount(owner[s:s + 256], np.where(ok, got, 0).sum(1, dtype=np.float64), len(words))
                out = {k: [] for k in ("n_tokens", "n", "base", "rare")}
                for k in numbers:
                    mine = hit[k]
                    row = (len(k), int(mine.sum()), float(worth[k].sum()), sub.hashes[k[~mine]].view(np.int64))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n"], pa.int64()),
                     pa.array(out["base"], pa.float64()), pa.array(out["rare"], pa.list_(pa.int64())), pa.array(total / math.log(10))],
                    names=["rid", "doc_id", "n_tokens", "n", "base", "rare", "score"])

    rows = cut_lineage(texts.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        run, f"rid bigint, doc_id {kind}, n_tokens bigint, n bigint, base double, rare array<bigint>, score double"))
    joined = rows.select("rid", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = joined.groupBy("rid").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"))
    each = math.log10(n + 0.5 * (v + 1))
    return rows.drop("rare").join(rare, "rid", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
