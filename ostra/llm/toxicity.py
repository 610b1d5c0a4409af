"""Toxicity by subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams (with its ends marked), each hashed to an embedding;
a window of words is the average of their embeddings, and a linear softmax over it says toxic or
not. Embeddings and softmax are trained jointly in numpy. Unseen spellings of a word share most
of its n-grams and so its vector. A text is as toxic as its worst window; in training that window
is chosen anew in every round, so a few words in a long text are found.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.llm.common import text_bytes

#: Labelled toxic and clean rows on which the model is fitted, those of smallest hash, and the bytes of their texts.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 1000, 7000, 40 << 20
BUCKETS, DIM, WINDOW = 1 << 18, 8, 2
GRAMS = (3, 4, 5, 6)
ROUNDS, RATE, SEED = 12, 0.1, 3
#: Words of one text, and of one step's texts, in the first rounds of training; a bound of the fit's memory only.
LONG, STEP_WORDS = 4000, 12_000
THRESHOLD = 0.3
MEMO = 400_000

#: Word characters, upper case as lower; ``@ $ *`` are ones as well, as they stand for letters in disguised words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in b"@$*" else 32 for b in range(256))
#: What disguised spellings put for a letter.
_LOOKS = {97: b"4@", 98: b"8", 101: b"3", 103: b"9", 105: b"1", 108: b"1", 111: b"0", 115: b"5$", 116: b"7"}


def words_of(text: bytes) -> list[bytes]:
    """Lower-case runs of letters, digits, non-ASCII characters and ``@ $ *``."""
    return text.translate(_LOWER).split()


def misspelt(word: bytes, rng: random.Random) -> bytes:
    """The word with one edit: a letter doubled, dropped, replaced, put for by one that looks alike, or two swapped."""
    if len(word) < 4:
        return word
    w, at = bytearray(word), rng.randrange(1, len(word) - 1)
    edit = rng.randrange(6)
    if edit == 0:
        w.insert(at, w[at])
    elif edit == 1:
        del w[at]
    elif edit == 2:
        w[at], w[at + 1] = w[at + 1], w[at]
    elif edit == 3:
        w[at] = rng.randrange(97, 123)
    elif edit == 4:
        w.insert(at, rng.randrange(97, 123))
    else:
        looks = _LOOKS.get(w[at], b"*")
        w[at] = looks[rng.randrange(len(looks))]
    return bytes(w)


def grams(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, word after word, and how many each word has (at least one).

    FNV-1a over the UTF-8 bytes of ``<word>``, for all words at once: n-grams that reach beyond
    their word are masked out.
    """
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(length.cumsum(), length) - np.arange(len(raw))  # bytes up to the word's end
    hashes, owners = [], []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = np.full(m, (2166136261 + n) & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ raw[i : m + i]) * np.uint32(16777619)
        inside = left[:m] >= n
        hashes.append(h[inside])
        owners.append(owner[:m][inside])
    h, of = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    h = h[order]
    return ((h ^ (h >> np.uint32(15))) % np.uint32(buckets)).astype(np.int64), np.bincount(of, minlength=len(words))


class Model:
    """What embeddings, softmax ``w`` and its bias ``b`` come to: a weight for each bucket, as both layers are linear."""

    def __init__(self, weight: np.ndarray, bias: float, fitted: bool = True) -> None:
        self.weight, self.bias, self.fitted = weight, bias, fitted
        self.memo: dict[bytes, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The logit of each text's worst window; a shorter text is one window, an empty one has only the bias."""
        split = [words_of(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.sums, self.counts = {}, np.zeros(0), np.zeros(0)
        memo = self.memo
        new = [w for w in {w for words in split for w in words} if w not in memo]
        for at in range(0, len(new), 1 << 16):
            part = new[at : at + (1 << 16)]
            g, n = grams(part, len(self.weight))
            self.sums = np.r_[self.sums, np.add.reduceat(self.weight[g], np.r_[0, n.cumsum()[:-1]])]
            self.counts = np.r_[self.counts, n]
            memo.update(zip(part, range(len(memo), len(memo) + len(part)), strict=True))
        out = np.full(len(texts), self.bias)
        for k, words in enumerate(split):
            if words:
                ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                n = min(WINDOW, len(words))
                s, c = np.r_[0.0, self.sums[ids].cumsum()], np.r_[0.0, self.counts[ids].cumsum()]
                out[k] += ((s[n:] - s[:-n]) / (c[n:] - c[:-n])).max()
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each text's worst window."""
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Fit on whole texts: first on averages over texts, then on each text's worst window and random ones of clean texts.

    Each window is learnt a second time with its words misspelt, clean ones too, so that spellings never
    seen are told by what is left of the word. ``texts`` is emptied while it is read, so that a driver holds them once. Small
    samples get more rounds.
    """
    rng, edits = np.random.default_rng(seed), random.Random(seed)
    w, b = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    y = np.asarray(labels, np.int64)
    vocabulary: dict[bytes, int] = {}
    docs: list[np.ndarray] = []
    texts.reverse()
    while texts:
        docs.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words_of(texts.pop())], np.int32))
    full = [k for k in range(len(docs)) if len(docs[k])]
    if len({int(y[k]) for k in full}) < 2:  # nothing to learn: the rate of the labels
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1), float(np.log(p / (1 - p))), fitted=False)
    e = rng.normal(0, 0.1, (buckets, DIM)).astype(np.float32)
    bags, sizes, words = [], [], list(vocabulary)
    known = len(words)
    for at in range(0, len(words), 1 << 14):
        g, n = grams(words[at : at + (1 << 14)], buckets)
        bags.append(g.astype(np.int32))
        sizes.append(n.astype(np.int32))
    flat, size = np.concatenate(bags), np.concatenate(sizes).astype(np.int64)
    del vocabulary, bags, sizes
    start = np.r_[0, size.cumsum()]
    ge, gw, gb = np.full(buckets, 1e-3, np.float32), np.full_like(w, 1e-3), np.full_like(b, 1e-3)

    def gather(ids: np.ndarray) -> np.ndarray:
        n = size[ids]
        return flat[np.repeat(start[ids] - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())]

    def step(spans: list[np.ndarray], target: np.ndarray, rate: float) -> None:
        """One Adagrad step on a batch of word spans, through both layers."""
        nonlocal w, b
        m = np.array([len(s) for s in spans])
        first = np.r_[0, m.cumsum()[:-1]]
        words_, place = np.unique(np.concatenate(spans), return_inverse=True)  # each word's n-grams are summed once
        own, every = size[words_], gather(words_)
        n = np.add.reduceat(own[place], first)
        h = np.add.reduceat(np.add.reduceat(e[every], np.r_[0, own.cumsum()[:-1]], axis=0)[place], first, axis=0) / n[:, None]
        p = softmax(h @ w + b)
        d = p.copy()
        d[np.arange(len(target)), target] -= 1
        dh = (d @ w.T / n[:, None]).astype(np.float32)
        dw, db = h.T @ d / len(target), d.mean(axis=0)
        order = np.argsort(place, kind="stable")
        of_word = np.add.reduceat(dh[np.repeat(np.arange(len(m)), m)[order]], np.r_[0, np.bincount(place).cumsum()[:-1]], axis=0)
        order = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
        g, hit = np.add.reduceat(np.repeat(of_word, own, axis=0)[order], at, axis=0), every[order][at]
        ge[hit] += (g * g).mean(axis=1)
        e[hit] -= rate * g / np.sqrt(ge[hit])[:, None]
        gw[:] += dw * dw
        gb[:] += db * db
        w = w - rate * dw / np.sqrt(gw)
        b = b - rate * db / np.sqrt(gb)

    rounds = max(rounds, min(6 * rounds, 40_000 // len(full)))
    whole = max(2, rounds // 6)
    for r in range(rounds):
        flat, size, start = flat[: start[known]], size[:known], start[: known + 1]  # without the last round's spellings
        per_word = np.add.reduceat((e @ (w[:, 1] - w[:, 0]).astype(np.float32))[flat].astype(np.float64), start[:-1])
        spans, target = [], []
        for k in rng.permutation(full):
            d = docs[k]
            n = min(WINDOW, len(d))
            s, c = np.r_[0.0, per_word[d].cumsum()], np.r_[0, size[d].cumsum()]
            logit = (s[n:] - s[:-n]) / (c[n:] - c[:-n])
            best = int(logit.argmax())
            if r < whole:  # whole texts, in pieces; of a toxic one the piece about its worst window, as the others may be clean
                first = max(0, min(best - LONG // 2, len(d) - LONG))
                pieces = [d[first : first + LONG]] if y[k] else [d[at : at + LONG] for at in range(0, len(d), LONG)]
                spans += pieces
                target += [y[k]] * len(pieces)
                continue
            spans.append(d[best : best + n])
            target.append(y[k])
            if not y[k]:
                for _ in range(2):  # the next worst ones that don't overlap, and a random one
                    logit[max(0, best - n + 1) : best + n] = -np.inf
                    best = int(logit.argmax())
                    spans.append(d[best : best + n])
                at = int(rng.integers(len(logit)))
                spans.append(d[at : at + n])
                target += [0, 0, 0]
        if r >= whole:  # as many windows again, misspelt
            spelt: list[bytes] = []
            for k in range(len(spans)):
                spans.append(np.arange(len(spelt), len(spelt) + len(spans[k])) + known)
                target.append(target[k])
                spelt += [misspelt(words[i], edits) for i in spans[k].tolist()]
            g, n = grams(spelt, buckets)
            flat, size = np.r_[flat, g.astype(np.int32)], np.r_[size, n]
            start = np.r_[0, size.cumsum()]
            order = rng.permutation(len(spans))
            spans, target = [spans[i] for i in order], [target[i] for i in order]
        t, at = np.array(target), 0
        while at < len(spans):  # a step's spans by number and by words
            end, some = at, 0
            while end < len(spans) and end - at < (64 if r < whole else 256) and (end == at or some + len(spans[end]) <= STEP_WORDS):
                some += len(spans[end])
                end += 1
            step(spans[at:end], t[at:end], RATE * (4 if r < whole else 1))
            at = end
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0]))


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, most_bytes: int = FIT_BYTES) -> Model:
    """Train on labelled rows outside the held-out fold: up to ``toxic`` and ``clean`` rows of smallest hash,
    and of those, in that order, the texts that fit into what is left of ``most_bytes``. Both are bounds of the fit only.

    Null labels, null ids and null texts teach nothing; a doc_id's label is 1 if any of its rows says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean))
    ids = some.select("doc_id", "toxic").toPandas()
    spark = docs.sparkSession
    if not len(ids):
        return train([], np.array([]))
    chosen = F.broadcast(spark.createDataFrame(ids))  # toxic + clean rows of two numbers
    sizes = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("n")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("n").alias("n")).toPandas()
    sizes = sizes.assign(h=pd.util.hash_array(sizes.doc_id.to_numpy(), categorize=False)).sort_values(["h", "doc_id"])
    left, fits = most_bytes, []
    for n in sizes.n.tolist():
        fits.append(n <= left)
        left -= n if fits[-1] else 0
    sizes = sizes[np.array(fits, bool)]
    if not len(sizes):
        return train([], np.array([]))
    chosen = F.broadcast(spark.createDataFrame(sizes[["doc_id", "toxic"]].astype("int64")))
    # of several texts with one id the smallest counts
    got = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = got.select("doc_id", "toxic", F.col("text").cast("binary")).orderBy("doc_id").toArrow()
    y, texts = rows["toxic"].to_numpy(), rows["text"].to_pylist()
    del rows
    return train(texts, y)


def held_out(doc_id: str = "doc_id"):
    """The fold that teaches nothing: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def scorer(spark, model: Model):
    """A column function from texts to scores; null texts are scored as empty ones."""
    shipped = spark.sparkContext.broadcast((model.weight, model.bias))  # 2 MB, by BUCKETS
    made: list[Model] = []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(Model(*shipped.value))
        for batch in batches:
            yield pa.array(made[0].score(text_bytes(batch)), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...).

    Only texts are scored, whole; labels teach by ``fit``. Null and empty texts get the score of an
    empty window. Without labelled texts of both classes every score is the rate of the labels seen, and none is
    predicted toxic. Repeated rows are scored each.
    """
    model = fit(docs, labels)
    score = scorer(docs.sparkSession, model)
    out = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", ((F.col("score") >= threshold) & F.lit(model.fitted)).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all columns; a map, texts aren't shuffled.

    Without labelled texts of both classes nothing can be told apart, and all rows stay.
    """
    model = fit(docs, labels)
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < threshold) if model.fitted else docs
