"""Benchmark decontamination: n-gram seeds join training passages to test items, and
Smith-Waterman alignment scores the passages, so edited copies are found as well.

Texts become sequences of the items' words (any other word is -1 and aligns with nothing). Every
n-gram of an item is a seed, however many documents hold it: an edited or partial passage with
many copies makes just the n-grams frequent by which it is found. Everyday phrases are seeds too;
where they stand alone, an upper bound of the alignment's score rules the stretch out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.llm.common import text_bytes

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible alignment score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Bytes of item texts that are shipped to the tasks at once; more items are taken in blocks.
BLOCK_BYTES = 32 << 20
#: Words of a text whose seeds are looked up together.
PIECE = 1 << 18
#: Alignments computed together, by number and by words; a stretch of seeds is split behind LONG words.
TOGETHER, TOGETHER_WORDS, LONG = 128, 1 << 19, 1 << 12

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters."""
    return text.translate(_LOWER).split()


class Items:
    """A block of items: their words as numbers, and their n-grams in sorted arrays, some 20 bytes a word."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for i, t in zip(ids, texts, strict=True):
            w = words_of(t)
            if w:
                self.ids.append(i)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int32))
        self.base = len(self.vocabulary) + 1
        self.length = np.array([len(w) for w in self.words], np.int64)
        # an item shorter than a seed is a seed as a whole, so there may be seeds of several lengths
        self.seeds = {n: self._sorted([k for k in range(len(self.words)) if min(GRAM, len(self.words[k])) == n], n) for n in sorted({min(GRAM, len(w)) for w in self.words})}

    def _sorted(self, some: list[int], n: int) -> tuple[np.ndarray, ...]:
        """Different n-grams; where each one's items begin; and by n-gram the items, with its first and last place in them."""
        keys = [self.keys(self.words[k], n)[0] for k in some]
        key, item = np.concatenate(keys), np.repeat(np.array(some, np.int32), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])
        order = np.lexsort((place, item, key))
        key, item, place = key[order], item[order], place[order]
        at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])])
        last = np.r_[at[1:], len(key)] - 1
        first = np.flatnonzero(np.r_[True, np.diff(key[at]) != 0])
        return key[at][first], np.r_[first, len(at)], item[at], place[at], place[last]

    def keys(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A number for each n-gram (two may share one only beyond two million words), and whether it has no foreign word."""
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        key, good = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(n):
            part = ids[i : m + i]
            key = key * self.base + part
            good &= part >= 0
        return key, good

    def sequence(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def begins(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, first, last): for each seed in a sequence and each item that has it, between which places the item would begin."""
        different, start, item, low, high = self.seeds[n]
        key, good = self.keys(ids, n)
        at = np.flatnonzero(good)
        which = np.minimum(np.searchsorted(different, key[at]), len(different) - 1)
        found = different[which] == key[at]
        at, which = at[found], which[found]
        count = start[which + 1] - start[which]
        flat = np.repeat(start[which] - np.r_[0, count.cumsum()[:-1]], count) + np.arange(count.sum())
        at = np.repeat(at, count)
        return at, item[flat].astype(np.int64), at - high[flat], at - low[flat]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[int, int]]:
    """Smith-Waterman score and end (place in the passage behind the alignment) of each pair, all pairs at once."""
    rows, width = max(map(len, items)), max(map(len, passages))
    n = len(items)
    a, b = np.full((n, rows), -2, np.int32), np.full((n, width), -1, np.int32)
    for k in range(n):
        a[k, : len(items[k])] = items[k]
        b[k, : len(passages[k])] = passages[k]
    before = np.zeros((n, width + 1), np.int32)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        now = np.zeros_like(before)
        diagonal = before[:, :-1] + np.where(a[:, i : i + 1] == b, MATCH, MISMATCH).astype(np.int32)
        now[:, 1:] = np.maximum(np.maximum(diagonal, before[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the passage
        at = now.argmax(axis=1)
        top = now[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        before = now
    return list(zip(best.tolist(), end.tolist(), strict=True))


def most_score(held: np.ndarray) -> int:
    """The most that an alignment can score if of one side's words just the ``held`` ones stand on the other."""
    total = np.cumsum(np.where(held, MATCH, max(MISMATCH, GAP)))
    return int((total - np.minimum.accumulate(np.r_[0, total])[:-1]).max(initial=0))


class Detector:
    """Finds the items of which a text holds a passage that scores ``threshold`` at least."""

    def __init__(self, items: Items, threshold: float) -> None:
        self.items, self.threshold = items, threshold
        self.slack = (MATCH * items.length * max(0.0, 1 - threshold) / -GAP).astype(np.int64) + 1

    def _merged(self, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of one text and item that are no further apart than the item's slack, joined."""
        if not len(group):
            return group, low, high
        order = np.lexsort((low, group))
        group, low, high = group[order], low[order], high[order]
        different = np.cumsum(np.r_[0, np.diff(group) != 0])
        wide = int(max(high.max(), 0) - min(low.min(), 0)) + 1
        reached = np.maximum.accumulate(high + different * wide) - different * wide
        new = np.r_[True, (group[1:] != group[:-1]) | (low[1:] > reached[:-1] + self.slack[group[1:] % len(self.slack)])]
        at = np.flatnonzero(new)
        return group[at], low[at], np.maximum.reduceat(high, at)

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, word behind the last) of each stretch about seeds of the item.

        An alignment through a seed has no more gaps than its matches pay for above the threshold,
        so each one that reaches it lies in its seed's stretch as a whole. Seeds of all texts are looked up together, piece
        by piece, and joined at once, so a text that repeats itself takes no more memory than another.
        """
        gap = np.full(GRAM, -1, np.int32)  # no seed reaches from one text into the next
        ids = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
        start = np.r_[0, np.cumsum([len(t) + GRAM for t in texts])].astype(np.int64)
        found = [(np.zeros(0, np.int64),) * 3]
        for n in self.items.seeds:
            for at in range(0, max(1, len(ids) - n + 1), PIECE):
                place, item, low, high = self.items.begins(ids[at : at + PIECE + n - 1], n)
                text = np.searchsorted(start, place + at, "right") - 1
                found.append(self._merged(text * len(self.slack) + item, low + at - start[text], high + at - start[text]))
        group, low, high = self._merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
        item = group % max(1, len(self.slack))
        slack, length, text = self.slack[item], self.items.length[item], group // max(1, len(self.slack))
        out = []
        for k, i, a, b, more, own in zip(*(x.tolist() for x in (text, item, low, high, slack, length)), strict=True):
            for first in range(a, b + 1, LONG):
                out.append((k, i, max(0, first - more), min(len(texts[k]), min(b, first + LONG - 1) + own + more)))
        return out

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(text's place, item id, score, word behind the passage): each text's best alignment with each item, from the threshold."""
        jobs = []
        marked = np.zeros(self.items.base, bool)  # by word; the last place is that of foreign words
        read = [self.items.sequence(text) for text in texts]
        for k, item, start, end in self.candidates(read):
            own, part = self.items.words[item], read[k][start:end]
            least = self.threshold * MATCH * len(own) - 1e-6  # the bounds of both sides are exact: no alignment scores more
            for some, of in ((part, own), (own, part)):
                marked[some] = True
                marked[-1] = False
                held = marked[of]
                marked[some] = False
                if MATCH * np.count_nonzero(held) < least or most_score(held) < least:
                    break
            else:
                jobs.append((k, item, start, part))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        jobs.sort(key=lambda j: len(j[3]))
        at = 0
        while at < len(jobs):
            stop = at + 1
            while stop < min(len(jobs), at + TOGETHER) and (stop + 1 - at) * len(jobs[stop][3]) <= TOGETHER_WORDS:
                stop += 1
            part, at = jobs[at:stop], stop
            for (k, item, start, _), (score, end) in zip(part, align([self.items.words[j[1]] for j in part], [j[3] for j in part]), strict=True):
                share = score / (MATCH * len(self.items.words[item]))
                if share >= self.threshold and share > best.get((k, item), (0.0, 0))[0]:
                    best[k, item] = (share, start + end)
        return [(k, self.items.ids[item], share, end) for (k, item), (share, end) in sorted(best.items())]


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of at most ``most`` bytes; null ids and texts hold nothing to be found."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").dropDuplicates().orderBy("item_id", "text")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        raw = r.text.encode("utf-8", "replace")
        if texts and size + len(raw) > most:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(raw)
        size += len(raw)
    if texts:
        yield Items(ids, texts)


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, end_word) for each row of ``docs`` and item of which it holds a passage.

    ``score``: the alignment's score as a share of the item's best possible one, from ``threshold``.
    Whole texts are searched; a passage is aligned where it holds a seed of the item, of which items
    shorter than ``GRAM`` words have one, the whole. Null and empty texts hold nothing; repeated rows give repeated
    results; items without words are never found; of equally good passages the one that ends first counts.
    An empty table gives an empty result. Texts are never shuffled: the items go to them, in blocks of ``most`` bytes, of which each takes a pass.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    for block in item_blocks(items, most):
        shipped = spark.sparkContext.broadcast(Detector(block, threshold))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shipped.value.find(text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
                    names=["doc_id", "item_id", "score", "end_word"],
                )

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out.schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, with all columns; texts aren't shuffled."""
    spark, out = docs.sparkSession, docs
    for block in item_blocks(items, most):
        shipped = spark.sparkContext.broadcast(Detector(block, threshold))
        out = out.where(clean_column(shipped)(F.col("text")))
    return out


def clean_column(shipped):
    """A column function from texts to whether they hold no passage of the shipped detector's items."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            clean = np.ones(len(batch), bool)
            clean[[f[0] for f in shipped.value.find(text_bytes(batch))]] = False
            yield pa.array(clean)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")
