"""Toxicity scores: gradient-boosted trees over dense text features.

Features of a text: densities of a seed lexicon and of a learned lexicon (words
and word beginnings that mark toxic training texts), their counts and spread,
second-person words near them, shares of capitals, exclamation and other
punctuation, obfuscated words (letters mixed with digits or marks), repeated
words, length.  Trees are fitted with logistic loss; scores of texts that the
trees had not seen calibrate them by isotonic regression.

The training sample is bounded: ``SAMPLE`` toxic and ``SAMPLE`` other labelled
documents, chosen by a hash of the id, whole texts.  Two halves cross over: the
lexicon and trees of one score the other, so that neither the trees nor the
calibration see words that were chosen on the same texts.  Scoring reads every
whole text in slices of bounded size and shuffles nothing.

Defined cases: null counts as empty; texts without words get the toxic share of
the labels, as nothing speaks for or against; null labels are not learned from, contradictory ones
count as toxic; without both classes in training every score is the toxic share
(0 without labels); repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import lean, small_batches
from .text import PUNCT, SPACE, find_words, signed, text_slices

SAMPLE = 4_000
LEXICON = 20_000
STEMS = (4, 5, 6, 7)
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
NEAR = 5
N_WORDS = 13  # the place of the length among the features
#: Common insults and second-person words.
INSULTS = "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting filthy clown fool creep ugly vermin imbecile jerk freak".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti vosotros".split()
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "*@$#%&!"]] = True


def hash_words(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in data])]).astype(np.int64)
    found = find_words(np.frombuffer(b"".join(data), np.uint8), offsets, PUNCT, lower=True)
    return np.unique(found.prefix_hash())


def word_keys(words) -> list[np.ndarray]:
    """Keys of all words: whole, and each stem (0 where the word is shorter)."""
    length = words.end - words.start
    out = [words.prefix_hash()]
    for n in STEMS:
        key = words.prefix_hash(np.minimum(length, n)) ^ np.uint64(n)
        key[length <= n] = 0
        out.append(key)
    return out


class KeySet:
    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.shift = np.uint64(64 - bits)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = self.table[(keys >> self.shift).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = np.isin(keys[at], self.keys)
        return out


def dense_features(data: np.ndarray, offsets: np.ndarray, lexicon: KeySet, seeds: KeySet, second: KeySet) -> np.ndarray:
    """One row of features for each text."""
    n = len(offsets) - 1
    words = find_words(data, offsets, PUNCT, lower=True)
    owner = words.text_of_word()
    keys = word_keys(words)
    seed, you = seeds.holds(keys[0]), second.holds(keys[0])
    learned = np.zeros(len(words), dtype=bool)
    for k in keys:
        learned |= lexicon.holds(k)
    marked = seed | learned
    n_words = np.diff(words.first).astype(float)
    per = lambda flags: np.bincount(owner, weights=flags, minlength=n) if len(owner) else np.zeros(n)
    reach = np.cumsum(np.concatenate([[0], marked]))
    at = np.flatnonzero(you)
    lo, hi = np.maximum(at - NEAR, words.first[owner[at]]), np.minimum(at + NEAR + 1, words.first[owner[at] + 1])
    close = np.zeros(len(words))
    close[at] = reach[hi] > reach[lo]
    raw = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]).astype(float)
    chars, letters, capitals = np.diff(offsets).astype(float), raw(_ALPHA), raw(_UPPER)
    tokens = find_words(data, offsets, SPACE, lower=False)
    count = lambda table, f=tokens: np.concatenate([[0], np.cumsum(table[f.data])])
    within = lambda table: (lambda c: c[tokens.end] - c[tokens.start])(count(table))
    a, d, m = within(_ALPHA), within(_DIGIT), within(_MARK)
    m_end = np.zeros(len(tokens))
    m_end[:] = _MARK[tokens.data[tokens.end - 1]] if len(tokens) else 0
    odd = (a > 0) & ((d > 0) | (m - m_end > 0)) & (tokens.end - tokens.start <= 20)
    odd_share = np.bincount(tokens.text_of_word(), weights=odd, minlength=n) if len(tokens) else np.zeros(n)
    repeated = np.zeros(len(words))
    repeated[1:] = (keys[0][1:] == keys[0][:-1]) & (owner[1:] == owner[:-1])
    w = np.maximum(n_words, 1)
    columns = [
        per(marked) / w, np.minimum(per(marked), 20), per(seed) / w, np.minimum(per(seed), 20), per(learned) / w, np.minimum(per(learned), 20),
        per(you) / w, per(close), capitals / np.maximum(letters, 1), raw(_MARK) / np.maximum(chars, 1), raw(_DIGIT) / np.maximum(chars, 1),
        odd_share / np.maximum(np.diff(tokens.first), 1), per(repeated) / w, np.log1p(n_words), letters / np.maximum(chars, 1),
    ]
    return np.stack(columns, axis=1)


class Trees:
    """Boosted regression trees on quantile bins, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], qs)) for j in range(x.shape[1])]
        bins = self._bins(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Nested (feature, bin, left, right) or leaf value."""

        def node(rows: np.ndarray, depth: int):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            leaf = float(RATE * total_g / (total_h + 1))
            if depth == DEPTH or len(rows) < 10:
                return leaf
            best = (1e-3, None, None)
            for j in range(bins.shape[1]):
                gs = np.cumsum(np.bincount(bins[rows, j], weights=g[rows], minlength=BINS))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, j], weights=h[rows], minlength=BINS))[:-1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] is None:
                return leaf
            right = bins[rows, best[1]] > best[2]
            return best[1], best[2], node(rows[~right], depth + 1), node(rows[right], depth + 1)

        return node(np.arange(len(g)), 0)

    def _apply(self, tree, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))

        def walk(t, rows: np.ndarray) -> None:
            if not isinstance(t, tuple):
                out[rows] = t
                return
            right = bins[rows, t[0]] > t[1]
            walk(t[2], rows[~right])
            walk(t[3], rows[right])

        walk(tree, np.arange(len(bins)))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._bins(x), np.full(len(x), self.start)
        for tree in self.trees:
            out += self._apply(tree, bins)
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their non-decreasing values."""
    keys, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse, weights=weights)
    value = np.bincount(inverse, weights=y * weights) / weight
    blocks: list[list[float]] = []
    for k, v, w in zip(keys, value, weight):
        blocks.append([v, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, k2 = blocks.pop()
            v1, w1, k1, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1, k2])
    return np.array([k for b in blocks for k in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: KeySet
    seeds: KeySet
    second: KeySet
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    share: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        x = dense_features(data, offsets, self.lexicon, self.seeds, self.second)
        score = np.clip(np.interp(self.trees.score(x), self.knots, self.values), 0, 1)
        return np.where(x[:, N_WORDS] > 0, score, self.share)


def _known(labels: DataFrame, train: Column) -> DataFrame:
    known = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))


def _training_rows(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", half.alias("half"))  # 2 x sample ids


def _key_counts(rows: DataFrame) -> list:
    """In how many toxic and other texts of each half a key stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                words = find_words(data, offsets, PUNCT, lower=True)
                owner, pairs = words.text_of_word(), []
                for keys in word_keys(words):
                    pair = np.unique(np.stack([keys, owner.astype(np.uint64)], axis=1)[keys != 0], axis=0)
                    pairs.append(pair)
                pair = np.concatenate(pairs)
                kind = (toxic[lo + pair[:, 1].astype(np.int64)] * 2 + half[lo + pair[:, 1].astype(np.int64)]).astype(np.int64)
                keys, at = np.unique(pair[:, 0], return_inverse=True)
                table = np.bincount(at * 4 + kind, minlength=4 * len(keys)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), *(pa.array(table[:, k].astype(np.int64)) for k in range(4))], names=["key", "n0", "n1", "t0", "t1"])

    counted = rows.mapInArrow(lean(count), "key long, n0 long, n1 long, t0 long, t1 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1")))
    marking = F.col("t0") + F.col("t1") > 2 * (F.col("n0") + F.col("n1"))
    return counted.where((F.col("t0") + F.col("t1") >= 3) & marking).orderBy(F.desc(F.col("t0") + F.col("t1")), "key").limit(LEXICON).collect()


def _pick(counts: np.ndarray, columns: tuple[tuple[int, ...], tuple[int, ...]], n_other: int, n_toxic: int) -> np.ndarray:
    """Keys more frequent in toxic texts, by 2.5 standard errors of the log odds."""
    other, toxic = (counts[:, list(c)].sum(axis=1).astype(float) for c in columns)
    odds = ((toxic + 0.5) / (n_toxic + 1)) / ((other + 0.5) / (n_other + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return (toxic >= 3) & (np.log(odds) - 2.5 * error > 0)


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents where ``train`` (of ``labels``) holds."""
    small_batches(docs.sparkSession)
    known = _known(labels, train)
    rows = _training_rows(docs, known, sample)
    there = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = _key_counts(rows)
    seeds, second = KeySet(hash_words(INSULTS)), KeySet(hash_words(SECOND_PERSON))
    keys = np.array([r["key"] for r in found], dtype=np.int64).view(np.uint64)
    counts = np.array([[r["n0"], r["n1"], r["t0"], r["t1"]] for r in found], dtype=np.int64).reshape(-1, 4)
    size = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda toxic, *halves: sum(size.get((toxic, h), 0) for h in halves)
    lexica = [KeySet(keys[_pick(counts, ((h,), (2 + h,)), n(0, h), n(1, h))]) for h in (0, 1)]
    lexica.append(KeySet(keys[_pick(counts, ((0, 1), (2, 3)), n(0, 0, 1), n(1, 0, 1))]))
    shared = docs.sparkSession.sparkContext.broadcast((lexica, seeds, second))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexica, seeds, second = shared.value
        for batch in batches:
            half = batch.column(2).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                two = [dense_features(data, offsets, lexica[h], seeds, second) for h in (0, 1)]
                x = np.where(half[lo:hi, None] == 0, two[1], two[0])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "half", "x"])

    table = rows.mapInArrow(lean(features), "toxic int, half int, x array<double>").collect()  # 2 x sample rows
    y = np.array([float(r["toxic"] == 1) for r in table])
    total = there.get(0, 0) + there.get(1, 0)
    share = there.get(1, 0) / total if total else 0.0
    nothing = Model(lexica[2], seeds, second, None, np.zeros(1), np.zeros(1), share)
    if not 0 < y.sum() < len(y):
        return nothing
    x, half = np.array([r["x"] for r in table]), np.array([r["half"] for r in table])
    order = np.lexsort((*x.T, y, half))  # the same sums whatever the order of arrival
    x, y, half = x[order], y[order], half[order]
    raw = np.zeros(len(y))
    for h in (0, 1):
        fit_on = half != h
        if not 0 < y[fit_on].sum() < fit_on.sum() or not (half == h).any():
            raw[:] = Trees(x, y).score(x)
            break
        raw[half == h] = Trees(x[fit_on], y[fit_on]).score(x[half == h])
    # the sample holds both classes evenly; calibrated are the shares of all labels
    weights = np.where(y == 1, there.get(1, 0) / y.sum(), there.get(0, 0) / (1 - y).sum())
    knots, values = isotonic(raw, y, weights)
    return Model(lexica[2], seeds, second, Trees(x, y), knots, values, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(data, offsets) for _, _, data, offsets in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")
