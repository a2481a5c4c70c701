"""Language identification with bit-sliced Bloom filters of n-grams.

Training.  Letter n-grams (n = 3 and 4, with word borders) of labelled texts are
counted in Spark; each language keeps its ``PER_LANGUAGE`` most frequent ones.
All languages share one array of slots; a slot holds one bit per language, and a
gram sets its language's bit in ``HASHES`` slots.

Prediction.  For each n-gram of a text the masks of its slots are and-ed: the
result names every language that (probably) holds the gram.  The bits are
counted per language.  A language whose slice is filled to f lets a foreign gram
pass with probability p = f**HASHES, so of n grams with h hits
(h - n p) / (1 - p) are taken as real.  The largest corrected count decides; the
score is its share of all corrected counts.

The labelled sample is bounded (``SAMPLE`` documents of each of the ``LANGUAGES``
most frequent languages, chosen by a hash of the id, whole texts); the model's size is bounded by the number of
slots.  Prediction reads every whole text in slices of bounded size and needs no
shuffle.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
letters of no learned language give the most frequent training language with
score 0; ties go to the more frequent training language, then by name (languages
are counted over all training rows, not over the sample); without
any labelled text all results are ``und``; null labels are not learned from;
repeated rows give a row each, and rows that repeat an id teach only their own
texts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import KEY, keyed
from .scratch import lean, small_batches
from .text import mix, signed

ORDERS = (3, 4)
PER_LANGUAGE = 20_000
SLOT_BITS = 20
HASHES = 3
SAMPLE = 1_500
LANGUAGES = 256
SLICE_CHARS = 1 << 19
_BORDER = 32
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, row offsets) of the lower-cased texts."""
    at, n = 0, len(column)
    while at < n:
        texts, size, end = [], 0, at
        while end < n and (not texts or size < limit):
            t = (column[end].as_py() or "").lower()
            texts.append(t)
            size += len(t)
            end += 1
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield at, end, codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        at = end


def grams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has letters, and for each order (hashes, text)."""
    letter = letter_table()[codes]
    sums = np.concatenate([[0], np.cumsum(letter)])
    some = sums[offsets[1:]] > sums[offsets[:-1]]
    # A border stands between texts, and instead of each character that is no letter.
    n_texts = len(offsets) - 1
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    line = np.full(len(codes) + n_texts + 1, _BORDER, dtype=np.uint64)
    place = np.arange(len(codes)) + text + 1
    line[place] = np.where(letter, codes, _BORDER)
    keep = np.ones(len(line), dtype=bool)
    keep[1:] = (line[1:] != _BORDER) | (line[:-1] != _BORDER)
    owner = np.zeros(len(line), dtype=np.int64)
    owner[place] = text
    line, owner = line[keep], owner[keep]
    inner = line != _BORDER
    out = []
    for n in ORDERS:
        m = len(line) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + line[k : k + m]
        # no border inside: grams stay within one word and its two borders
        ok = np.ones(m, dtype=bool)
        for k in range(1, n - 1):
            ok &= inner[k : k + m]
        out.append((mix(h[ok]), owner[1 : m + 1][ok]))
    return some, out


def _sample(docs: DataFrame, train: Column, frequent: dict[str, int], sample: int) -> DataFrame:
    """(key, lang) of at most ``sample`` labelled rows per language, those with
    the least hashes of their ids.

    A bound on the hash leaves about twice as many rows before they are ranked,
    so no language's rows meet in one task.
    """
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(k, min(1.0, (2 * sample + 200) / n)) for k, n in frequent.items()], "lang string, bound double")
    order = F.xxhash64("doc_id")
    place = F.pmod(order, F.lit(1 << 50)) / F.lit(float(1 << 50))
    ids = docs.where(train).select(KEY, "lang", order.alias("order"), place.alias("place")).join(F.broadcast(bounds), "lang").where("place <= bound")
    by = W.partitionBy("lang").orderBy("order", KEY)
    return ids.withColumn("k", F.row_number().over(by)).where(F.col("k") <= sample).select(KEY, "lang")


class Model:
    def __init__(self, languages: list[str], rows: dict[str, np.ndarray]):
        self.languages = languages
        planes = -(-len(languages) // 64)
        self.slots = [np.zeros(1 << SLOT_BITS, dtype=np.uint8 if len(languages) <= 8 else np.uint64) for _ in range(planes)]
        for i, name in enumerate(languages):
            plane = self.slots[i // 64]
            for at in slots_of(rows[name]):
                plane[at] |= plane.dtype.type(1 << i % 64)
        fill = np.array([np.count_nonzero(self.slots[i // 64] & self.slots[0].dtype.type(1 << i % 64)) / (1 << SLOT_BITS) for i in range(len(languages))])
        self.false_rate = fill**HASHES

    def languages_of(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Masks of the languages that hold each gram, by plane of 64."""
        places = list(slots_of(hashes))
        out = []
        for plane in self.slots:
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            out.append(mask)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo, hi, codes, offsets in slices(column):
            some, orders = grams(codes, offsets)
            hits, total = np.zeros((hi - lo, len(self.languages))), np.zeros(hi - lo)
            for hashes, text in orders:
                total += np.bincount(text, minlength=hi - lo)
                masks = self.languages_of(hashes)
                for i in range(len(self.languages)):
                    bit = (masks[i // 64] >> masks[0].dtype.type(i % 64)) & masks[0].dtype.type(1)
                    hits[:, i] += np.bincount(text, weights=bit, minlength=hi - lo)
            real = np.maximum(hits - total[:, None] * self.false_rate, 0) / np.maximum(1 - self.false_rate, 1e-9)
            for k in range(hi - lo):
                if not some[k] or not self.languages:
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(np.argmax(real[k]))
                    names.append(self.languages[best])
                    scores.append(float(real[k, best] / real[k].sum()) if real[k].sum() > 0 else 0.0)
        return names, scores


def slots_of(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((hashes >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learn from ``docs`` (doc_id, text, lang) where ``train`` holds."""
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    rows = docs.where(train & F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    frequent = {r["lang"]: r["n"] for r in rows.collect()}
    chosen = _sample(docs, train, frequent, sample)
    labelled = docs.select(KEY, "text").join(F.broadcast(chosen), KEY)  # sample x languages keys

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi, codes, offsets in slices(batch.column(0)):
                _, orders = grams(codes, offsets)
                hashes, text = np.concatenate([h for h, _ in orders]), np.concatenate([t for _, t in orders])
                for name in dict.fromkeys(languages[lo:hi]):
                    keys, n = np.unique(hashes[languages[lo + text] == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(signed(keys)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = labelled.select("text", "lang").mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= per_language)
    rows = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # per_language grams each
    found = {r["lang"]: np.array(r["grams"], dtype=np.int64).view(np.uint64) for r in rows}
    return Model(sorted(found, key=lambda x: (-frequent[x], x)), found)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds nothing but reads ``doc_id`` and ``text``: doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")
