"""Substring deduplication over fixed windows of words.

A window is ``window`` consecutive words of one document.  A word goes if a
window covers it whose word sequence also starts in a document with a smaller
id; windows are judged on the input.

Rabin-Karp hashes are rolled over every window and counted in Spark.  A row per
word of the corpus would be shuffled, so two lossless sieves go first:

* Equal texts are one class.  A row whose class holds a smaller id loses each
  word that any window covers; only one row of each class goes on, under the
  class's smallest id.
* Each window names the smallest hash among its runs of ``anchor`` words.  Equal
  windows name equal anchors, hence a window can repeat in another document only
  if its anchor does.  About one run in thirteen is an anchor (window 50,
  anchor 25).

1. (anchor hash, document) -> smallest and largest document, pre-aggregated;
   anchors of one document only are done.
2. Documents with shared anchors roll the window hashes once more and emit the
   windows that name a shared anchor: hash -> smallest document.
3. Windows whose smallest document is another one are regrouped by row, merged
   into maximal intervals, and cut from the text.

Windows are equal when two independent 64-bit hashes are (one of the bytes'
polynomials is modulo 2**64, the other modulo a prime).  Aggregations combine
before the shuffle, and hashes that many documents share meet their origin by
broadcast (``skew``), so a passage held by a third of all documents does not
load one task; the positions gathered by row are bounded by its length.  Texts
are shuffled twice, by row: to roll the windows of documents with shared
anchors, and to cut.

Defined cases: null or shorter texts lose nothing; rows are judged each by
itself, and rows of one id never remove from each other; a row without an id
neither loses words nor removes any; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import KEY, keyed
from .scratch import lean, materialize, release
from .skew import join_totals
from .text import SPACE, Rolling, find_words, signed, take, text_slices, window_starts

WINDOW = 50


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (doubling)."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_anchors(rolling: Rolling, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, anchor hash) of every window."""
    text, place = window_starts(first, window)
    n = int(first[-1])
    if not len(place):
        return text, place, np.zeros(0, np.uint64)
    runs = rolling.at(np.arange(n - anchor + 1), anchor)
    return text, place, _sliding_min(runs, window - anchor + 1)[place]


def _anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(1)):
                words = find_words(data, offsets, SPACE, lower=False)
                text, _, low = window_anchors(Rolling(words.prefix_hash()), words.first, window, anchor)
                if not len(text):
                    continue
                new = np.ones(len(text), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(low[new])), take(batch.column(0), lo + text[new])], names=["anchor", KEY])

    return docs.select(KEY, "text").mapInArrow(lean(emit), f"anchor long, {KEY} long")


def _window_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows of (key, doc_id, text, shared) that name one of the row's shared anchors."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(3)
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words = find_words(data, offsets, SPACE, lower=False)
                hashes = words.prefix_hash()
                rolling = Rolling(hashes)
                text, place, low = window_anchors(rolling, words.first, window, anchor)
                keys = np.unique(shared.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                if not len(keys) or not len(low):
                    continue
                keep = keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)] == low
                text, place = text[keep], place[keep]
                other = Rolling(words.second_hash(hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(rolling.at(place, window))), pa.array(signed(other.at(place, window))), take(batch.column(0), lo + text), take(batch.column(1), lo + text), pa.array((place - words.first[text]).astype(np.int32))],
                    names=["hash", "other", KEY, "doc_id", "pos"],
                )

    return docs.mapInArrow(lean(emit), f"hash long, other long, {KEY} long, doc_id long, pos int")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Of (doc_id, text, whole, starts) the rows' results."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, removed, spans, kept = [], [], [], []
                for text, whole, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                    words = (text or "").encode().split()
                    merged: list[list[int]] = []
                    if whole and len(words) >= window:
                        merged.append([0, len(words)])
                    elif starts.is_valid:
                        for s in np.sort(starts.values.to_numpy(zero_copy_only=False)).tolist():
                            if merged and s <= merged[-1][1]:
                                merged[-1][1] = s + window
                            else:
                                merged.append([s, s + window])
                    n.append(len(words))
                    removed.append(sum(b - a for a, b in merged))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    for a, b in reversed(merged):
                        del words[a:b]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.string())], schema=schema)

    return docs.mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id) of one row of each class of equal texts, under its smallest
    id, and the keys of rows whose class has a smaller id than theirs."""
    prints = materialize(docs.where("doc_id is not null and text is not null").select(KEY, "doc_id", F.sha2("text", 256).alias("digest")), "prints")
    grouped = prints.groupBy("digest").agg(F.min(F.struct("doc_id", KEY)).alias("first"), F.count(F.lit(1)).alias("n"))
    totals = materialize(grouped, "text-classes")
    copies = join_totals(prints, totals.where("n > 1").select("digest", F.col("first.doc_id").alias("low"), "n"), ["digest"], "n").where("doc_id > low").select(KEY)
    return totals.select("first.*"), copies


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed word spans, kept text."""
    anchor = anchor or max(1, window // 2)
    docs = keyed(docs).select(KEY, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ones, copies = _classes(docs)
    anchors = materialize(_anchor_rows(docs, window, anchor).join(ones, KEY), "anchors")
    shared = materialize(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", "n"), "shared-anchors")
    by_row = materialize(join_totals(anchors, shared, ["anchor"], "n").groupBy(KEY, "doc_id").agg(F.collect_set("anchor").alias("shared")), "anchors-by-row")
    release(anchors)
    windows = materialize(_window_rows(docs.select(KEY, "text").join(by_row, KEY).select(KEY, "doc_id", "text", "shared"), window, anchor), "windows")
    release(shared, by_row)
    same = ["hash", "other"]
    origin = materialize(windows.groupBy(*same).agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("origin < last").drop("last"), "origins")
    later = join_totals(windows, origin, same, "n").where("origin < doc_id")
    starts = materialize(later.groupBy(KEY).agg(F.collect_set("pos").alias("starts")), "starts")
    release(windows, origin)
    gone = copies.select(KEY, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")).unionByName(starts.select(KEY, F.lit(False).alias("whole"), "starts"))
    gone = materialize(gone.groupBy(KEY).agg(F.max("whole").alias("whole"), F.first("starts", ignorenulls=True).alias("starts")), "removals")
    return _cut(docs.join(gone, KEY, "left").select("doc_id", "text", "whole", "starts"), window)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    """The definition, for tests on small fixtures: a result for each row."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    origin: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            origin[key] = min(i, origin.get(key, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and origin[tuple(w[k : k + window])] < i for j in range(window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
