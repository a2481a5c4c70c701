"""Benchmark decontamination by a prefix-filtered containment join.

Every item is cut into item-sized windows (``window`` consecutive words; an
item with fewer words, but not none, is one window).  A document contains a
window when all shingles of the window stand there in place, so the required
overlap is the whole shingle set and the necessary prefix is one shingle.

1. The shingles of all windows are counted over all documents.
2. Within each window they are ordered by rarity; the rarest is its prefix.
   Windows whose prefix stands in no document are done.
3. Document shingles are joined with the prefixes, each with the words around it
   that a window can reach.  A candidate must leave room before it (position) and
   behind it (length), then its words must equal the window's.

Documents emit only shingles that pass a sieve: a bit table of fixed size of the
shingles looked for, which loses none.  The sieve is the only thing sent to the
executors; windows, counts and prefixes are Spark tables, so the benchmark may
be of any size.  Prefixes that many documents hold meet them by broadcast where
they are few; other joins are plain equi-joins that adaptive execution can split.

Defined cases: null and empty texts have no words, are never hit and hit
nothing; repeated document rows and rows without an id give a row each; items
with equal text are all named; items without an id hit as any other, count
together as one item, and add no id to the hash of the items' ids; an empty
benchmark leaves all documents clean; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import KEY, keyed
from .scratch import lean, materialize, release, small_batches
from .text import PUNCT, Rolling, find_words, signed, text_slices, window_starts

SHINGLE = 3
SIEVE_BITS = 25
SLOT_BITS = 18
#: Prefixes of more document rows than this are hot; at most so many windows of
#: hot prefixes are broadcast.
HOT_ROWS = 1_000
BROADCAST_WINDOWS = 50_000


def item_windows(benchmark: DataFrame, window: int, text_col: str, item_col: str) -> DataFrame:
    """Distinct windows: words joined by one space, their number, the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, items = [], [], []
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = find_words(data, offsets, PUNCT, lower=True)
                for k in range(hi - lo):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    size = min(window, b - a)
                    for s in range(a, b - size + 1 if size else a):
                        texts.append(words.slice_bytes(s, s + size))
                        counts.append(size)
                        items.append(ids[lo + k])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(items, pa.string())], names=["words", "size", "item"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    known, unknown = F.collect_set("item"), F.when(F.bool_or(F.col("item").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return rows.mapInArrow(lean(cut), "words binary, size long, item string").groupBy("words", "size").agg(F.concat(known, unknown).alias("items"))


def _shingles(windows: DataFrame) -> DataFrame:
    """(shingle, k, window, place) of all shingles of all windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(1)):
                words = find_words(data, offsets, PUNCT, lower=False)
                rolling, sizes = Rolling(words.prefix_hash()), np.diff(words.first)
                for k in range(1, SHINGLE + 1):
                    text, place = window_starts(words.first, k)
                    keep = np.minimum(sizes, SHINGLE)[text] == k
                    text, place = text[keep], place[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(rolling.at(place, k))), pa.array(np.full(len(text), k, np.int32)), batch.column(0).take(pa.array(lo + text)), pa.array((place - words.first[text]).astype(np.int32))],
                        names=["shingle", "k", "window", "place"],
                    )

    return windows.select("window", "words").mapInArrow(lean(cut), "shingle long, k int, window long, place int")


class Sieve:
    """A bit table of hashes: never misses one, and lets few others pass."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - (8 * len(self.bits)).bit_length() + 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        at = self.places(hashes)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sieve(shingles: DataFrame) -> Sieve:
    """Of the column ``shingle``; collected are at most 2**SIEVE_BITS bits."""
    width, size = 1 << (SLOT_BITS - 3), 1 << (SIEVE_BITS - 3)

    def packed(table: np.ndarray) -> pa.RecordBatch:
        slots = [i for i in range(len(table) // width) if table[i * width : (i + 1) * width].any()]
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([zlib.compress(table[i * width : (i + 1) * width].tobytes(), 1) for i in slots], pa.binary())], names=["slot", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Sieve(np.zeros(size, dtype=np.uint8))
        for batch in batches:
            found.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield packed(found.bits)

    def unite(rows) -> np.ndarray:
        table = np.zeros(size, dtype=np.uint8)
        for slot, bits in rows:
            table[slot * width : (slot + 1) * width] |= np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
        return table

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(unite((slot, bits.as_py()) for batch in batches for slot, bits in zip(batch.column(0).to_pylist(), batch.column(1))))

    schema = "slot int, bits binary"
    slots = shingles.select("shingle").mapInArrow(lean(mark), schema).repartition(max(1, size // width), "slot").mapInArrow(lean(join), schema)
    return Sieve(unite((r["slot"], r["bits"]) for r in slots.collect()))  # one row a slot


def _corpus_counts(docs: DataFrame, found: Sieve, lengths: list[int]) -> DataFrame:
    """(shingle, n): how often the shingles that pass stand in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = find_words(data, offsets, PUNCT, lower=True)
                rolling = Rolling(words.prefix_hash())
                hashes = np.concatenate([rolling.at(window_starts(words.first, k)[1], k) for k in lengths])
                keys, n = np.unique(hashes[shared.value.passes(hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


_ROWS = f"{KEY} long, doc_id long, n_words long, places array<struct<shingle:long,k:int,pos:long,before:int,words:string>>"


def _places(docs: DataFrame, found: Sieve, lengths: list[int], window: int) -> DataFrame:
    """Each row with its number of words and the shingles that pass, with the
    words that a window over them can reach."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("k", pa.int32()), ("pos", pa.int64()), ("before", pa.int32()), ("words", pa.string())]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words = find_words(data, offsets, PUNCT, lower=True)
                rolling = Rolling(words.prefix_hash())
                rows: list[list[dict]] = [[] for _ in range(hi - lo)]
                for k in lengths:
                    text, place = window_starts(words.first, k)
                    hashes = rolling.at(place, k)
                    hit = np.flatnonzero(shared.value.passes(hashes))
                    text, place, hashes = text[hit], place[hit], signed(hashes[hit])
                    begin, end = np.maximum(place - window + k, words.first[text]), np.minimum(place + window, words.first[text + 1])
                    for t, p, h, a, b in zip(text.tolist(), place.tolist(), hashes.tolist(), begin.tolist(), end.tolist()):
                        rows[t].append({"shingle": h, "k": k, "pos": p - int(words.first[t]), "before": p - a, "words": words.slice_bytes(a, b).decode()})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(rows, kind)], names=[KEY, "doc_id", "n_words", "places"])

    return docs.mapInArrow(lean(match), _ROWS)


def _met(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The equi-join of document shingles with prefixes."""
    hot = prefixes.where(F.col("n") > HOT_ROWS)
    if not 0 < hot.count() <= BROADCAST_WINDOWS:
        return places.join(prefixes, ["shingle", "k"])
    keys = F.broadcast(hot.select("shingle", "k").distinct())
    return places.join(F.broadcast(hot), ["shingle", "k"]).unionByName(places.join(keys, ["shingle", "k"], "left_anti").join(prefixes.where(F.col("n") <= HOT_ROWS), ["shingle", "k"]))


def _merged(hits: DataFrame) -> DataFrame:
    """(key, spans): overlapping and touching spans of each row as one."""
    by = W.partitionBy(KEY).orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    new = hits.select(KEY, "start", "end").distinct().withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    islands = new.withColumn("island", F.sum("new").over(by)).groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: n_words, merged hit word spans, and the items found."""
    small_batches(docs.sparkSession)
    docs = keyed(docs).select(KEY, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    windows = materialize(item_windows(benchmark, window, item_text_col, item_col).withColumn("window", F.monotonically_increasing_id()), "item-windows")
    shingles = materialize(_shingles(windows), "item-shingles")
    lengths = sorted(r[0] for r in shingles.select("k").distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers
    counts = _corpus_counts(docs, sieve(shingles), lengths)
    rarest = F.min(F.struct("n", "shingle", "place", "k")).alias("p")
    first = shingles.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("window").agg(rarest).where("p.n > 0")
    prefixes = materialize(first.select("window", "p.*").join(windows, "window"), "prefixes")
    release(shingles)
    rows = materialize(_places(docs, sieve(prefixes), lengths, window), "shingle-places")
    places = rows.select(KEY, F.explode("places").alias("x")).select(KEY, "x.shingle", "x.k", "x.pos", "x.before", F.split("x.words", " ").alias("around"))
    at = F.col("before") - F.col("place")
    room = (at >= 0) & (at + F.col("size") <= F.size("around"))
    same = F.array_join(F.slice("around", at + 1, F.col("size").cast("int")), " ") == F.col("words").cast("string")
    start = F.col("pos") - F.col("place")
    hits = _met(places, prefixes.select("shingle", "k", "place", "size", "words", "items", "n")).where(room).where(same)
    hits = materialize(hits.select(KEY, start.alias("start"), (start + F.col("size")).alias("end"), "items"), "hits")
    items = hits.groupBy(KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = rows.select(KEY, "doc_id", "n_words").join(_merged(hits).join(items, KEY), KEY, "left").drop(KEY)
    return out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def digest(found: DataFrame) -> DataFrame:
    """The columns of the decontamination report."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def sha256_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
