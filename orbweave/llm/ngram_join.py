"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), exact.

A document's set holds the hashes of its distinct 5-word shingles.  Documents
link when 100 * intersection >= ``percent`` * union; the result gives each
document the smallest id that it reaches over links.

1. All shingles of all documents are counted into a count-min sketch of fixed
   size.  It only orders shingles by rarity, so its errors cost time, never
   links.
2. Equal sets are one class, kept by its smallest id.
3. Of two linked sets the larger asks and the smaller is listed.  Let n <= m be
   their sizes and a = ceil(percent * (n + m) / (100 + percent)); they share a
   shingles or more.  In the common order the l-th shared one has a - l shared
   ones behind it, so it is among the first n - a + l of the smaller and the
   first m - a + l of the larger.  The smaller set is listed under the first of
   these (with n for m, the least a); the larger asks the lists of each band of
   sizes (bands of 3 %) with the second, for the least n of the band.  So sets
   of nearly one size meet only by their first ninth, and sets just below the
   threshold hardly at all.  l grows with the set, so that the required number
   of occurrences T is two or more but for tiny sets; T follows from both sizes
   (``occurrences``).
4. A token with more than ``HOT`` components first links its sets to a few
   pivots, which costs some rows per set; exactly verified links join them into
   components.  A large group of near copies collapses here
   instead of giving all its pairs.
5. The T-occurrence search runs on the lists that still hold several
   components, and only between different components: for each query the short
   lists are merged with a heap, the longest are probed by binary search, and
   sets reaching T occurrences are retained.  Lists are dealt in blocks, so a
   query's lists stay bounded.
6. Candidates are verified on the whole sets; all links give the components.

Sets are compared by 64-bit hashes of their shingles, and equal sets are found
by 128 bits and the size.  Defined cases: null texts, and texts without words,
have an empty set and link with nothing; with fewer words the whole sequence is
the one shingle; a row with a null id gets the component of the documents with
its very set, else null, and links nothing by itself; rows that repeat an id are
judged each by its own text, and links reach no further than texts do; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import KEY, keyed, one_of_each, without
from .scratch import lean, materialize, release, small_batches
from .skew import join_totals
from .text import SPACE, Rolling, find_words, mix, signed, text_slices, window_starts

SHINGLE = 5
PERCENT = 80
SKETCH_ROWS, SKETCH_BITS = 2, 21
SLOT_BITS = 15
EXTEND = 100
HOT = 64
#: Pivots of a hot list in each round of collapsing.
PIVOTS = (32,)
#: More entries than this are merged by one sort, which gives the same counts.
HEAP_ENTRIES = 2_048
BLOCK = 4096
#: Least sizes of the bands: about 3 % wide.
EDGES = [1]
while EDGES[-1] < 1 << 31:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 103 // 100))
BROADCAST_ROWS = 500_000  # of one or two numbers each


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the shingles of each text, repeats included."""
    words = find_words(data, offsets, SPACE, lower=True)
    rolling = Rolling(words.prefix_hash())
    text, place = window_starts(words.first, k)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    return np.concatenate([text, short]), np.concatenate([rolling.at(place, k), rolling.at(words.first[short], count[short])])


def _distinct(text: np.ndarray, hashes: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, text) if rank is None else (hashes, rank, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _buckets(hashes: np.ndarray) -> list[np.ndarray]:
    """The place of each hash in each row of the sketch."""
    size = 1 << SKETCH_BITS
    return [((hashes * np.uint64(2 * r + 1) if r == 0 else mix(hashes + np.uint64(r))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + r * size for r in range(SKETCH_ROWS)]


def rarity(levels: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The least of a hash's counters."""
    found = [levels[at] for at in _buckets(hashes)]
    return np.minimum.reduce(found)


def frequency_sketch(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """How many sets hold a shingle of each bucket, in eighths of a power of two
    (a byte each, as only the order of shingles matters)."""
    width, size = 1 << SLOT_BITS, SKETCH_ROWS << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                hashes = _distinct(*shingle_sets(data, offsets, k))[1]
                for buckets in _buckets(hashes):
                    at, n = np.unique(buckets, return_counts=True)
                    table[at] += n.astype(np.uint32)
        for i in range(size // width):
            part = table[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1)], pa.binary())], names=["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(packed.as_py()), dtype="<u4").astype(np.int64)
                total[slot] = total[slot] + part if slot in total else part
        for slot, part in total.items():
            levels = np.minimum(8 * np.log2(1.0 + part), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())], names=["slot", "counts"])

    parts = docs.select("text").mapInArrow(lean(count), "slot int, counts binary").repartition(size // width, "slot").mapInArrow(lean(add), "slot int, counts binary")
    out = np.zeros(size, dtype=np.uint8)
    for row in parts.collect():  # fixed size: one row a slot
        out[row["slot"] * width : (row["slot"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint8)
    return out


def shared_at_least(n, m, percent: int = PERCENT):
    """How many shingles linked sets of n and m have in common at least."""
    return -(-percent * (n + m) // (100 + percent))


def extension(n):
    return 2 + n // EXTEND


def listed_prefix(n, percent: int = PERCENT):
    """How many first shingles list a set of n."""
    return np.minimum(n, n - shared_at_least(n, n, percent) + extension(n))


def asking_prefix(m, low, percent: int = PERCENT):
    """With how many first shingles a set of m asks for sets of ``low`` or more
    (a band's least size; smaller than the least linked size counts as that)."""
    low = np.maximum(low, -(-percent * m // 100))
    return np.minimum(m, m - shared_at_least(low, m, percent) + extension(m))


def band(n):
    return np.searchsorted(EDGES, n, side="right") - 1


def occurrences(n, m, percent: int = PERCENT):
    """How many shingles the listed prefix of a set of n and the asking prefix
    of one of m >= n share at least, if they link.

    Shared shingles beyond the prefix that ends first are at most that set's rest.
    """
    rest = np.maximum(n - listed_prefix(n, percent), m - asking_prefix(m, np.asarray(EDGES)[band(n)], percent))
    return np.maximum(shared_at_least(n, m, percent) - rest, 1)


def sketches(docs: DataFrame, levels: np.ndarray, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Per document: set size, two halves of the set's digest, the bands of its
    own and of the least linked size, its longest prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                text, hashes = shingle_sets(data, offsets, k)
                text, hashes = _distinct(text, hashes, rarity(shared.value, hashes))
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                n = np.diff(first)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix(hashes), mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
                halves = [s[first[1:]] - s[first[:-1]] for s in sums]
                least = -(-percent * n // 100)
                size = np.where(n > 0, asking_prefix(n, least, percent), 0)
                inside = np.arange(len(text)) - first[text] < size[text]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(signed(hashes[inside])))
                bands = [pa.array(band(np.maximum(x, 1)).astype(np.int32)) for x in (n, least)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(signed(h)) for h in halves), *bands, lists], names=["doc_id", "n", "a", "b", "band", "low", "prefix"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, a long, b long, band int, low int, prefix array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                text, hashes = _distinct(*shingle_sets(data, offsets, k))
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(hashes)))], names=["id", "set"])

    return docs.mapInArrow(lean(run), "id long, set array<long>")


def _few(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (u, v) that link, by their whole sets; only sets that some pair
    needs are made and moved."""
    ids = materialize(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "members")
    sets = materialize(_sets(docs.join(_few(ids), "doc_id", "left_semi"), k), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (z.values.to_numpy(zero_copy_only=False).view(np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("set").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(lean(run), "u long, v long")


def _heap_merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct members of sorted lists and how many lists hold each."""
    heap = [(int(x[0]), i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    members: list[int] = []
    counts: list[int] = []
    while heap:
        value, i, at = heap[0]
        if members and members[-1] == value:
            counts[-1] += 1
        else:
            members.append(value)
            counts.append(1)
        if at + 1 < len(lists[i]):
            heapq.heapreplace(heap, (int(lists[i][at + 1]), i, at + 1))
        else:
            heapq.heappop(heap)
    return np.array(members, dtype=np.int64), np.array(counts, dtype=np.int64)


def _merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As the heap does; many entries are merged by one vectorised sort."""
    if sum(map(len, lists)) <= HEAP_ENTRIES:
        return _heap_merge(lists)
    return np.unique(np.concatenate(lists), return_counts=True)


def divide_skip(lists: list[np.ndarray], need: int, needs=None, long_lists: int | None = None) -> np.ndarray:
    """Members of at least ``need`` of the sorted lists (of ``needs(members)``
    if given, which is never less).

    The ``long_lists`` longest (at most need - 1) are only probed by binary
    search; the others are merged, and a member is probed for while it can still
    reach its number.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need or need < 1:
        return np.zeros(0, np.int64)
    many = int(need / (0.01 * np.log2(len(lists[-1]) + 2) + 1)) if long_lists is None else long_lists
    many = max(0, min(many, need - 1))
    members, counts = _merge(lists[: len(lists) - many])
    wanted = np.full(len(members), need) if needs is None else needs(members)
    for left in range(many, 0, -1):
        able = counts + left >= wanted
        members, counts, wanted = members[able], counts[able], wanted[able]
        x = lists[-left]
        at = np.minimum(np.searchsorted(x, members), len(x) - 1)
        counts = counts + (x[at] == members)
    return members[counts >= wanted]


def _search(asked: DataFrame, percent: int) -> DataFrame:
    """Candidates of each query row: id, n, lists of (ids, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            outer = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            lists = batch.column(2).flatten()
            inner = np.concatenate([[0], np.cumsum(lists.field("ids").value_lengths().to_numpy())])
            ids, sizes = (lists.field(c).flatten().to_numpy() for c in ("ids", "sizes"))
            for r, (u, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                cuts = inner[outer[r] : outer[r + 1] + 1]
                mine, size = ids[cuts[0] : cuts[-1]], sizes[cuts[0] : cuts[-1]]
                fits = (100 * size >= percent * n) & ((size < n) | (size == n) & (mine < u))
                ends = np.concatenate([[0], np.cumsum(fits)])[cuts - cuts[0]]
                mine, size = mine[fits], size[fits]
                if not len(mine):
                    continue
                order = np.argsort(mine, kind="stable")
                sorted_ids, sorted_sizes = mine[order], size[order]
                needs = lambda m: occurrences(sorted_sizes[np.searchsorted(sorted_ids, m)], n, percent)  # noqa: B023, E731
                got = divide_skip([mine[a:b] for a, b in zip(ends, ends[1:])], int(occurrences(size, n, percent).min()), needs)
                us += [u] * len(got)
                vs += got.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return asked.mapInArrow(lean(run), "u long, v long")


_POST = ["token", "id", "n", "pos", "band", "low"]


def _placed(active: DataFrame, known: DataFrame | None) -> DataFrame:
    """The lists' entries with their components so far."""
    if known is None:
        return active.select(*_POST, F.col("id").alias("component"))
    known = materialize(known.select(F.col("node").alias("id"), "component"), "collapsed")
    return active.select(*_POST).join(known, "id", "left").select(*_POST, F.coalesce("component", "id").alias("component"))


def _rays(placed: DataFrame, pivots: int, number: int, percent: int) -> DataFrame:
    """Pairs of pivots and listed entries of tokens that hold over ``HOT`` components.

    A list gets a pivot for each hash slot, and each set asks the pivots of one
    of its hot lists, another one each round.
    """
    hot = placed.groupBy("token").agg(F.count_distinct("component").alias("k")).where(F.col("k") > HOT)
    rows = placed.join(hot, "token")
    slot, order = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(pivots)), F.xxhash64("id", F.lit(number + 100))
    chosen = rows.groupBy("token", slot.alias("slot")).agg(F.min(F.struct(order.alias("h"), "id", "n", "component")).alias("p")).select("token", F.col("p.id").alias("pivot"), F.col("p.n").alias("m"), F.col("p.component").alias("other"))
    best = F.max(F.struct("k" if number == 0 else F.xxhash64("token", F.lit(number)).alias("h"), "token"))
    asks = rows.groupBy("id", "n", "component").agg(best.alias("b")).select("id", "n", "component", F.col("b.token").alias("token"))
    met = asks.join(chosen, "token").where(f"component <> other and 100 * least(n, m) >= {percent} * greatest(n, m)")
    return materialize(met.select(F.greatest("id", "pivot").alias("u"), F.least("id", "pivot").alias("v")).distinct(), "stars")


def _asks(left: DataFrame, percent: int) -> DataFrame:
    """Each entry once for each band of sizes that its place lets it ask."""
    edges = F.lit(EDGES[:-1])
    m, place = F.col("n"), F.col("pos")

    def may(b):
        low = F.greatest(F.element_at(edges, b + 1), F.expr(f"({percent} * n + 99) div 100"))
        return F.call_function("div", percent * (low + m) + (99 + percent), F.lit(100 + percent)) < m + F.expr(f"2 + n div {EXTEND}") - place

    return left.select("token", "id", "n", "component", F.explode(F.filter(F.sequence("low", "band"), may)).alias("band"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: n_shingles and component_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(sketches(docs, frequency_sketch(docs, k), percent, k), "sketches")
    digest = ["a", "b", "n"]
    classes = materialize(sketch.where("n > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("id"), F.first(F.struct("band", "low", "prefix")).alias("s")).select(*digest, "id", "s.*"), "classes")
    posts = classes.select("id", "n", "band", "low", F.posexplode("prefix").alias("pos", "token"))
    listed = F.expr(f"pos < n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 2 + n div {EXTEND}")
    lists = materialize(posts.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.bool_or(listed).alias("listed")).where("size > 1 and listed").select("token", "size"), "lists")
    active = materialize(join_totals(posts, lists, ["token"], "size"), "active")
    release(lists)

    linked = docs.sparkSession.createDataFrame([], "u long, v long")
    placed = _placed(active, None)
    for number, pivots in enumerate(PIVOTS):
        rays = _rays(placed.where(listed), pivots, number, percent)
        if rays.isEmpty():
            break
        linked = materialize(linked.unionByName(_verified(rays, docs, percent, k)), "star-links")
        placed = _placed(active, components(linked))
    mixed = materialize(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("token", "size"), "mixed-lists")
    left = materialize(join_totals(placed, mixed, ["token"], "size"), "mixed")
    release(active, mixed)
    blocks = max(1, -(-(left.agg(F.max("size")).first()[0] or 0) // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    entries = F.sort_array(F.collect_list(F.struct("id", "n")))
    indexed = left.where(listed).groupBy("token", "band", F.col("component").alias("other"), block.alias("block")).agg(entries.alias("entries"))
    met = _asks(left, percent).join(indexed, ["token", "band"]).where("component <> other").select("id", "n", "block", F.struct(F.col("entries.id").alias("ids"), F.col("entries.n").alias("sizes")).alias("list"))
    asked = met.groupBy("id", "n", "block").agg(F.collect_list("list").alias("lists")).select("id", "n", "lists")
    candidates = materialize(_search(asked, percent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")
    release(left)
    links = linked.unionByName(_verified(candidates, docs, percent, k))

    reached = components(links).select(F.col("node").alias("id"), F.col("component"))
    named = classes.select(*digest, "id").join(reached, "id", "left").select(*digest, F.coalesce("component", "id").alias("component"))
    out = sketch.select("doc_id", *digest).join(named, digest, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The rows whose id is the smallest of their component; of rows with one
    id one stays, and one without an id only where no other has one."""
    docs = keyed(docs)
    groups = near_duplicates(docs, percent, k, id_col=KEY).select(F.col("doc_id").alias(KEY), F.col("component_id").alias("group"))
    return without(docs, one_of_each(docs, groups, "doc_id", largest=False))
