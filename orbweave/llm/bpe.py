"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding.  A sequence of tokens is the encoding of its bytes exactly when every
neighbouring pair is: when encoding the two tokens' bytes gives the two tokens
back.  So each prefix of a piece has one valid last token, found from the valid
last tokens of the prefixes at most one token's length before it.

Lookahead.  Take the encodings of u and of uv.  Both apply the merges by rank;
left of the *front*, at first the end of u, they agree at all times.  The front
moves only when one of them applies a merge (x, y) whose y begins at the front:
then it moves back by x.  At that time x is a whole token in both, so the next
such merge (x', y') has a later rank and a y' that was built from x at its left
edge (a merge of equal rank further left was made before, in both).  Hence the
front moves back by at most the heaviest chain of such merges, each weighing its
x, which ``sufficient_lookahead`` computes from the merge list alone.  The
transducer emits every token that ends so many bytes before what it has read,
and keeps only the bytes after; its memory is constant in the length of a text.
Texts are fed to it in chunks, pieces longer than a chunk too.

Decoding.  Each id appends its bytes to an incremental byte-to-text state
machine, which holds at most one unfinished character; malformed bytes become
U+FFFD.

Pieces come from the vocabulary's pattern, and special tokens are cut out of
the text first, as the public library does.  Pieces repeat, so results of short
ones are kept in a table of bounded size.

Defined cases: null counts as empty and has no tokens; rows may repeat; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import lean, small_batches

#: The split pattern of the byte-level vocabularies (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
#: Texts of printable ASCII, plain white space and Latin letters, and the same
#: pattern for them in the standard library's faster engine.
_LATIN = re.compile(rf"[\t-\r -~{_LETTERS}]*")
_LATIN_PATTERN = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_SPACE_PAIRS = [a + " " for a in "\t\n\v\f\r "]
CACHE_PIECES = 300_000
CACHE_PAIRS = 400_000
CACHED_LENGTH = 64
#: Characters of a text, and bytes of a piece, taken at a time.
CHUNK = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks, special tokens."""

    def __init__(self, config: dict):
        model, alphabet = config["model"], byte_alphabet()
        unmap = lambda s: bytes(alphabet[c] for c in s)
        self.special = {a["content"]: a["id"] for a in config.get("added_tokens", [])}
        ids = {unmap(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.ids = ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (unmap(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.longest = max(map(len, ids))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge_all(self, data: bytes) -> list[int]:
        """The definition: apply the merge of lowest rank, leftmost first."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """Bytes by which later text can move the boundaries of a prefix at most.

    A chain is a sequence of merges of ascending rank in which the left part of
    each is at the left edge, while it is built, of the right part of the next.
    """
    length = {i: len(b) for i, b in vocab.bytes.items()}
    left_of: dict[int, int] = {}
    for (left, _), (_, token) in sorted(vocab.merges.items(), key=lambda kv: kv[1][0]):
        left_of.setdefault(token, left)
    heaviest_after: dict[int, int] = {}  # by token at a left edge: of the chains that may follow
    most = 0
    for (left, right), _ in sorted(vocab.merges.items(), key=lambda kv: -kv[1][0]):
        weight = length[left] + heaviest_after.get(left, 0)
        most = max(most, weight)
        token: int | None = right
        while token is not None:
            heaviest_after[token] = max(heaviest_after.get(token, 0), weight)
            token = left_of.get(token)
    return most


class _Recent(dict):
    """Results by string: two generations of bounded size, so that frequent
    keys stay; long keys are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Transducer:
    def __init__(self, vocab: Vocabulary, cache: int = CACHE_PIECES):
        self.vocab, self.ids, self.longest = vocab, vocab.ids, vocab.longest
        self.lookahead = sufficient_lookahead(vocab)
        self._pairs: dict[int, bool] = {}  # by both ids, 32 bits each
        self._edges: tuple[dict, dict] = {}, {}
        self._no_rank = len(vocab.merges)
        self._parts: dict[int, tuple[int, tuple[int, int]]] = {}
        for pair, (rank, token) in sorted(vocab.merges.items(), key=lambda kv: kv[1][0]):
            self._parts.setdefault(token, (rank, pair))
        self._pieces, self._segments = _Recent(self._piece, cache), _Recent(self._spaced, cache)
        self._pattern = regex.compile(PATTERN)
        self._special_pattern = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) or r"(?!)")
        self._starts: dict[bytes, int] = {}  # 3-byte heads -> longest token with that head
        self.ids = self._proper_tokens()
        for token in self.ids:
            head = token[:3]
            self._starts[head] = max(self._starts.get(head, 0), len(token))

    def _edge(self, token: int, right: bool, keep: bool = True) -> list[tuple[int, int]]:
        """The tokens at one end of ``token`` while it is built, from the byte
        up, each with the rank of the merge that takes it in (none: no limit)."""
        edges = self._edges[right]
        found = edges.get(token)
        if found is None:
            found, limit = [], self._no_rank
            while True:
                found.append((token, limit))
                if token not in self._parts:
                    break
                limit, pair = self._parts[token]
                token = pair[right]
            found.reverse()
            if keep:
                edges[found[-1][0]] = found
        return found

    def _first_merge(self, left: int, right: int, keep: bool = True) -> tuple[int, int] | None:
        """The first merge over the seam when both tokens are built at once.

        At each time the tokens that meet at the seam merge unless one of them is
        taken in by its own side before; of equal ranks the leftmost comes first.
        """
        a, b, i, j = self._edge(left, True, keep), self._edge(right, False, keep), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            merge = self.vocab.merges.get((x, y))
            if merge is not None and merge[0] < x_ends and merge[0] <= y_ends:
                return x, y
            if x_ends == y_ends == self._no_rank:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _proper_tokens(self) -> dict[bytes, int]:
        """Tokens that the encoding of their own bytes gives; no others occur."""
        proper = {i for i in self.ids.values() if i not in self._parts}
        for token, (_, pair) in self._parts.items():  # in order of rank
            if pair[0] in proper and pair[1] in proper and self._first_merge(*pair, keep=False) == pair:
                proper.add(token)
        return {b: i for b, i in self.ids.items() if i in proper and (len(b) == 1 or i in self._parts)}

    def stable_pair(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        known = self._pairs.get(left << 32 | right)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[left << 32 | right] = self._first_merge(left, right) is None
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece, each emitted as soon as it cannot change.

        Goes forward by the longest token that fits its left neighbour and steps
        back where none does.  A place that failed once fails always, as the
        valid last token before it is unique.
        """
        ids, starts, pairs, stable, longest = self.ids, self._starts, self._pairs, self.stable_pair, self.longest
        data, final, chunks = b"", False, iter(chunks)
        out: list[int] = []  # tokens from the start of ``data`` up to ``at``
        begins: list[int] = []
        failed: set[int] = set()
        at, left, before = 0, -1, -1
        while not final:
            chunk = next(chunks, None)
            final = chunk is None
            data = data + chunk if chunk else data
            n = len(data)
            stop = n if final else n - longest + 1  # all tokens that begin before lie within the data
            size = min(starts.get(data[at : at + 3], 2), n - at)
            while at < stop:
                while size:
                    token = ids.get(data[at : at + size])
                    if token is not None and at + size not in failed:
                        fits = left < 0 or pairs.get(left << 32 | token)
                        if fits or fits is None and stable(left, token):
                            break
                    size -= 1
                if size:
                    out.append(token)
                    begins.append(at)
                    left = token
                    at += size
                    size = min(starts.get(data[at : at + 3], 2), n - at)
                else:
                    failed.add(at)
                    end, at = at, begins.pop()
                    out.pop()
                    left, size = out[-1] if out else before, end - at - 1
            if final:
                yield out
                return
            keep = bisect_right(begins, at - self.lookahead) - 1  # tokens before end so long ago
            if keep > 0:
                yield out[:keep]
                before = out[keep - 1]
                shift = begins[keep]
                data, at, failed = data[shift:], at - shift, {f - shift for f in failed if f > shift}
                out, begins = out[keep:], [b - shift for b in begins[keep:]]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        chunks = (data,) if len(data) <= CHUNK else (data[k : k + CHUNK] for k in range(0, len(data), CHUNK))
        return b"".join(array("I", tokens).tobytes() for tokens in self.stream(chunks))

    def _spaced(self, segment: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._pattern_for(segment).findall(" " + segment)))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, chunk by chunk."""
        at = 0
        if any(s in text for s in self.vocab.special):
            for m in self._special_pattern.finditer(text):
                yield from self._ordinary(text[at : m.start()])
                yield array("I", [self.vocab.special[m[0]]]).tobytes()
                at = m.end()
        yield from self._ordinary(text[at:] if at else text)

    def _pattern_for(self, text: str):
        return _LATIN_PATTERN if _LATIN.fullmatch(text) else self._pattern

    def _ordinary(self, text: str) -> Iterator[bytes]:
        if any(map(text.__contains__, _SPACE_PAIRS)) or not _LATIN.fullmatch(text):
            pieces = (m[0] for m in self._pattern_for(text).finditer(text))
            while some := b"".join(map(self._pieces.__getitem__, islice(pieces, CHUNK))):
                yield some
            return
        # No white space before a space: each space starts a piece, whatever stands before it.
        at, n = 0, len(text)
        while at < n:
            end = n if at + CHUNK >= n else text.find(" ", at + CHUNK)
            end = n if end < 0 else end
            first, *rest = text[at:end].split(" ")
            yield b"".join(map(self._pieces.__getitem__, _LATIN_PATTERN.findall(first))) + b"".join(map(self._segments.__getitem__, rest))
            at = end


class Decoder:
    """Ids to text, piece by piece; holds one unfinished character at most."""

    def __init__(self, vocab: Vocabulary):
        size = max(vocab.bytes, default=-1) + 1
        self._bytes = [vocab.bytes.get(i, b"") for i in range(size)]
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int], final: bool = False) -> str:
        table = self._bytes
        return self._state.decode(b"".join(map(table.__getitem__, ids)), final)

    def decode(self, chunks: Iterable[bytes]) -> Iterator[str]:
        for packed in chunks:
            yield self.push(np.frombuffer(packed, dtype="<u4").tolist())
        yield self.push([], final=True)
        self._state.reset()


def _machines(config: bytes) -> tuple[Transducer, Decoder]:
    """For one partition; a worker that is used again keeps none of it."""
    vocab = Vocabulary(json.loads(config))
    return Transducer(vocab), Decoder(vocab)


def encode_decode(docs: DataFrame, vocabulary: str | bytes, text_col: str = "text", id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """Per document: n_tokens, hashes of ids and of the decoded text.

    ``vocabulary`` is a tokenizer file on the driver, or its content; a few MB
    of fixed size go to the executors as a broadcast.  ``keep`` adds the ids
    and the decoded text.
    """
    spark: SparkSession = docs.sparkSession
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
        ddl += ", ids array<long>, decoded string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, decoder = _machines(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for text in part.column(1):
                    ids, seen, n, packed, pieces = hashlib.sha256(), hashlib.sha256(), 0, [], []

                    def tokens(text: str = text.as_py() or "") -> Iterator[bytes]:
                        nonlocal n
                        for chunk in transducer.encode(text):
                            ids.update(chunk)  # noqa: B023
                            n += len(chunk) // 4
                            if keep:
                                packed.append(chunk)  # noqa: B023
                            yield chunk

                    for piece in decoder.decode(tokens()):
                        seen.update(piece.encode())
                        if keep:
                            pieces.append(piece)
                    rows.append((n, ids.hexdigest(), seen.hexdigest(), *((np.frombuffer(b"".join(packed), "<u4").astype(np.int64), "".join(pieces)) if keep else ())))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), ddl)
