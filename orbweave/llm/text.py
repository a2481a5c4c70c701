"""Words and rolling hashes of Arrow text columns, vectorised with numpy.

Texts are handled as UTF-8 bytes.  All word separators of this subpackage are
ASCII, so a byte class decides them and no text is decoded.  Hashes are
polynomials modulo 2**64 over the bytes of a word, then over the words of a
window (Rabin-Karp: differences of prefix sums), finished by a bit mixer; a
second word hash is a polynomial modulo a prime.
Work is done in slices of about ``SLICE`` bytes, so memory follows the longest
single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_PRIME = 2_147_483_647
_PRIME_BASE = 1_000_003
_BYTE_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_WORD_BASE = 0xD1342543DE82EF95


def _byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
PUNCT = _byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * SLICE:  # a table for one huge text is not kept
            _tables[base] = have
    return have


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``powers``, modulo a prime (by doubling, as products must be reduced)."""
    have = _tables.get(_PRIME)
    if have is None or len(have[0]) < n:
        p, size, out = np.uint64(_PRIME), max(n, 1 << 16), []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)):
            table = np.ones(1, dtype=np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), _PRIME)) % p])
            out.append(table[:size])
        have = out[0], out[1]
        if size <= 4 * SLICE:
            _tables[_PRIME] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for slices of a column.

    A slice has at least one row and otherwise at most ``limit`` bytes; nulls
    count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of some texts: byte ranges, hashes, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of text i: words first[i] up to first[i + 1]
    sums: np.ndarray  # prefix sums of byte * base**i, with a leading 0

    def __len__(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefix_hash(self, length: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, or of their first ``length`` bytes."""
        end = self.end if length is None else self.start + length
        inverse = powers(_BYTE_BASE, len(self.sums))[1]
        h = (self.sums[end] - self.sums[self.start]) * inverse[self.start]
        return mix(h + (end - self.start).astype(np.uint64))

    def second_hash(self, first: np.ndarray) -> np.ndarray:
        """Other hashes of the words, given the first ones."""
        p, n = np.uint64(_PRIME), len(self.data)
        up, down = prime_powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        for at in range(0, n, 1 << 24):  # sums of so many terms below 2**31 fit
            end = min(n, at + (1 << 24))
            sums[at + 1 : end + 1] = (np.cumsum((self.data[at:end].astype(np.uint64) + np.uint64(1)) * up[at:end] % p) + sums[at]) % p
        h = (sums[self.end] + p - sums[self.start]) % p * down[self.start] % p
        return mix(h << np.uint64(33) ^ mix(first ^ np.uint64(0xA0761D6478BD642F)) ^ h)

    def slice_bytes(self, i: int, j: int) -> bytes:
        """Words i up to j, joined by one space."""
        d, s, e = self.data, self.start, self.end
        return b" ".join(d[s[k] : e[k]].tobytes() for k in range(i, j))


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool) -> Words:
    """Words of texts that lie one after another in ``data``."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    sums = np.zeros(n + 1, dtype=np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(_BYTE_BASE, n + 1)[0][:n]
    np.cumsum(terms, out=sums[1:])
    return Words(data, start, end, first, sums)


class Rolling:
    """Hashes of windows of consecutive words (given their hashes)."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.up, self.down = powers(_WORD_BASE, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(h + np.asarray(length).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows of ``length`` words inside one text."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return text, np.arange(len(text)) - begin[text] + first[text]


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)


def take(column: pa.Array, index: np.ndarray) -> pa.Array:
    """Rows of an id column; nulls stay null."""
    return column.take(pa.array(index))
