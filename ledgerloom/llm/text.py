"""Words, rolling hashes and n-grams of Arrow text columns, as numpy arrays.

Everything works on the UTF-8 bytes of many texts at once.  Texts are taken in
slices of bounded size, so memory does not depend on the size of a batch; one
text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: A random value for each byte.
BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, _U)
        filled = 1
        while filled < size:
            step = _U(pow(base, filled, 1 << 64))
            have[filled : 2 * filled] = have[:filled] * step
            filled *= 2
        _powers[base] = have
    return have[:n]


class Alphabet:
    """Which bytes make words, and what A-Z fold to."""

    def __init__(self, separators: bytes) -> None:
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32


#: Words are runs of anything but blanks.
BLANKS = Alphabet(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and all that is not ASCII.
ALNUM = Alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
    """Hashes of all words, their byte spans, and the word offsets of each text."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, _U), empty, empty, np.zeros(len(offsets), np.int64)
    inside = alphabet.is_word[data]
    # A text border ends a word: no word starts before it and goes on behind it.
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = word_hashes(alphabet.fold[data], starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


#: Masks of the first 0 to 8 bytes of a little-endian block.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
#: Words of more bytes are hashed one by one; there are few of them in any text.
_LONG_WORD = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, eight at a time through a mix that is not linear."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # one at every byte
    length = ends - starts
    hashes = mix(length.astype(_U) ^ _U(_BASE))
    rest = np.flatnonzero(length <= _LONG_WORD)
    for done in range(0, _LONG_WORD, 8):
        rest = rest[length[rest] > done]
        if not len(rest):
            break
        block = blocks[starts[rest] + done] & _FIRST_BYTES[np.minimum(length[rest] - done, 8)]
        hashes[rest] = mix(hashes[rest] ^ mix(block + _U(_BASE)))
    for i in np.flatnonzero(length > _LONG_WORD):
        digest = blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        hashes[i] ^= _U(int.from_bytes(digest, "little"))
    return hashes


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values of each span, wherever it lies: a polynomial modulo 2**64."""
    n = len(values)
    running = np.zeros(n + 1, _U)
    np.cumsum(values * powers(n), out=running[1:])
    hashes = (running[ends] - running[starts]) * powers(n + 1, _BASE_INVERSE)[starts]
    return mix(hashes ^ ((ends - starts).astype(_U) << _U(40)))


def run_hashes(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that begin at each position in ``first``."""
    out = np.full(len(first), (length * 0xA0761D6478BD642F) % (1 << 64), _U)
    for k in range(length):
        out = (out ^ hashes[first + k]) * _U(_BASE) + _U(k + 1)
        out ^= out >> _U(29)
    return mix(out)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each text, and their offsets.

    A text of fewer words, but not none, has one run of all its words.
    """
    count = np.diff(offsets)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_offsets = np.concatenate([[0], np.cumsum(grams)])
    owner = np.repeat(np.arange(len(count)), grams)
    first = np.arange(out_offsets[-1]) - out_offsets[owner] + offsets[owner]
    out = np.zeros(len(first), _U)
    full = count[owner] >= n
    out[full] = run_hashes(hashes, first[full], n)
    for length in range(1, n):
        short = count[owner] == length
        if short.any():
            out[short] = run_hashes(hashes, first[short], length)
    return out, out_offsets


def sorted_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    kept = owner[keep]
    return values[keep], np.searchsorted(kept, np.arange(len(offsets)))
