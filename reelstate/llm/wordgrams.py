"""Words and n-grams of Arrow text batches as numpy arrays.

A batch is walked in pieces of about ``PIECE`` bytes, so that the arrays stay small whatever the
batch holds; a document is never cut. Hashes are 64 bits wide and depend on the words alone.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _word_table(separators: bytes) -> np.ndarray:
    found = np.ones(256, dtype=bool)
    found[np.frombuffer(separators, dtype=np.uint8)] = False
    return found


#: Bytes of words that white space parts.
SPACED = _word_table(SPACES)
#: Bytes of words of lower-cased text: digits, letters, and all beyond ASCII.
PLAIN = _word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                           *range(0x7B, 0x80)]))
#: Words as in ``PLAIN``, and runs of ASCII punctuation as words of a kind of their own.
MARKED = PLAIN.astype(np.uint8)
MARKED[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
LOWERED = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: For ``bytes.translate``: what is no word becomes a blank, A to Z become a to z.
PLAIN_TABLE = bytes(LOWERED[i] if PLAIN[i] else 0x20 for i in range(256))


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of the documents ``first`` to ``last - 1`` of a batch.

    ``offsets`` has for each document the place of its first word, and the count at its end.
    ``starts`` and ``ends`` are byte places in ``data``, ``hashes`` the words' hashes.
    """

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def document(self, places: np.ndarray) -> np.ndarray:
        """The document, from 0 within the piece, of each word place."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all runs of ``n`` words that lie in one document."""
        if len(self.hashes) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        total = gram_hashes(self.hashes, n)
        inside = np.ones(len(self.hashes) + 1, dtype=bool)
        for back in range(1, n):
            cut = self.offsets[1:] - back
            inside[cut[cut >= 0]] = False
        places = np.flatnonzero(inside[: len(total)])
        return places, total[places]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, whatever document they lie in."""
    size = len(hashes) - n + 1
    total = np.zeros(size, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            total += hashes[j : j + size] * factor
            factor = factor * STEP
        return mix(total)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(texts: pa.Array, table: np.ndarray = SPACED, lower: bool = False,
          size: int = PIECE) -> Iterator[Words]:
    """The words of a text column, piece by piece, in the order of its rows.

    ``table`` has the kind of each byte: 0 parts words, and so does a change of the kind.
    """
    data, offsets = buffers(texts)
    for first, last in pieces(offsets, size):
        yield _words(data, offsets, first, last, table, lower)


def _words(data, offsets, first, last, table, lower) -> Words:
    low = offsets[first]
    data, bounds = data[low : offsets[last]], offsets[first : last + 1] - low
    if lower:
        data = LOWERED[data]
    kind = table[data]
    inside = kind != 0
    new = np.ones(len(data) + 1, dtype=bool)  # whether a run of one kind starts at this byte
    new[1:-1] = kind[1:] != kind[:-1]
    new[bounds] = True
    starts = np.flatnonzero(inside & new[:-1])
    ends = np.flatnonzero(inside & new[1:]) + 1
    lengths = ends - starts
    if len(starts):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(lengths.max()), BASE, dtype=np.uint64))
            heads = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
            values = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
            hashes = mix(np.add.reduceat(values, heads) ^ lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(first, last, data, starts, ends, np.searchsorted(starts, bounds), hashes)
