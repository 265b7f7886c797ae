"""Hashes of all words of an Arrow column of texts, without a Python object per word.

Bytes are mapped to random 64-bit numbers (A-Z like a-z) and weighted with powers of an odd number;
one running sum then gives the polynomial hash of any byte range, and a final mix spreads its bits. 64-bit hashes stand for words
and n-grams throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tracelab.llm.store import slices

SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
#: The six ASCII white-space characters separate words.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WORDS = (~_SPACE).astype(np.uint8)
#: Letters, digits, underscore and bytes of other alphabets make words; runs of other characters are tokens too.
_ALNUM = np.array([chr(i).isalnum() and i < 128 or i == 95 or i > 127 for i in range(256)])
_TOKENS = np.where(_SPACE, 0, np.where(_ALNUM, 1, 2)).astype(np.uint8)

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        inverse = pow(BASE, -1, 2**64)
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (BASE, inverse)
        ]
    return _powers[0][:n], _powers[1]


def hashed_words(texts: pa.Array, tokens: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, starts, ends): words of text i are hashes[offsets[i]:offsets[i + 1]].

    ``starts`` and ``ends`` are byte positions in the joined texts. Words are runs of characters other
    than ASCII white space; with ``tokens``, runs of word characters and runs of punctuation. Nulls are empty.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends_of_texts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends_of_texts[0] : ends_of_texts[-1]]
    bounds = ends_of_texts - ends_of_texts[0]
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), none, none
    kind = (_TOKENS if tokens else _WORDS)[data]
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[bounds[:-1][bounds[:-1] < n]] = True
    at = np.flatnonzero(change)
    words = kind[at] != 0
    starts, ends = at[words], np.append(at[1:], n)[words]
    power, inverse = power_tables(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * power, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, bounds).astype(np.int64), starts, ends


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of all runs of k words inside each text; a shorter text is one run as a whole."""
    n = len(hashes)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):  # position in the run changes the weight, so order counts
        weight = np.uint64(pow(BASE, 2 * j + 3, 2**64))
        total[: max(0, n - j)] += hashes[j:] * weight
    counts = np.diff(offsets)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    keep = np.zeros(n + 1, dtype=np.int64)
    np.add.at(keep, offsets[:-1][made > 0], 1)
    np.add.at(keep, (offsets[:-1] + made)[made > 0], -1)
    out = mix(total)
    weights = np.array([pow(BASE, 2 * j + 3, 2**64) for j in range(k)], dtype=np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[offsets[i] : offsets[i + 1]] * weights[: counts[i]]
        out[offsets[i]] = mix(own.sum(keepdims=True) + np.uint64(counts[i]))[0]
    return out[np.cumsum(keep[:-1]) > 0], np.concatenate([[0], np.cumsum(made)])


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about 256 KB of text, or one longer text."""
    return slices(batches, "text", SLICE)
