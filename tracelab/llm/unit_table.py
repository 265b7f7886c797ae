"""A table from byte strings to small arrays, looked up for a whole column of texts at a time.

Tokenizers treat the units of a text (words, mostly) one by one, and most of them come again and again. Units are byte ranges of the
joined texts; running sums give their hashes, an open-addressing index their entries, and the bytes are compared, so that no answer
rests on a hash alone. No Python object is made per unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tracelab.llm.word_hash import mix, power_tables

_BYTES = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64)

#: Fills payloads for new units: (joined bytes, starts, ends, flags) to (values, number of values of each).
Learn = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = power_tables(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class HashIndex:
    """Numbers 0, 1, ... by 64-bit hashes, with double hashing; half of the slots at least are free."""

    def __init__(self) -> None:
        self.hashes = np.zeros(1 << 10, dtype=np.uint64)
        self.count = 0
        self._slots(11)

    def _slots(self, bits: int) -> None:
        self.shift, self.slots, self.held = np.uint64(64 - bits), np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=np.uint64)
        self._place(np.arange(self.count, dtype=np.int32))

    def _place(self, pending: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.hashes[pending] >> self.shift).astype(np.int64)
        while len(pending):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = pending[free]
            won = self.slots[slot] == pending
            self.held[slot[won]] = self.hashes[pending[won]]
            pending, slot = pending[~won], slot[~won]
            slot = (slot + self._steps(self.hashes[pending])) & mask

    @staticmethod
    def _steps(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(0xFFFFFF) | np.uint64(1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        hashes = np.maximum(hashes, np.uint64(1))  # 0 marks a free slot
        slot, mask = (hashes >> self.shift).astype(np.int64), len(self.slots) - 1
        held = self.held[slot]
        same = held == hashes
        out = np.where(same, self.slots[slot], -1).astype(np.int64)
        rest = np.flatnonzero(~same & (held != 0))
        hashes, slot = hashes[rest], slot[rest]
        while len(rest):
            slot = (slot + self._steps(hashes)) & mask
            held = self.held[slot]
            same = held == hashes
            out[rest[same]] = self.slots[slot[same]]
            on = ~same & (held != 0)
            rest, hashes, slot = rest[on], hashes[on], slot[on]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New, distinct hashes take the next numbers."""
        size = self.count + len(hashes)
        if size > len(self.hashes):
            self.hashes = np.concatenate([self.hashes[: self.count], np.zeros(max(size, 2 * self.count) - self.count, dtype=np.uint64)])
        self.hashes[self.count : size] = np.maximum(hashes, np.uint64(1))
        numbers = np.arange(self.count, size, dtype=np.int32)
        self.count = size
        if 2 * size > len(self.slots):
            self._slots(int(4 * size).bit_length())
        else:
            self._place(numbers)

    def keep(self, count: int) -> None:
        """Forget all but the first numbers."""
        self.count = min(count, self.count)
        self._slots(max(11, int(4 * self.count).bit_length()))


class Pool:
    """Arrays of different lengths in one growing array."""

    def __init__(self, kind: type) -> None:
        self.values, self.bounds, self.count = np.zeros(1 << 12, dtype=kind), np.zeros(1 << 10, dtype=np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        start, size = int(self.bounds[self.count]), self.count + len(lengths)
        if start + len(values) > len(self.values):
            self.values = np.concatenate([self.values[:start], np.zeros(max(start, len(values)) + len(values), dtype=self.values.dtype)])
        if size + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: self.count + 1], np.zeros(2 * size, dtype=np.int64)])
        self.values[start : start + len(values)] = values
        self.bounds[self.count + 1 : size + 1] = start + np.cumsum(lengths)
        self.count = size

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.bounds[numbers + 1] - self.bounds[numbers]

    def keep(self, count: int) -> None:
        self.count = min(count, self.count)


class UnitTable:
    """Payloads of units, learned when they are first met; at most ``entries`` stay after a slice of text.

    When there are more, those that came first stay: frequent units come early.
    """

    def __init__(self, learn: Learn, kind: type, entries: int) -> None:
        self.learn, self.entries = learn, entries
        self.index, self.keys, self.payload = HashIndex(), Pool(np.uint8), Pool(kind)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, number of values of each unit) of all units in their order. ``flags`` go to ``learn``."""
        if self.index.count > self.entries:
            for part in (self.index, self.keys, self.payload):
                part.keep(self.entries // 2)
        hashes = range_hashes(data, starts, ends)
        numbers = self.index.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            order = np.argsort(first, kind="stable")  # in the order of the text
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            own = missing[first[order]]
            values, counts = self.learn(data, starts[own], ends[own], flags[own])
            numbers[missing] = self.index.count + place[inverse]
            self.index.add(new[order])
            self.keys.add(data[ranges(starts[own], ends[own] - starts[own])], ends[own] - starts[own])
            self.payload.add(values, counts)
        lengths = ends - starts
        if not (np.array_equal(self.keys.lengths(numbers), lengths) and np.array_equal(self.keys.values[ranges(self.keys.bounds[numbers], lengths)], data[ranges(starts, lengths)])):
            return self.learn(data, starts, ends, flags)  # two units share a hash: answer without the table
        counts = self.payload.lengths(numbers)
        return self.payload.values[ranges(self.payload.bounds[numbers], counts)], counts


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of texts; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


#: Bytes worked on at a time: what is held beside the text is some 60 times as much.
WINDOW = 1 << 19


def windows(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(from, to, number of the first text, text bounds inside) of runs of about ``WINDOW`` bytes: whole texts, or pieces of a longer one.

    Long texts are cut before single spaces between ASCII letters, where every tokenizer here starts anew.
    """
    at, text = 0, 0
    while text < len(bounds) - 1:
        last = max(text + 1, int(np.searchsorted(bounds, at + WINDOW, side="right")) - 1)
        end = int(bounds[last])
        if last > text + 1 or end - at <= WINDOW:
            yield at, end, text, np.append(at, bounds[text + 1 : last + 1]) - at
            at, text = end, last
            continue
        cuts, span = np.zeros(0, dtype=np.int64), WINDOW
        while not len(cuts) and span < end - at:
            piece = data[at : at + span]
            letter = ((piece | 32) >= 97) & ((piece | 32) <= 122)
            cuts = np.flatnonzero((piece[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
            span *= 2
        cut = at + int(cuts[-1]) if len(cuts) else end
        yield at, cut, text, np.array([0, cut - at], dtype=np.int64)
        at = cut
        text += cut == end


def whole_texts(data: np.ndarray, bounds: np.ndarray, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds by text) of a column, from ``encode``, which gives those of a window."""
    counts, values = np.zeros(len(bounds) - 1, dtype=np.int64), []
    for low, high, text, inner in windows(data, bounds):
        if high > low:
            found, own = encode(data[low:high], inner)
            values.append(found)
            counts[text : text + len(inner) - 1] += np.diff(own)
    return (np.concatenate(values) if values else np.zeros(0, dtype=np.uint32)), np.append(0, np.cumsum(counts))
