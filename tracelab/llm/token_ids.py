"""Token ids of whole texts, each distinct unit encoded once per Python worker.

A text is cut where the tokenizer's own pre-tokenizer starts anew whatever stands around: at a single space between two
characters that are not white space (byte-level kind), or at any ASCII white space (word kind, which drops it).
Most pieces are plain: letters, digits, marks and single line breaks. They are cut further into the
pre-tokens, runs of one class of characters, and new ones are merged many at a time (``byte_pairs``). All other pieces (apostrophes,
added tokens, runs of white space, rare alphabets, very long runs) are units as they stand and go to the tokenizer itself.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from tracelab.llm.byte_pairs import Merges
from tracelab.llm.unit_table import UnitTable, joined, ranges, whole_texts

#: Units that a worker remembers by default (about 50 MB).
CACHE = 1_000_000
#: Longer runs of one class go to the tokenizer.
LONG_RUN = 200
LETTER, DIGIT, MARK, BREAK, SPACE, RARE = range(6)
#: Alphabets whose letters all versions of Unicode agree on: Latin, Greek, Cyrillic, then kana, ideographs and Hangul.
SETTLED = 0x530
ALPHABETS = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
#: White space of two or three bytes, and a character that older versions counted as such.
WIDE_SPACES = [chr(c) for c in [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
ASCII_SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
SEPARATOR = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])

_TOKENIZERS: dict[tuple[str, bool, int, bool], "WordIds"] = {}


def _class_of_ascii(byte: int) -> int:
    char = chr(byte)
    if char.isalpha():
        return LETTER
    if char.isdigit():
        return DIGIT
    if char == "\n":
        return BREAK
    if char == " ":
        return SPACE
    return RARE if byte < 32 or char in "'\x7f" else MARK


ASCII_CLASS = np.array([_class_of_ascii(b) if b < 128 else RARE for b in range(256)], dtype=np.uint8)
WIDE_LETTER = np.zeros(0x10000, dtype=bool)
WIDE_LETTER[0x80:SETTLED] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x80, SETTLED)]
for low, high in ALPHABETS:
    WIDE_LETTER[low : high + 1] = True
#: Punctuation and symbols that are neither letters nor numbers nor white space.
WIDE_MARK = np.zeros(0x10000, dtype=bool)
for low, high in [(0xA1, 0xBF), (0x2010, 0x2027), (0x2030, 0x203E)]:
    WIDE_MARK[low : high + 1] = [unicodedata.category(chr(c))[0] in "PS" for c in range(low, high + 1)]
#: Lower case of two-byte letters that have one of two bytes; 0 for letters that a normalising tokenizer may change otherwise.
LOWER = np.zeros(0x10000, dtype=np.int64)
for code in range(0x80, 0x10000):
    if WIDE_LETTER[code] and unicodedata.normalize("NFC", chr(code)) == chr(code):
        small = chr(code).lower()
        if len(small) == 1 and (code >= SETTLED and small == chr(code) or code < SETTLED and 0x80 <= ord(small) < 0x800):
            LOWER[code] = ord(small)


def wide_space(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether white space of several bytes ends before (or starts at) each position."""
    out = np.zeros(len(at), dtype=bool)
    look = np.flatnonzero(data[np.clip(at - 1 if before else at, 0, len(data) - 1)] >= 0x80)
    for place in look.tolist():
        p = int(at[place])
        near = bytes(data[max(0, p - 3) : p]) if before else bytes(data[p : p + 3])
        out[place] = any(near.endswith(s) if before else near.startswith(s) for s in _WIDE_BYTES)
    return out


_WIDE_BYTES = [s.encode() for s in WIDE_SPACES]
_WIDE_LEADS = np.isin(np.arange(256), sorted({b[0] for b in _WIDE_BYTES}))


class WordIds:
    """Ids by ``tokenizers`` for one file, without added begin and end tokens.

    ``drops_space``: the file is of the word kind. With ``plain`` the strings of added tokens are text like any other.
    """

    def __init__(self, path: str, drops_space: bool, entries: int | None = None, plain: bool = False) -> None:
        self.path, self.plain = path, plain
        self.drops_space, self.merges = drops_space, Merges(path)
        #: Pieces with the first two characters of an added token may hold one.
        self.marks = sorted({t.encode()[:2] for t in self.merges.added}) if not plain else []
        self.units = UnitTable(self._learn, np.uint32, entries or CACHE)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, for pieces that are not plain."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = self.plain
        return tokenizer

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        whole = whole | (lengths > LONG_RUN) | (not self.merges.orderly)
        counts = np.zeros(len(starts), dtype=np.int64)
        values: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(starts)
        slow = np.flatnonzero(whole)
        texts = [bytes(data[starts[i] : ends[i]]).decode("utf-8") for i in slow.tolist()]
        for i, encoding in zip(slow.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []):
            values[i] = np.asarray(encoding.ids, dtype=np.uint32)
            counts[i] = len(values[i])
        fast = np.flatnonzero(~whole)
        if len(fast):
            ids, sizes = self.merges.encode(data[ranges(starts[fast], lengths[fast])], lengths[fast])
            counts[fast] = sizes
            if not len(slow):
                return ids, counts
            bounds = np.cumsum(sizes)[:-1]
            for i, part in zip(fast.tolist(), np.split(ids, bounds)):
                values[i] = part
        return (np.concatenate(values) if values else np.zeros(0, dtype=np.uint32)), counts

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of each byte, bytes as the tokenizer sees those of plain pieces)."""
        kind, seen = ASCII_CLASS[data], data
        if self.drops_space:
            upper = (data >= 65) & (data <= 90)
            seen = np.where(upper, data | 32, data)
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
            lead = padded[wide]
            two = lead < 0xE0
            three = (lead >= 0xE0) & (lead < 0xF0)
            code = np.where(two, (lead & 31) << 6 | padded[wide + 1] & 63, (lead & 15) << 12 | (padded[wide + 1] & 63) << 6 | padded[wide + 2] & 63)
            code[~(two | three)] = 0
            letter = WIDE_LETTER[code]
            if self.drops_space:
                letter &= LOWER[code] > 0
                change = np.flatnonzero(letter & two & (LOWER[code] != code))
                if len(change):
                    small = LOWER[code[change]]
                    seen[wide[change]], seen[wide[change] + 1] = 0xC0 | small >> 6, 0x80 | small & 63
            for name, known in ((LETTER, letter), (MARK, WIDE_MARK[code])):
                at = wide[known]
                kind[at], kind[at + 1] = name, name
                kind[wide[known & three] + 2] = name
        return kind, seen

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of all texts; in the byte-level kind a piece begins with the space before it."""
        n = len(data)
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        if self.drops_space:
            separator = SEPARATOR[data]
            begins = ~separator
            begins[1:] &= separator[:-1]
            begins[first] |= ~separator[first]
            starts = np.flatnonzero(begins)
            stops = np.append(np.flatnonzero(separator), n)
            following = stops[np.searchsorted(stops, starts)]
            text_end = bounds[np.searchsorted(bounds, starts, side="right")]
            return starts, np.minimum(following, text_end)
        cuts = np.flatnonzero(data == 32)
        inner = np.ones(n + 1, dtype=bool)
        inner[bounds] = False  # a space at the start or the end of a text
        cuts = cuts[inner[cuts] & inner[cuts + 1]]
        cuts = cuts[~ASCII_SPACE[data[cuts - 1]] & ~ASCII_SPACE[data[cuts + 1]]]
        doubtful = np.flatnonzero((data[cuts - 1] >= 0x80) | _WIDE_LEADS[data[cuts + 1]])
        if len(doubtful):
            doubtful = doubtful[(data[cuts[doubtful] - 1] < 0x80) | _ends_wide(data, cuts[doubtful]) | _WIDE_LEADS[data[cuts[doubtful] + 1]]]
            at = cuts[doubtful]
            bad = wide_space(data, at, True) | wide_space(data, at + 1, False)
            cuts = np.delete(cuts, doubtful[bad])
        begins = np.zeros(n, dtype=bool)
        begins[first], begins[cuts] = True, True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], n) if len(starts) else starts

    def _parts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, whole) of the units: pre-tokens of plain pieces, and whole pieces that are not plain."""
        starts, ends = self._pieces(data, bounds)
        kind, seen = self._classes(data)
        lead = starts[(data[starts] == 32) & (ends - starts > 1)]
        kind[lead] = kind[lead + 1]  # the space before a run belongs to it
        if self.drops_space:
            strange = (kind == RARE) | (kind == BREAK) | (kind == SPACE)
        else:
            strange = (kind == RARE) | (kind == SPACE)
            breaks = np.flatnonzero(kind == BREAK)  # single ones inside a piece are pre-tokens of their own
            if len(breaks):
                edge = np.zeros(len(data) + 1, dtype=bool)
                edge[starts], edge[ends] = True, True
                near = lambda at: (kind[at] > MARK) | (data[at] == 32)
                strange[breaks] |= edge[breaks] | edge[breaks + 1] | near(np.maximum(breaks - 1, 0)) | near(np.minimum(breaks + 1, len(data) - 1))
        for mark in self.marks:
            if len(mark) == 2:
                strange[:-1] |= (data[:-1] == mark[0]) & (data[1:] == mark[1])
            else:
                strange |= data == mark[0]
        inside = np.append(0, np.cumsum(strange))
        whole = inside[ends] > inside[starts]
        if self.drops_space and seen is not data and whole.any():
            at = ranges(starts[whole], (ends - starts)[whole])
            seen[at] = data[at]
        change = np.zeros(len(data) + 1, dtype=bool)
        change[1:-1] = kind[1:] != kind[:-1]
        if self.drops_space:
            digit = np.flatnonzero(kind == DIGIT)
            change[digit], change[digit + 1] = True, True
        level = np.zeros(len(data) + 1, dtype=np.int64)  # places outside plain pieces are no starts
        np.add.at(level, starts[~whole], 1)
        np.add.at(level, ends[~whole], -1)
        change[:-1] &= np.cumsum(level[:-1]) > 0
        change[starts], change[-1] = True, False
        begin = np.flatnonzero(change)
        owner = np.searchsorted(starts, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), ends[owner])
        return seen, begin, end, whole[owner]

    def _window(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, begin, end, whole = self._parts(data, bounds)
        ids, counts = self.units.look_up(seen, begin, end, whole)
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(begin, bounds)]

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of text i, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them, lie between bounds i and i + 1."""
        return whole_texts(*joined(texts), self._window)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian uint32 bytes."""
        ids, bounds = self.columns(pa.array(texts, pa.large_string()))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b].astype("<u4").tobytes()


def _ends_wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position may be white space of several bytes, by its first byte."""
    last = data[np.maximum(at - 2, 0)]
    third = data[np.maximum(at - 3, 0)]
    return _WIDE_LEADS[last] | _WIDE_LEADS[third]


def word_ids(path: str, drops_space: bool, entries: int | None = None, plain: bool = False) -> WordIds:
    """The tokenizer of this Python worker for a vocabulary file, with a table of so many units."""
    key = path, drops_space, entries or CACHE, plain
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordIds(*key)
    return _TOKENIZERS[key]
