"""Token counts at every prefix of a text, by dynamic programming.

A SentencePiece BPE model never joins characters over the start of a run of spaces (checked when the
model is loaded), so a text is a sequence of chunks with independent encodings, and the count at a
prefix is the count of the whole chunks before it plus the count inside its chunk. Inside a chunk the
encoding of a prefix of length i ends in exactly one piece t: the one that is *compatible* with the
last piece u of the prefix of length i - len(t), that is, for which u + t encodes to [u, t]. So

    last[i] = t,  count[i] = count[i - len(t)] + 1

is a table filled from left to right in one pass, whatever the length of the chunk. A character
outside the vocabulary stands alone and costs its UTF-8 bytes (byte fallback).

What is stored per text is the difference between neighbouring prefixes, one small integer a character; its running
sum is the exact count at each prefix and answers truncation and budget questions with no second encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from tracelab.llm.packing import binaries
from tracelab.llm.store import in_batches, slices, tidy, with_columns
from tracelab.llm.unit_table import HashIndex, UnitTable, joined, ranges, whole_texts
from tracelab.llm.word_hash import BASE, mix

SPACE = "▁"
#: A character outside every vocabulary: it keeps the model's own leading space mark from merging.
GUARD = "\x00"
#: Chunks that a worker remembers (about 50 MB), and pairs of pieces.
CACHE = 600_000
#: Characters of a chunk whose table is filled together with others, and characters of such chunks at a time.
MATRIX, CELLS = 48, 1 << 18
#: Pairs from which on the model is asked for all at once.
MANY = 200

STEPS_SCHEMA = "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, width int, steps binary"


class PrefixCounter:
    """Differences of token counts between the prefixes of texts, for one SentencePiece BPE model."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this model spans a word boundary; chunks would not be independent")
        special = (self.sp.is_control, self.sp.is_unknown, self.sp.is_byte, self.sp.is_unused)
        self.vocabulary = {p for i, p in enumerate(pieces) if not any(f(i) for f in special)}
        #: Lengths of the pieces that end in a given pair of characters, the longest first.
        self.lengths: dict[str, list[int]] = {}
        for piece in sorted(self.vocabulary, key=len, reverse=True):
            for end in {piece[-2:], piece[-1:]} if len(piece) == 1 else {piece[-2:]}:
                known = self.lengths.setdefault(end, [])
                if len(piece) not in known:
                    known.append(len(piece))
        self.compatible: dict[tuple[str, str], bool] = {}
        #: The vocabulary by number, for whole columns of texts.
        self.ids = [i for i, p in enumerate(pieces) if p in self.vocabulary and not any(f(i) for f in special)]
        self.names = [pieces[i] for i in self.ids]
        self.lone, self.longest = self.sp.piece_to_id(SPACE), max(map(len, self.names))
        if self.longest > 50:
            raise ValueError("pieces of this model are too long for the masks of lengths")
        self.powers, inverse = (np.cumprod(np.append(np.uint64(1), np.full(MATRIX, b, dtype=np.uint64))) for b in (BASE, pow(BASE, -1, 2**64)))
        self.inverse = inverse
        self.by_hash, self.endings, self.pairs = HashIndex(), HashIndex(), HashIndex()
        self.by_hash.add(np.array([self._hash(p) for p in self.names], dtype=np.uint64))
        masks: dict[int, int] = {}
        for name in self.names:
            if len(name) > 1:
                key = 0
                for letter in name[-3:]:
                    key = key << 21 | ord(letter)
                masks[key] = masks.get(key, 0) | 1 << len(name)
        #: Bits of the lengths of the pieces that end in given three characters, and pieces of two.
        self.ending_masks = np.array(list(masks.values()), dtype=np.int64)
        self.endings.add(mix(np.array(list(masks), dtype=np.uint64)))
        self.pair_fits = np.zeros(0, dtype=bool)
        self.chunks = UnitTable(self._learn, np.int32, CACHE)

    def _hash(self, name: str) -> int:
        codes = np.array([ord(c) for c in name], dtype=np.uint64)
        return int(mix((mix(codes) * self.powers[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes)))[0])

    def pieces(self, text: str) -> list[str]:
        """Encoding of a piece of text in the inner alphabet, without the model's own leading mark."""
        if text.startswith(SPACE):
            inner = text[1:].replace(SPACE, " ")
            return self.sp.encode(inner, out_type=str) if inner else [SPACE]
        return self.sp.encode(GUARD + text.replace(SPACE, " "), out_type=str)[2:]

    def fits(self, last: str, piece: str) -> bool:
        known = self.compatible.get((last, piece))
        if known is None:
            if len(self.compatible) > CACHE:
                self.compatible.clear()
            known = self.compatible[last, piece] = self.pieces(last + piece) == ([last, piece] if last else [piece])
        return known

    def extend(self, chunk: str, last: list[str], count: list[int]) -> None:
        """Fill the tables, which hold a prefix of ``chunk`` already, up to its end."""
        vocabulary, compatible, lengths = self.vocabulary, self.compatible, self.lengths
        for end in range(len(last), len(chunk) + 1):
            found = ""
            for length in lengths.get(chunk[end - 2 : end] if end > 1 else "", ()):
                if length <= end:
                    piece = chunk[end - length : end]
                    if piece in vocabulary:
                        before = last[end - length]
                        fit = compatible.get((before, piece))
                        if fit if fit is not None else self.fits(before, piece):
                            found = piece
                            break
            if not found and chunk[end - 1] in vocabulary:
                found = chunk[end - 1]
            last.append(found)
            count.append(count[end - len(found)] + 1 if found else count[end - 1] + len(chunk[end - 1].encode("utf-8", "replace")))

    def steps(self, chunk: str) -> np.ndarray:
        last, count = [""], [0]
        self.extend(chunk, last, count)
        return np.diff(np.asarray(count, dtype=np.int64))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of new chunks: those of up to ``MATRIX`` characters together, longer ones one by one."""
        lengths = ends - starts
        joined_bytes = data[ranges(starts, lengths)]
        letters = np.frombuffer(joined_bytes.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.int64)
        letters[letters == 32] = ord(SPACE)
        before = np.append(0, np.cumsum((joined_bytes & 0xC0) != 0x80))
        before_bytes = np.append(0, np.cumsum(lengths))
        bounds = before[before_bytes]
        counts = np.diff(bounds)
        out = np.zeros(len(letters), dtype=np.int32)
        short = np.flatnonzero(counts <= MATRIX)
        by_size = short[np.argsort(counts[short], kind="stable")]
        for some in np.split(by_size, np.flatnonzero(np.diff(np.cumsum(counts[by_size]) // CELLS)) + 1):
            if len(some):
                words = np.array([joined_bytes[a:b].tobytes() for a, b in zip(before_bytes[some], before_bytes[some + 1])])
                some = some[np.argsort(words, kind="stable")]
                out[ranges(bounds[some], counts[some])] = self._matrix(letters, bounds[some], counts[some])
        for i in np.flatnonzero(counts > MATRIX).tolist():
            out[bounds[i] : bounds[i + 1]] = self.steps("".join(map(chr, letters[bounds[i] : bounds[i + 1]].tolist())))
        return out, counts

    def _matrix(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Steps of sorted chunks: one column of the tables at a time, each beginning that chunks share once."""
        n, width = len(lengths), int(lengths.max())
        place = np.arange(width)[:, None]
        inside = place < lengths
        grid = np.where(inside, letters[np.minimum(starts + place, len(letters) - 1)], -1)  # a row per place, a column per chunk
        sums = np.zeros((width + 1, n), dtype=np.uint64)
        np.cumsum(mix(grid.astype(np.uint64)) * self.powers[:width, None], axis=0, out=sums[1:])
        last, count = np.full((width + 1, n), -1, dtype=np.int32), np.zeros((width + 1, n), dtype=np.int32)
        fresh = np.ones(n, dtype=bool)  # chunks that differ from the one before them up to here
        fresh[1:] = False
        for end in range(1, width + 1):
            fresh[1:] |= grid[end - 1, 1:] != grid[end - 1, :-1]
            chunk = np.flatnonzero(fresh & inside[end - 1])
            letter = grid[end - 1, chunk]
            masks = np.zeros(len(chunk), dtype=np.int64)
            if end > 1:
                two = grid[end - 2, chunk] << 21 | letter
                for key in [two] + ([grid[end - 3, chunk] << 42 | two] if end > 2 else []):
                    known = self.endings.find(mix(key.astype(np.uint64)))
                    masks |= np.where(known >= 0, self.ending_masks[known], 0)
                masks &= (2 << end) - 1
            open_ = masks[masks > 0]
            at = chunk[masks > 0]
            while len(at):  # each tries its candidates, the longest first
                length = np.frexp(open_.astype(np.float64))[1].astype(np.int64) - 1
                open_ ^= np.int64(1) << length
                begin = end - length
                piece = self.by_hash.find(mix((sums[end, at] - sums[begin, at]) * self.inverse[begin] + length.astype(np.uint64)))
                hit = np.flatnonzero(piece >= 0)
                hit = hit[self._fit(last[begin[hit], at[hit]].astype(np.int64), piece[hit])]
                last[end, at[hit]], count[end, at[hit]] = piece[hit], count[begin[hit], at[hit]] + 1
                open_[hit] = 0
                on = open_ > 0
                at, open_ = at[on], open_[on]
            none = last[end, chunk] < 0
            if none.any():  # a character by itself, or outside the vocabulary
                code, own = letter[none], chunk[none]
                alone = self.by_hash.find(mix(mix(code.astype(np.uint64)) + np.uint64(1)))
                cost = np.where(alone >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
                last[end, own], count[end, own] = alone, count[end - 1, own] + cost
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            last[end], count[end] = last[end, first], count[end, first]
        return np.diff(count, axis=0).T[inside.T]

    def _fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow another (-1: none), by numbers of the vocabulary."""
        keys = mix(((before + 1) << 32 | piece).astype(np.uint64))
        found = self.pairs.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            own = missing[first]
            answers = self._ask([(int(before[i]), int(piece[i])) for i in own])
            if self.pairs.count > CACHE:
                self.pairs.keep(CACHE // 2)
                self.pair_fits = self.pair_fits[: self.pairs.count]
            self.pairs.add(new)
            self.pair_fits = np.concatenate([self.pair_fits, answers])
            return self._fit(before, piece)
        return self.pair_fits[found]

    def _ask(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """The model's own answers for pairs of pieces."""
        whole = [(self.names[a] if a >= 0 else "") + self.names[b] for a, b in pairs]
        marked = [t.startswith(SPACE) for t in whole]
        texts = [t[1:].replace(SPACE, " ") if m else GUARD + t.replace(SPACE, " ") for t, m in zip(whole, marked)]
        encoded = self.sp.encode(texts, num_threads=1) if len(texts) >= MANY else map(self.sp.encode, texts)
        out = np.empty(len(pairs), dtype=bool)
        for i, ((a, b), ids, m, t) in enumerate(zip(pairs, encoded, marked, texts)):
            got = (ids if t else [self.lone]) if m else ids[2:]
            out[i] = got == ([self.ids[a], self.ids[b]] if a >= 0 else [self.ids[b]])
        return out

    def _window(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        steps, counts = self.chunks.look_up(data, starts, np.append(starts[1:], len(data)), np.zeros(len(starts), dtype=bool))
        return steps, np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)]

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(steps, bounds): steps[bounds[i] + j] is count(prefix j + 1) - count(prefix j) of text i."""
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), SPACE, " ")  # the model does not tell them apart
        filled = pc.greater(pc.binary_length(texts), 0)
        marked = pc.if_else(filled, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        steps, bounds = whole_texts(*joined(marked), self._window)  # the model puts its mark before a text
        own = bounds[:-1][np.diff(bounds) > 0]
        steps[own + 1] += steps[own]
        return np.delete(steps, own), bounds - np.append(0, np.cumsum(np.diff(bounds) > 0))

    def text_steps(self, text: str) -> tuple[int, bytes]:
        """Width in bytes of a step, and the steps: count(prefix i + 1) - count(prefix i)."""
        return stored(self.columns(pa.array([text], pa.large_string()))[0])


def stored(steps: np.ndarray) -> tuple[int, bytes]:
    small = not len(steps) or np.abs(steps).max() < 128
    return (1, steps.astype(np.int8).tobytes()) if small else (8, steps.astype("<i8").tobytes())


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The counter of this Python worker for a model file."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def decoded(width: int, steps: bytes) -> np.ndarray:
    """Exact token count of every non-empty prefix of a text."""
    return np.cumsum(np.frombuffer(steps, dtype=np.int8 if width == 1 else "<i8"), dtype=np.int64)


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_chars, n_tokens, width, steps).

    ``steps`` holds the differences of the token counts of neighbouring prefixes (by character), in
    ``width`` bytes each, little-endian. A null text counts as empty: no steps, 0 tokens. Rows are
    answered one by one: null and repeated ids and repeated rows are kept as they are, an empty table gives an
    empty result, further columns are ignored. Texts are split into chunks and never cut.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            steps, bounds = own.columns(texts)
            if not len(steps) or np.abs(steps).max() < 128:
                width, kept = np.ones(len(texts), dtype=np.int32), binaries(steps.astype(np.int8), bounds)
            else:
                each = [stored(steps[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                width, kept = np.array([w for w, _ in each], dtype=np.int32), pa.array([s for _, s in each], pa.binary())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pc.binary_length(texts).fill_null(0).cast(pa.int64()),
                "n_chars": pa.array(np.diff(bounds)),
                "n_tokens": pa.array(np.diff(np.append(0, np.cumsum(steps, dtype=np.int64))[bounds])),
                "width": pa.array(width),
                "steps": kept,
            })

    return in_batches(with_columns(docs, doc_id="bigint", text="string")).mapInArrow(tidy(rows), STEPS_SCHEMA)


def _steps(width: pa.Array, steps: pa.Array) -> Iterator[np.ndarray | None]:
    """Decoded counts at the prefixes of each row; None for a null."""
    for w, s in zip(width.to_pylist(), steps):
        yield decoded(w, s.as_buffer()) if s.is_valid else None


@arrow_udf(LongType())
def _fitting(width: pa.Array, steps: pa.Array, budget: pa.Array) -> pa.Array:
    out: list[int | None] = []
    for counts, most in zip(_steps(width, steps), budget.to_pylist()):
        fits = None if counts is None or most is None else np.flatnonzero(counts <= most)
        out.append(None if fits is None else int(fits[-1]) + 1 if len(fits) else 0)
    return pa.array(out, pa.int64())


@arrow_udf(LongType())
def _at(width: pa.Array, steps: pa.Array, n_chars: pa.Array) -> pa.Array:
    out: list[int | None] = []
    for counts, n in zip(_steps(width, steps), n_chars.to_pylist()):
        n = None if counts is None or n is None else min(max(0, n), len(counts))
        out.append(None if n is None else int(counts[n - 1]) if n else 0)
    return pa.array(out, pa.int64())


def chars_within(budget: Column | str) -> Column:
    """Length of the longest prefix whose token count is at most ``budget``, from stored steps."""
    return _fitting(F.col("width"), F.col("steps"), F.col(budget) if isinstance(budget, str) else budget)


def tokens_at(n_chars: Column | str) -> Column:
    """Token count of the prefix of ``n_chars`` characters, from stored steps."""
    return _at(F.col("width"), F.col("steps"), F.col(n_chars) if isinstance(n_chars, str) else n_chars)
