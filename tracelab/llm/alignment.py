"""Alignment of the tokens of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

Both token sequences of a text are given by their ends in bytes. The shorter list of ends gallops through the longer one:
an exponential search bounds the place, a binary search finds it. Ends that both have cut the tokens into groups;
the ranks of the common ends in both lists are the bounds of the groups, their differences the numbers of tokens.

A pair of ids is linked in a text when tokens of these ids share a group. A task numbers the pairs that it meets, in dictionaries
of a bounded size, and writes each text's pairs by number. Only dictionaries are shuffled by pair to be counted; the counts go back to
their dictionaries, and the texts meet the dictionary they were written with. No table of all pairs is ever in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.byte_pairs import byte_letters
from tracelab.llm.packing import binaries
from tracelab.llm.store import Scratch, in_batches, slices, tidy, with_columns
from tracelab.llm.token_ids import word_ids
from tracelab.llm.unit_table import HashIndex, UnitTable, joined, whole_texts
from tracelab.llm.word_hash import mix

SPACE = "▁"
#: Needles searched in one galloped stretch.
STRETCH = 1024
#: Links of a group whose pairs are listed one by one; larger groups are counted by distinct ids first.
LISTED = 1 << 12
#: Pairs of a dictionary, after which the next one begins, and those in a row of one.
PAIRS, ROW_PAIRS = 500_000, 1 << 15
#: Chunks that a worker remembers.
CHUNKS = 600_000
TEXT_BYTES = 1 << 20

ENCODED = (
    "part bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs binary, times binary, first int, codes array<bigint>, holders array<bigint>"
)
COUNTED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in short, places in long) of the common values of two ascending lists; ``short`` drives."""
    found = np.empty(len(short), dtype=np.int64)
    at = 0
    for start in range(0, len(short), STRETCH):
        needles = short[start : start + STRETCH]
        step = len(needles)
        while at + step < len(long) and long[at + step] < needles[-1]:
            step *= 2
        places = at + np.searchsorted(long[at : at + step + 1], needles)
        found[start : start + len(needles)] = places
        at = int(places[-1])
    same = np.flatnonzero(found < len(long))
    same = same[long[found[same]] == short[same]]
    return same, found[same]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ends in both lists."""
    if len(ends_a) <= len(ends_b):
        return gallop(ends_a, ends_b)
    two, one = gallop(ends_b, ends_a)
    return one, two


class PieceIds:
    """Ids of a SentencePiece BPE model, each distinct chunk (spaces and the word after them) encoded once per worker.

    A chunk whose pieces do not spell its bytes is answered by the single number ``strange``.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("a piece of this model spans a word boundary; chunks would not be independent")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.sp.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([*map(len, self.bytes), 0], dtype=np.int64)
        self.strange, self.lone = len(names), self.sp.piece_to_id(SPACE)
        self.chunks = UnitTable(self._learn, np.uint32, CHUNKS)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out: list[int] = []
        counts = np.empty(len(starts), dtype=np.int64)
        whole, encode, spelled = data.tobytes(), self.sp.encode, self.bytes
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            chunk = whole[a:b]  # begins with the space that the model puts before a text
            ids = encode(chunk[1:].decode("utf-8")) if b - a > 1 else [self.lone]
            if b"".join([spelled[x] for x in ids]) != chunk:
                ids = [self.strange]
            out += ids
            counts[i] = len(ids)
        return np.array(out, dtype=np.uint32), counts

    def _window(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(begins)
        ids, counts = self.chunks.look_up(data, starts, np.append(starts[1:], len(data)), np.zeros(len(starts), dtype=bool))
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)]

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return whole_texts(*joined(texts), self._window)


class Groups:
    """The groups of a column of texts, given as ids and text bounds of both tokenizers and the byte lengths of their tokens."""

    def __init__(self, a: np.ndarray, bounds_a: np.ndarray, b: np.ndarray, bounds_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray) -> None:
        self.a, self.b, self.texts = a.astype(np.int64), b.astype(np.int64), len(bounds_a) - 1
        last_a, last_b = common_ends(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]))
        self.stop_a, self.stop_b = last_a + 1, last_b + 1
        self.size_a, self.size_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)
        #: Text of each group; every text ends with a common end.
        self.text = np.searchsorted(bounds_a, last_a, side="right") - 1
        self.n_a, self.n_b = np.diff(bounds_a), np.diff(bounds_b)
        self.n_groups = np.bincount(self.text, minlength=self.texts)
        self.links = self.size_a * self.size_b
        self.n_links = np.diff(np.append(0, np.cumsum(self.links))[np.searchsorted(self.text, np.arange(self.texts + 1))])

    def pairs(self, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a * factor + b, how often) of the distinct linked pairs of each text."""
        some = np.flatnonzero(self.links <= LISTED)
        counts = self.links[some]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        width = np.repeat(self.size_b[some], counts)
        a = np.repeat((self.stop_a - self.size_a)[some], counts) + within // np.maximum(width, 1)
        b = np.repeat((self.stop_b - self.size_b)[some], counts) + within % np.maximum(width, 1)
        texts, codes, times = [np.repeat(self.text[some], counts)], [self.a[a] * factor + self.b[b]], [np.ones(len(a), dtype=np.int64)]
        for g in np.flatnonzero(self.links > LISTED).tolist():
            ids_a, of_a = np.unique(self.a[self.stop_a[g] - self.size_a[g] : self.stop_a[g]], return_counts=True)
            ids_b, of_b = np.unique(self.b[self.stop_b[g] - self.size_b[g] : self.stop_b[g]], return_counts=True)
            codes.append((ids_a[:, None] * factor + ids_b).ravel())
            times.append((of_a[:, None] * of_b).ravel())
            texts.append(np.full(len(codes[-1]), self.text[g]))
        text, code, often = map(np.concatenate, (texts, codes, times))
        key = text << 34 | code
        order = np.argsort(key, kind="stable")
        key, often = key[order], often[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return key[first] >> 34, key[first] & ((1 << 34) - 1), np.add.reduceat(often, first) if len(first) else often

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;...``, and the ends of the groups in these bytes."""
        n_a, n_b, groups = len(self.a), len(self.b), len(self.text)
        at_a = np.arange(n_a) + np.repeat(self.stop_b - self.size_b, self.size_a)
        at_b = np.arange(n_b) + np.repeat(self.stop_a, self.size_b)
        ids, mark = np.empty(n_a + n_b, dtype=np.int64), np.full(n_a + n_b, ord(","), dtype=np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[self.stop_a - 1]], mark[at_b[self.stop_b - 1]] = ord("|"), ord(";")
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
        stop = np.cumsum(digits + 1)
        out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
        out[stop - 1] = mark
        for k in range(int(digits.max(initial=0))):
            some = np.flatnonzero(digits > k)
            out[stop[some] - 2 - k] = 48 + ids[some] // 10**k % 10
        return out.tobytes(), (stop[at_b[self.stop_b - 1]] if groups else np.zeros(0, dtype=np.int64))


class Aligner:
    """Both tokenizers of one Python worker."""

    def __init__(self, words: str, pieces: str) -> None:
        self.words, self.pieces = word_ids(words, False, plain=True), PieceIds(pieces)
        letters = {x: i for i, x in enumerate(byte_letters())}
        names = self.words.tokenizer.get_vocab()
        self.lengths = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            self.lengths[i] = len(name) if all(c in letters for c in name) else len(name.encode())
        self.factor = len(self.pieces.lengths)
        if len(self.lengths) * self.factor >= 1 << 34:
            raise ValueError("the vocabularies are too large for the codes of pairs")

    def groups(self, texts: pa.Array) -> Groups:
        """Groups of the texts, with a space put before each; those that a tokenizer does not spell have no tokens."""
        texts = texts.fill_null("").cast(pa.large_string())
        empty = pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(texts, empty), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, empty))
        a, bounds_a = self.words.columns(texts)
        b, bounds_b = self.pieces.columns(texts)
        strange = np.append(0, np.cumsum(b == self.pieces.strange))[bounds_b]
        bytes_a = np.append(0, np.cumsum(self.lengths[a]))[bounds_a]
        wrong = (np.diff(strange) > 0) | (np.diff(bytes_a) != np.diff(joined(texts)[1]))
        if wrong.any():
            a, bounds_a = without(a, bounds_a, wrong)
            b, bounds_b = without(b, bounds_b, wrong)
        return Groups(a, bounds_a, b, bounds_b, self.lengths, self.pieces.lengths)


def without(values: np.ndarray, bounds: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(bounds)
    return values[np.repeat(~wrong, counts)], np.append(0, np.cumsum(np.where(wrong, 0, counts)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(words: str, pieces: str) -> Aligner:
    if (words, pieces) not in _ALIGNERS:
        _ALIGNERS[words, pieces] = Aligner(words, pieces)
    return _ALIGNERS[words, pieces]


class Dictionary:
    """Numbers of the pairs that the texts of one part hold, and how many of these texts hold each."""

    def __init__(self) -> None:
        self.index, self.codes, self.holders = HashIndex(), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of pairs, each of them held by one text."""
        found = self.index.find(mix(codes.astype(np.uint64)))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, inverse = np.unique(codes[missing], return_inverse=True)
            found[missing] = self.index.count + inverse
            self.index.add(mix(new.astype(np.uint64)))
            self.codes = np.concatenate([self.codes, new])
        held = np.bincount(found, minlength=len(self.codes))
        held[: len(self.holders)] += self.holders
        self.holders = held
        return found

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.codes), ROW_PAIRS):
            yield _batch(1, part=[part], first=[at], codes=[self.codes[at : at + ROW_PAIRS]], holders=[self.holders[at : at + ROW_PAIRS]])


_KINDS = pa.schema([
    ("part", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("first", pa.int32()),
    ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())),
])


def _batch(rows: int, **columns) -> pa.RecordBatch:
    arrays = [
        pa.nulls(rows, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type)
        for f in _KINDS
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_KINDS)


def _encode(words: str, pieces: str):
    """A function from documents to their rows and the dictionaries of their pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = aligner(words, pieces), Dictionary()
        part = TaskContext.get().partitionId() << 24
        for batch in slices(batches, "text", TEXT_BYTES):
            groups = own.groups(batch.column("text"))
            text, code, times = groups.pairs(own.factor)
            bounds = np.searchsorted(text, np.arange(groups.texts + 1))
            numbers = known.numbers(code)
            spelled, stops = groups.spelled()
            ends = np.append(0, stops)[np.searchsorted(groups.text, np.arange(groups.texts + 1))].tolist()
            sums = [hashlib.sha256(spelled[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:])]
            yield _batch(
                groups.texts, part=np.full(groups.texts, part), doc_id=batch.column("doc_id"), n_a=groups.n_a, n_b=groups.n_b, n_groups=groups.n_groups,
                n_links=groups.n_links, groups_sha256=sums, pairs=binaries(numbers.astype("<u4"), bounds), times=binaries(times.astype("<i8"), bounds))
            if len(known.codes) >= PAIRS:
                yield from known.rows(part)
                part, known = part + 1, Dictionary()
        yield from known.rows(part)

    return rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each text, from rows sorted by part, those of the dictionary first."""
    part, number, held, best = None, [], [], []
    counts, best_of = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
        for a, b in zip(cuts, [*cuts[1:], len(parts)]):
            piece = batch.slice(a, b - a)
            if parts[a] != part:
                part, number, held, best = parts[a], [], [], []
            words = piece.filter(pc.is_valid(piece.column("number")))
            if words.num_rows:
                for kept, c in ((number, "number"), (held, "count"), (best, "best")):
                    kept.append(words.column(c).to_numpy())
            docs = piece.filter(pc.is_null(piece.column("number")))
            if not docs.num_rows:
                continue
            if number:
                order = np.concatenate(number)
                counts, best_of = (np.zeros(int(order.max()) + 1, dtype=np.int64) for _ in range(2))
                counts[order], best_of[order] = np.concatenate(held), np.concatenate(best)
                number, held, best = [], [], []
            sums, bests = [], []
            for pairs, times in zip(docs.column("pairs"), docs.column("times")):
                at, often = np.frombuffer(pairs.as_buffer(), dtype="<u4"), np.frombuffer(times.as_buffer(), dtype="<i8")
                sums.append(int((counts[at] * often).sum()))
                bests.append(int((best_of[at] * often).sum()))
            yield pa.RecordBatch.from_arrays(
                [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def linked_pairs(encoded: DataFrame, factor: int) -> DataFrame:
    """(part, number, code, holders, a) of all dictionaries."""
    rows = encoded.where(F.col("codes").isNotNull()).select("part", "first", F.posexplode(F.arrays_zip("codes", "holders")).alias("at", "pair"))
    code = F.col("pair.codes")
    return rows.select("part", (F.col("first") + F.col("at")).alias("number"), code.alias("code"), F.col("pair.holders").alias("holders"), F.floor(code / factor).cast("int").alias("a"))


def aligned(docs: DataFrame, words: str, pieces: str) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is the byte-level file ``words``, applied to the text with a space before it, B the SentencePiece model ``pieces``, which adds that
    space itself; strings of special tokens are plain text. ``n_links`` counts pairs of tokens that share a group, ``count_sum`` adds up
    for each of them how many documents hold its pair of ids linked, ``n_best`` counts those whose pair has the most documents
    of all pairs of its A id. Null and empty texts, and texts whose tokens do not spell them (for B a text with U+2581), have no
    tokens: zeros and an empty ``groups_sha256``. Null and repeated ids and repeated rows are documents like any other, texts are never cut,
    an empty table gives an empty result, further columns are ignored.
    """
    import sentencepiece

    factor = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size() + 1
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = in_batches(with_columns(docs, doc_id="bigint", text="string"))
    encoded = scratch.save(rows.mapInArrow(tidy(_encode(words, pieces)), ENCODED), "encoded")
    known = linked_pairs(encoded, factor)
    totals = scratch.save(known.groupBy("code", "a").agg(F.sum("holders").alias("count")), "totals")
    highest = totals.groupBy("a").agg(F.max("count").alias("highest"))
    # One row per id of A at most: a vocabulary of a fixed size.
    rated = totals.join(F.broadcast(highest), "a").select("code", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    found = known.select("part", "number", "code").join(rated, "code").select("part", "number", "count", "best")
    texts = encoded.where(F.col("codes").isNull()).select("part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    both = found.unionByName(texts, allowMissingColumns=True)
    by_part = both.repartition("part").sortWithinPartitions("part", F.col("number").isNull())
    return in_batches(by_part).mapInArrow(tidy(_count), COUNTED)
