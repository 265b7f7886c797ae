"""Jaccard join of documents on word shingles, exact, by partitions of the shingle universe.

Two sets of sizes a and b are linked when 100 |A & B| >= percent |A | B|, that is, when they differ in at
most H = (100 - percent)(a + b) / (100 + percent) shingles. Sizes are cut into bands; a set
takes part in its own band and, as the smaller partner, in the next one. A band has one H, that of its largest sets, and a hash
deals its shingle universe to H + 1 + E segments, so that linked sets agree on at least E + 1 segments.

*Allocation.* Every segment of a set is a key. Keys are ordered by their cost, the number of sets that
hold them (empty segments first), and a set leaves out its E dearest keys. The cheapest key that two linked
sets share is never left out by either, so no link is lost, and passages that many documents share
or empty segments do not make large buckets. (One-deletion neighbourhoods of a segment would cost as many keys as it
has shingles to save one more segment; at these thresholds that is dearer for every band, so the
allocation never chooses them.)

*Verification.* Equal sets are one class. Sets carry a parity sketch; the number of different bits is a lower bound of the
difference of two sets, and pairs above H go no further. First, every block of a bucket gives a spanning forest of the pairs
that the sketches allow, which is compared exactly and contracted. Then only buckets with several components are looked at again, block against block: sets
with an allowed partner in another component go, with their whole shingles, to the task of the bucket, which compares them and
returns only links that join two components. A pair is compared in one bucket, its first common one, as
far as the first keys of both sets tell. So no step makes more rows than members of buckets, whatever the groups are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelab.llm.components import components
from tracelab.llm.store import Scratch, in_batches, tidy, with_columns
from tracelab.llm.word_hash import hashed_words, mix, shingles, text_slices

#: Shingles of a block of a bucket (8 MB), as far as the band tells the size of a set; larger buckets have several blocks.
BLOCK = 1 << 20
#: Keys that a set carries to find the bucket in which a pair is compared.
LOWS = 32
NO_KEY = np.iinfo(np.int64).max
#: Bits a shingle of the sketches that are made where whole sets are at hand.
WIDE = 8
#: Buckets up to this size are compared by whole-array operations.
SMALL = 8
#: Ids that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

SETS = "doc_id bigint, n bigint, fp bigint, band int, spare0 int, spare1 int, sketch binary"
KEYS = "key bigint, fp bigint"
PAIRS = "a bigint, b bigint"


@dataclass(frozen=True)
class Bands:
    """Size bands of a threshold in percent: first size, segments and spare segments of each band."""

    percent: int
    first: np.ndarray
    segments: np.ndarray
    spare: np.ndarray

    @staticmethod
    def of(percent: int, largest: int = 2**40) -> Bands:
        first = [1]
        while first[-1] <= largest:
            first.append(first[-1] * 100 * 100 // (percent * percent) + 1)
        last = np.array(first[1:], dtype=np.int64) - 1
        differ = (100 - percent) * 2 * last // (100 + percent)
        spare = np.where(differ > 0, np.maximum(1, differ // 16), 0)
        return Bands(percent, np.array(first[:-1], dtype=np.int64), np.where(differ > 0, differ + 1 + spare, 0), spare)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, side="right") - 1

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest difference of linked sets of these sizes, -1 where the sizes alone exclude a link."""
        allowed = (100 - self.percent) * (a + b) // (100 + self.percent)
        return np.where(100 * np.minimum(a, b) >= self.percent * np.maximum(a, b), allowed, -1)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def distinct_shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text."""
    hashes, offsets, _, _ = hashed_words(texts)
    runs, bounds = shingles(hashes, offsets, words)
    parts = [distinct(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(parts) if parts else runs), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _wrapped_sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit numbers modulo 2^64 by index; halves stay exact in doubles up to 2^21 numbers."""
    low = np.bincount(index, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    high = np.bincount(index, weights=(values >> np.uint64(32)).astype(np.float64), minlength=size)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit content id of each set."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
    sizes = np.diff(offsets).astype(np.uint64)
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(hashes: np.ndarray, offsets: np.ndarray, wide: int = 1) -> list[bytes]:
    """Parity of the number of shingles that fall on each of 2^j bits, 2^j at least ``wide`` times the size of the set."""
    sizes = np.diff(offsets)
    bits = np.array([max(64, 1 << max(0, wide * int(n) - 1).bit_length()) for n in sizes], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    place = mix(hashes ^ np.uint64(0xA0761D6478BD642F)).astype(np.int64) & np.repeat(bits - 1, sizes)
    parity = np.bincount(np.repeat(base[:-1], sizes) + place, minlength=int(base[-1])) & 1
    packed = np.packbits(parity.astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def segment_keys(hashes: np.ndarray, offsets: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set of each key, unused spare of each set) in the given band of each set (-1: none).

    The lowest bit of a key is the parity of its band. Empty segments count as the dearest keys.
    """
    counts, sizes = np.where(band >= 0, bands.segments[band], 0), np.diff(offsets)
    base = np.concatenate([[0], np.cumsum(counts)])
    own = np.repeat(counts > 0, sizes)
    hashes, of = hashes[own], np.repeat(np.arange(len(sizes)), sizes)[own]
    total = int(base[-1])
    salt = mix((band[of] + 1).astype(np.uint64))
    segment = (mix(hashes ^ salt) % counts[of].astype(np.uint64)).astype(np.int64)
    index = base[of] + segment
    filled = np.bincount(index, minlength=total)
    # Slices hold about 256 KB of text and so fewer than 2^21 shingles, or one longer text.
    sums = _wrapped_sums(index, mix(hashes + np.uint64(0x8EBC6AF09C88C6E3)), total)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = (np.arange(total) - base[owner]).astype(np.uint64)
    at = band[owner].astype(np.uint64)
    keys = mix(sums + mix(number * np.uint64(2) + (at << np.uint64(32))) + filled.astype(np.uint64))
    keys = (keys & ~np.uint64(1)) | (at & np.uint64(1))
    empty = filled == 0
    before = np.concatenate([[0], np.cumsum(empty)])
    rank = before[:-1] - before[base[owner]]  # of an empty segment among those of its set
    spare = np.where(counts > 0, bands.spare[band], 0)
    kept = ~empty | (rank >= spare[owner])
    empties = before[base[1:]] - before[base[:-1]]
    return keys[kept].view(np.int64), owner[kept], np.maximum(0, spare - empties)


def _band_pairs(sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Own band of each set, and the next one if a larger partner can be there; -1 for none."""
    own = bands.band(np.maximum(1, sizes))
    following = np.minimum(own + 1, len(bands.first) - 1)
    reaches = (100 * sizes >= bands.percent * bands.first[following]) & (following > own)
    return np.where(sizes > 0, own, -1), np.where((sizes > 0) & reaches, following, -1)


def set_rows(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(doc_id, n, fp, band, spare0, spare1, sketch) per document; the sketch once per task and content, on a row with an id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches):
            hashes, offsets = distinct_shingles(batch.column("text"), words)
            sizes, prints = np.diff(offsets), fingerprints(hashes, offsets)
            drawn = sketches(hashes, offsets)
            spare = np.zeros((2, len(sizes)), dtype=np.int64)
            for band in _band_pairs(sizes, bands):
                _, _, left = segment_keys(hashes, offsets, band, bands)
                used = band >= 0
                spare[band[used] & 1, np.flatnonzero(used)] = left[used]
            named = batch.column("doc_id").is_valid().to_pylist()
            first = [known and not (p in seen or seen.add(p)) for p, known in zip(prints.tolist(), named)]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes), "fp": pa.array(prints),
                "band": pa.array(bands.band(np.maximum(1, sizes)), pa.int32()),
                "spare0": pa.array(spare[0], pa.int32()), "spare1": pa.array(spare[1], pa.int32()),
                "sketch": pa.array([s if f else None for s, f in zip(drawn, first)], pa.binary()),
            })

    return in_batches(docs).mapInArrow(tidy(rows), SETS)


def key_rows(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(key, fp): the keys of each content, once per task, so that copies are not multiplied."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches):
            hashes, offsets = distinct_shingles(batch.column("text"), words)
            sizes, prints = np.diff(offsets), fingerprints(hashes, offsets)
            first = np.array([not (p in seen or seen.add(p)) for p in prints.tolist()], dtype=bool)
            for band in _band_pairs(np.where(first, sizes, 0), bands):
                keys, owner, _ = segment_keys(hashes, offsets, band, bands)
                yield pa.record_batch({"key": pa.array(keys), "fp": pa.array(prints[owner])})

    return in_batches(docs.where(F.col("doc_id").isNotNull())).mapInArrow(tidy(rows), KEYS)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys held by two contents or more, once each, from rows sorted by (key, fp).

    Only the first content of the current key is held back, whatever the size of its group.
    """
    last_key = last_fp = None
    told = False  # the held-back row is already given out
    for batch in batches:
        keys, prints = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(keys):
            continue
        if last_key is not None:
            keys, prints = np.append(last_key, keys), np.append(last_fp, prints)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
        if last_key is None:
            told = False
        keys, prints = keys[new], prints[new]
        same = keys[1:] == keys[:-1]
        out = np.append(False, same) | np.append(same, False)
        if told and last_key is not None:
            out[0] = False
        last_key, last_fp = keys[-1], prints[-1]
        told = bool(out[-1]) or (told and len(keys) == 1)
        yield pa.record_batch({"key": pa.array(keys[out]), "fp": pa.array(prints[out])})


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) as if drawn with fewer bits."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _matrix(sketch: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), dtype=np.uint8).reshape(len(sketch), -1)


def _differences(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Lower bounds of the differences of pairs of sets."""
    widths = np.array([[len(a), len(b)] for a, b in zip(one, two)]).reshape(-1, 2)
    out = np.zeros(len(one), dtype=np.int64)
    for width in np.unique(widths, axis=0):
        rows = np.flatnonzero((widths == width).all(axis=1))
        least = int(width.min())
        a, b = folded(_matrix([one[i] for i in rows]), least), folded(_matrix([two[i] for i in rows]), least)
        out[rows] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _forest(sizes: np.ndarray, sketch: list[bytes], bands: Bands) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one large bucket that the bound does not exclude, by breadth-first search."""
    near = _nearness(sizes, sketch, bands)
    out: list[tuple[int, int]] = []
    unseen = np.arange(len(sizes))
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            hit = near(at, unseen)
            found = unseen[hit].tolist()
            out.extend((at, two) for two in found)
            queue.extend(found)
            unseen = unseen[~hit]
    return out


def _nearness(sizes: np.ndarray, sketch: list[bytes], bands: Bands):
    """A function from one set and some others to whether the bound allows a link."""
    least = min(map(len, sketch))
    drawn = np.concatenate([folded(_matrix([s]), least) for s in sketch]).view(np.uint64)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(drawn[others] ^ drawn[at]).sum(axis=1, dtype=np.int64)
        return differ <= bands.most(sizes[others], sizes[at])

    return near


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from rows sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # start of the last, perhaps unfinished bucket
        if cut or (held and held[-1].column("bucket")[-1].as_py() != keys[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bucket_pairs(bands: Bands):
    """A function from rows sorted by bucket to candidate pairs of contents."""

    def work(table: pa.Table) -> pa.RecordBatch:
        keys, prints, sizes = (table.column(c).to_numpy() for c in ("bucket", "fp", "n"))
        sketch = table.column("sketch").to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        group = np.repeat(counts, counts)
        one, two = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & (group[step:] <= SMALL)) if len(keys) > step else np.zeros(0, dtype=np.int64)
            one.append(at)
            two.append(at + step)
        a, b = np.concatenate(one), np.concatenate(two)
        most = bands.most(sizes[a], sizes[b])
        a, b, most = a[most >= 0], b[most >= 0], most[most >= 0]
        near = _differences([sketch[i] for i in a], [sketch[i] for i in b]) <= most
        a, b = a[near], b[near]
        large = [
            (start + i, start + j)
            for start, count in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist())
            for i, j in _forest(sizes[start : start + count], sketch[start : start + count], bands)
        ]
        if large:
            more = np.array(large, dtype=np.int64)
            a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
        pairs = np.unique(np.sort(np.column_stack([prints[a], prints[b]]), axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return lambda batches: map(work, _whole_buckets(batches))


def bucket_pairs(members: DataFrame, bands: Bands) -> DataFrame:
    """Distinct (a, b) pairs of contents in a block of a bucket: a spanning forest of those that the bound does not exclude."""
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks"))  # other keys deal the same sets otherwise
    bucket = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", own))
    dealt = members.select(bucket.alias("bucket"), "fp", "n", "sketch")
    # In the order of contents, so that the same near copies hang on the same one in every bucket, and their pairs are few.
    return in_batches(dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")).mapInArrow(tidy(_bucket_pairs(bands)), PAIRS).distinct()


class _Bucket:
    """Members of one bucket whose components differ: which pairs are to be compared here."""

    def __init__(self, table: pa.Table, sketch: list[bytes], bands: Bands) -> None:
        self.key, self.label = table.column("key")[0].as_py(), table.column("label").to_numpy()
        drawn = table.column("lows").to_pylist()
        #: The first keys of each member in ascending order, filled up with the highest number.
        self.lows = np.full((len(drawn), LOWS), NO_KEY, dtype=np.int64)
        for at, keys in enumerate(drawn):
            self.lows[at, : len(keys) // 8] = np.frombuffer(keys, dtype=">i8")
        self.near = _nearness(table.column("n").to_numpy(), sketch, bands)
        names, counts = np.unique(self.label, return_counts=True)
        most = self.label == names[np.argmax(counts)]
        #: Members of the most frequent component need not be compared with each other.
        self.rest, self.main = np.flatnonzero(~most), np.flatnonzero(most)

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        for at, one in enumerate(self.rest.tolist()):
            others = np.concatenate([self.main, self.rest[at + 1 :]])
            others = others[self.label[others] != self.label[one]]
            others = others[self.near(one, others)]
            yield one, others[self.here(one, others)]

    def here(self, one: int, others: np.ndarray) -> np.ndarray:
        """Whether this bucket is the first common one of each pair, or the first keys of the two do not tell."""
        own, theirs = self.lows[one], self.lows[others]
        place = np.minimum(np.searchsorted(own, theirs), LOWS - 1)
        common = (own[place] == theirs) & (theirs != NO_KEY)
        first = theirs[np.arange(len(others)), common.argmax(axis=1)]
        return ~common.any(axis=1) | (first == self.key)


def _suspects(bands: Bands):
    """A function from rows sorted by bucket to the members (bucket, fp) that have a pair to be compared there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            for own in _by_bucket(table):
                bucket = _Bucket(own, own.column("sketch").to_pylist(), bands)
                found = np.zeros(own.num_rows, dtype=bool)
                for one, others in bucket.partners():
                    found[one] |= len(others) > 0
                    found[others] = True
                if found.any():
                    yield from own.filter(pa.array(found)).select(["bucket", "fp"]).combine_chunks().to_batches()

    return rows


def _by_bucket(table: pa.Table) -> Iterator[pa.Table]:
    keys = table.column("bucket").to_numpy()
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield table.slice(a, b - a)


def _joining_links(bands: Bands):
    """A function from rows with whole sets, sorted by bucket, to the links that join two components of a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            one_side, other_side = [], []
            for own in _by_bucket(table):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in own.column("hashes").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                bucket = _Bucket(own, sketches(np.concatenate(sets), offsets, WIDE), bands)
                prints, joined = own.column("fp").to_numpy(), bucket.label.copy()
                for one, others in bucket.partners():
                    for two in others.tolist():
                        if joined[one] == joined[two]:
                            continue
                        common = int(np.isin(sets[one], sets[two], assume_unique=True, kind="sort").sum())
                        if 100 * common >= bands.percent * (len(sets[one]) + len(sets[two]) - common):
                            joined[joined == joined[two]] = joined[one]
                            one_side.append(prints[one])
                            other_side.append(prints[two])
            yield pa.record_batch({"a": pa.array(one_side, pa.int64()), "b": pa.array(other_side, pa.int64())})

    return rows


def dealt_blocks(members: DataFrame) -> DataFrame:
    """(bucket, key, fp, n, sketch, label, lows): members (key, blocks, fp, n, sketch, label) once for each block that theirs meets."""
    lows = members.groupBy("fp").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWS).alias("lows"))
    # Big-endian bytes, to be read as one array.
    lows = lows.select("fp", F.unhex(F.array_join(F.transform("lows", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("lows"))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    met = members.withColumn("meet", F.explode(F.when(F.col("blocks") > 1, meet).otherwise(F.array(F.lit(0)))))
    bucket = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "meet"))
    return met.join(lows, "fp").select(bucket.alias("bucket"), "key", "fp", "n", "sketch", "label", "lows")


def suspect_members(dealt: DataFrame, bands: Bands) -> DataFrame:
    """(bucket, fp) of the members that the sketches allow a link with another component there."""
    in_order = in_batches(dealt.repartition("bucket").sortWithinPartitions("bucket"))
    return in_order.mapInArrow(tidy(_suspects(bands)), "bucket bigint, fp bigint")


def joining_links(dealt: DataFrame, suspects: DataFrame, contents: DataFrame, bands: Bands) -> DataFrame:
    """(a, b) links that join different components, found where whole sets (fp, hashes) meet."""
    shipped = suspects.join(dealt.drop("sketch"), ["bucket", "fp"]).join(contents, "fp")
    return in_batches(shipped.repartition("bucket").sortWithinPartitions("bucket")).mapInArrow(tidy(_joining_links(bands)), PAIRS)


def _compare(bands: Bands):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                one = np.frombuffer(a[i].as_buffer(), dtype=np.uint64)
                two = np.frombuffer(b[i].as_buffer(), dtype=np.uint64)
                place = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int((two[place] == one).sum())
                linked[i] = 100 * common >= bands.percent * (len(one) + len(two) - common)
            mask = pa.array(linked)
            yield pa.record_batch({"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)})

    return rows


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose sets are linked, by comparing the whole sets."""
    one = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("set_a"))
    two = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("set_b"))
    return in_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")).mapInArrow(tidy(_compare(bands)), PAIRS)


def set_table(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, hashes) of the wanted contents, from the text of the smallest document of each."""
    ids = classes.join(wanted, "fp", "left_semi").select(F.col("rep").alias("doc_id"))
    small = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = distinct_shingles(batch.column("text"), words)
            yield pa.record_batch({
                "fp": pa.array(fingerprints(hashes, offsets)),
                "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
            })

    return in_batches(texts.select("text")).mapInArrow(tidy(rows), "fp bigint, hashes binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def _with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    known = pairs.join(one, "a", "left").join(two, "b", "left")
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    return known.where(apart).select("a", "b")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, copies, content, component).

    Documents are linked when 100 * |A & B| >= ``percent`` * |A | B| for their sets of distinct runs of
    ``words`` words (words are runs of characters other than ASCII white space, A-Z lower-cased). A text with fewer words is
    one run; a null or empty text and one without words has an empty set and is linked with nothing.
    ``component_id`` is the smallest id reachable by links, ``copies`` the number of documents with an
    equal set, ``content`` a hash of the set and ``component`` a number of the component (null for an empty set). Repeated
    rows and repeated ids are documents of their own; rows with a null id take part in no link and have a
    null component; an empty table gives an empty result; further columns are ignored.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must be from 50 to 99")
    spark = docs.sparkSession
    scratch, bands = Scratch(spark, "shingle-join"), Bands.of(percent)
    docs = with_columns(docs, doc_id="bigint", text="string")
    sets = scratch.save(set_rows(docs, words, bands), "sets")
    classes = scratch.save(
        sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("fp").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("band").alias("band"),
            F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1"), F.max("sketch").alias("sketch")),
        "classes")

    keys = in_batches(key_rows(docs, words, bands).repartition("key").sortWithinPartitions("key", "fp")).mapInArrow(tidy(_shared), KEYS)
    shared = scratch.save(keys, "shared")
    holders = shared.groupBy("key").agg(F.count(F.lit(1)).alias("holders"))
    members = scratch.save(_without_dearest(shared.join(holders, "key"), classes, bands), "members")
    scratch.drop("shared")

    candidates = scratch.save(bucket_pairs(members, bands), "candidates")
    wanted = scratch.save(candidates.select(F.col("a").alias("fp")).unionByName(candidates.select(F.col("b").alias("fp"))).distinct(), "wanted")
    contents = scratch.save(set_table(docs, classes, wanted, words), "contents")
    first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.save(verified(first, contents, bands), "links-1")
    labels = components(links, scratch, "components-1")

    others = _with_labels(candidates.join(first, ["a", "b"], "left_anti"), labels)
    links = links.unionByName(scratch.save(verified(others, contents, bands), "links-2"))
    labels = components(links, scratch, "components-2")

    # In a bucket of one block, a set without a candidate has no allowed partner.
    apart = members.join(wanted.withColumn("wanted", F.lit(True)), "fp", "left").where((F.col("blocks") > 1) | F.col("wanted")).drop("wanted")
    apart = apart.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = apart.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("key")
    dealt = scratch.save(dealt_blocks(scratch.save(apart.join(mixed, "key", "left_semi"), "apart")), "dealt")
    suspects = scratch.save(suspect_members(dealt, bands), "suspects")
    unread = scratch.save(suspects.select("fp").distinct().join(wanted, "fp", "left_anti"), "unread")
    more = scratch.save(set_table(docs, classes, unread, words), "contents-3")
    links = links.unionByName(scratch.save(joining_links(dealt, suspects, contents.unionByName(more), bands), "links-3"))
    labels = components(links, scratch, "components-3")
    scratch.drop("members", "candidates", "wanted", "contents", "apart", "contents-3", "dealt", "suspects", "unread")

    known = labels.withColumnRenamed("node", "fp").join(classes.select("fp", "rep"), "fp")
    smallest = known.groupBy("label").agg(F.min("rep").alias("smallest"))
    linked = known.join(smallest, "label").select("fp", "label", "smallest")
    classed = classes.select("fp", "rep", "copies").join(linked, "fp", "left")
    result = scratch.save(classed.select("fp", F.coalesce("label", "fp").alias("component"), F.coalesce("smallest", "rep").alias("component_id"), "copies"), "result")
    scratch.drop("links-1", "links-2", "links-3", "classes")
    return sets.select("doc_id", "n", "fp").join(result, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(1)).otherwise(F.coalesce("copies", F.lit(1))).alias("copies"),
        F.col("fp").alias("content"), "component",
    )


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns, one row of each component.

    Of rows that share this id too, one stays. Rows with a null id and rows with an empty set are no copies of
    anything and stay.
    """
    scratch = Scratch(docs.sparkSession, "one-per-component")
    rows = scratch.save(link_components(docs, words, percent), "linked").where(F.col("doc_id").isNotNull())
    linked = rows.where(F.col("n_shingles") > 0)
    names = [f"column{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names)  # no name of the caller's can clash with those below
    key = F.col(own_id).cast("bigint") == F.col("_id")

    def ids(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias("_id")).distinct()
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows

    gone = rows.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("n"))
    gone = scratch.save(gone.where(F.col("gone") | (F.col("n") > 1)), "gone")
    single = plain.join(ids(gone), key, "left_anti")
    doubtful = gone.where(~F.col("gone"))
    if doubtful.isEmpty():
        return single.toDF(*docs.columns)
    # Ids that come more than once: their rows are told apart by content, and one row per component stays.
    rows = with_content(plain.join(ids(doubtful), key, "left_semi").withColumn("text", F.col(own_text).cast("string")), words)
    kept = linked.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), F.col("component").alias("_component")).distinct()
    own = rows.join(kept, key & F.col("_fp").eqNullSafe(F.col("_content")), "left")
    empty = own.where(F.col("_n") == 0).select(*names)
    every = single.unionByName(own.where(F.col("_component").isNotNull()).dropDuplicates(["_component"]).select(*names)).unionByName(empty)
    return every.toDF(*docs.columns)


def with_content(docs: DataFrame, words: int) -> DataFrame:
    """All columns and ``_n`` and ``_fp``, the size and the content id of the set of shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = distinct_shingles(batch.column("text"), words)
            yield batch.append_column("_n", pa.array(np.diff(offsets))).append_column("_fp", pa.array(fingerprints(hashes, offsets)))

    docs = docs.drop("_n", "_fp")
    return in_batches(docs).mapInArrow(tidy(rows), StructType([*docs.schema.fields, StructField("_n", LongType()), StructField("_fp", LongType())]))


def _without_dearest(shared: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """(key, blocks, fp, n, sketch) without the dearest keys of each set, as many as it can spare.

    ``blocks`` follows from the holders of a key and the largest size of its band, so all members agree on it.
    """
    parity = F.col("key").bitwiseAND(F.lit(1))
    spare = F.when(parity == 0, F.col("spare0")).otherwise(F.col("spare1"))
    dearest = Window.partitionBy("fp", "parity").orderBy(F.desc("holders"), "key")
    rows = shared.join(classes.select("fp", "n", "band", "spare0", "spare1", "sketch"), "fp")
    rows = rows.withColumns({"parity": parity, "spare": spare}).withColumn("place", F.row_number().over(dearest))
    largest = F.array(*[F.lit(int(n)) for n in np.append(bands.first[1:], 2**41)])
    band = F.col("band") + F.when(F.col("band") % 2 == F.col("parity"), 0).otherwise(1)
    blocks = F.least("holders", F.ceil(F.col("holders") * F.greatest(F.get(largest, band.cast("int")), F.lit(64)) / BLOCK)).cast("int")
    return rows.where(F.col("place") > F.col("spare")).select("key", blocks.alias("blocks"), "fp", "n", "sketch")
