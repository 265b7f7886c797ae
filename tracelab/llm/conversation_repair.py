"""Repair of conversations by generalised LR parsing with edits, for conversations of any length.

Rows are range-partitioned in the order of their conversations, so that a long one lies in many parts. A *segment* is a run of at most
``SEGMENT`` rows of one conversation in one part. Each is read once from every stack that it may start with, which gives the cheapest
way from each stack to each other one. A conversation chains the tables of its segments, which
hold numbers only (cost and rank of the audit), and the chosen ends select the edits of each segment. Most
conversations are one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.role_grammar import BLANK, DUPLICATE, NONE, TRUNCATED, RoleGrammar
from tracelab.llm.store import Scratch, in_batches, tidy, with_columns

#: Rows of a segment at most.
SEGMENT = 4096
WHITE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
NAMES = {"u": "user", "a": "assistant", "s": "system"}
LEGAL = ("su", "ua", "au")

PLACE = "part int, segment int, at int"
ROWS = f"{PLACE}, conv_id bigint, turn bigint, role string, text string, fault int, signature binary"
SEGMENTS = (
    "part int, segment int, conv_id bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, "
    "turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "ways array<struct<start:int,end:int,cost:bigint,rank:int>>, edits array<string>"
)
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
CHOSEN = "conv_id bigint, part int, segment int, start int, end int, closing string"
CHAINED = f"{REPORT}, part int, segment int, start int, end int, closing string"
REPAIRED = "conv_id bigint, part int, segment int, at int, turn bigint, role string, text string, edit string"
DIGEST = "conv_id bigint, audit string, repaired_sha256 string"


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, signature) in the order of conversations; nulls of role and text are one space.

    Rows of one turn are ordered by role, the first 32 characters and a hash of the text; equal rows may lie in several partitions.
    """
    plain = with_columns(rows, conv_id="bigint", turn="bigint", role="string", text="string")
    plain = plain.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    plain = plain.withColumn("signature", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    plain = plain.withColumn("_copy", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", F.substring("text", 1, 32), "signature", "_copy"]
    return plain.repartitionByRange(*by).sortWithinPartitions(*by).drop("_copy")


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their places and faults, as far as one part shows them; the signature stays where an earlier part may hold a copy."""
    part, segment, at, conversation, seen = TaskContext.get().partitionId(), -1, 0, object(), set()
    for batch in batches:
        conversations = batch.column("conv_id").to_pylist()
        texts, signatures = batch.column("text").to_pylist(), batch.column("signature").to_pylist()
        segments, places, faults, open_ = [], [], [], []
        for conv_id, text, signature in zip(conversations, texts, signatures):
            if segment < 0 or conv_id != conversation:
                segment, at, conversation, seen = segment + 1, 0, conv_id, set()
            elif at == SEGMENT:
                segment, at = segment + 1, 0
            body = text.rstrip(WHITE)
            if not body:
                fault = BLANK
            elif signature in seen:
                fault = DUPLICATE
            else:
                seen.add(signature)
                fault = NONE if body.endswith(STOPS) else TRUNCATED
            open_.append(fault in (NONE, TRUNCATED))
            segments.append(segment)
            places.append(at)
            faults.append(fault)
            at += 1
        yield pa.record_batch({
            "part": pa.array([part] * len(texts), pa.int32()), "segment": pa.array(segments, pa.int32()), "at": pa.array(places, pa.int32()),
            "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"), "text": batch.column("text"),
            "fault": pa.array(faults, pa.int32()),
            "signature": pc.if_else(pa.array(open_), batch.column("signature"), pa.scalar(None, batch.column("signature").type)),
        })


def _segment_rows(grammar: RoleGrammar):
    """A function from slim rows, sorted by place, to one row per segment."""

    def work(rows: list[tuple]) -> dict:
        part, segment, _, conv_id, _, _, _, starts = rows[0]
        initials = [r[5][:1] for r in rows]
        faults, turns = [r[6] for r in rows], [r[4] for r in rows if r[4] is not None]
        arcs = [grammar.row(r[5], r[6]) for r in rows]
        ways, edits = [], []
        for start in [0] if starts else range(len(grammar.shifts)):
            for end, (cost, rank, script) in grammar.read(arcs, start).items():
                ways.append({"start": start, "end": end, "cost": cost, "rank": rank})
                edits.append(script)
        return {
            "part": part, "segment": segment, "conv_id": conv_id, "first_initial": initials[0], "last_initial": initials[-1],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "ways": ways, "edits": edits,
        }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][:2] != row[:2]:
                    out.append(work(held))
                    held = []
                held.append(row)
            yield from packed(out)
        if held:
            yield from packed([work(held)])

    kind = pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("conv_id", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
        ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("ways", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))),
        ("edits", pa.list_(pa.string())),
    ])

    def packed(out: list[dict]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows


def _chain(grammar: RoleGrammar):
    """A function from segments, sorted by conversation and place, to their chosen ways; the first row of a conversation has its report."""

    def finish(conv_id: int | None, places: list[tuple[int, int]], back: list[dict[int, int]], tops: dict[int, tuple[int, int]], sums: dict) -> list[dict]:
        cost, end, closing = grammar.close(tops)
        out = []
        for (part, segment), step in zip(reversed(places), reversed(back)):
            start = step[end]
            out.append({"conv_id": conv_id, "part": part, "segment": segment, "start": start, "end": end, "closing": closing})
            end, closing = start, ""
        gaps = 0 if sums["first"] is None else sums["last"] - sums["first"] + 1 - sums["turns"]
        out[-1] |= {"gaps": gaps, "cost": cost} | {c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        return out

    kind = pa.schema(
        [("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("closing", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        out += finish(*state)
                    sums = {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": None}
                    state = row["conv_id"], [], [], {0: (0, 0)}, sums
                _, places, back, tops, sums = state
                places.append((row["part"], row["segment"]))
                best: dict[int, tuple[tuple[int, int, int], int]] = {}
                for way in row["ways"]:
                    if way["start"] in tops:
                        cost, rank = tops[way["start"]]
                        key = cost + way["cost"], rank, way["rank"]
                        if way["end"] not in best or key < best[way["end"]][0]:
                            best[way["end"]] = key, way["start"]
                order = {audit: i for i, audit in enumerate(sorted({key[1:] for key, _ in best.values()}))}
                back.append({to: at for to, (_, at) in best.items()})
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    sums[c] += row[c]
                if sums["initial"] is not None and sums["initial"] + row["first_initial"] not in LEGAL:
                    sums["illegal"] += 1
                sums["initial"] = row["last_initial"]
                if row["first_turn"] is not None:
                    sums["turns"] += row["turns"] - (row["first_turn"] == sums["last"])
                    sums["first"] = row["first_turn"] if sums["first"] is None else sums["first"]
                    sums["last"] = row["last_turn"]
                state = state[0], places, back, {to: (key[0], order[key[1:]]) for to, (key, _) in best.items()}, sums
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if state:
            yield pa.RecordBatch.from_pylist(finish(*state), schema=kind)

    return rows


class Repair:
    """Repaired conversations of one table: ``report``, ``rows()`` and ``digests()``."""

    def __init__(self, scratch: Scratch, rows: DataFrame, chosen: DataFrame, report: DataFrame) -> None:
        self.scratch, self._rows, self._chosen, self.report = scratch, rows, chosen, report

    def _edited(self, *by: str) -> DataFrame:
        """Rows and, before those of each segment, its edits; partitioned by some columns and in order."""
        edits = self._chosen.select("conv_id", "part", "segment", F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("edits").alias("text"))
        both = self._rows.select("conv_id", "part", "segment", "at", "turn", "role", "text").unionByName(edits)
        return in_batches(both.repartition(*by).sortWithinPartitions("conv_id", "part", "segment", "at"))

    def rows(self) -> DataFrame:
        """Repaired rows: (conv_id, part, segment, at, turn, role, text, edit), in the order of (part, segment, at).

        ``at`` counts the edits of a segment, from 0. Inserted rows have an empty text and the turn of the row before which they
        come (or of the last row, at the end of a conversation). Deleted rows are left out.
        """

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in repaired_batches(batches):
                kept = [r for r in rows if r["edit"] != "D"]
                if kept:
                    yield pa.RecordBatch.from_pylist(kept, schema=_REPAIRED)

        return self._edited("part", "segment").mapInArrow(tidy(work), REPAIRED)

    def digests(self) -> DataFrame:
        """(conv_id, audit, repaired_sha256) per conversation; SHA-256 is sequential, so one task streams a conversation, row by row."""
        return self._edited("conv_id").mapInArrow(tidy(_digests), DIGEST)


_REPAIRED = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("at", pa.int32()), ("turn", pa.int64()),
    ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()),
])


def repaired_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows after repair, those deleted with the edit D, from rows that follow the edits of their segment."""
    edits, place, closing = "", 0, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["at"] < 0:
                edits, place, closing = row["text"], 0, len(row["text"])
                while edits[closing - 2 : closing - 1] == "I":
                    closing -= 2
                continue
            inserted = True
            while inserted or closing <= place < len(edits):
                edit, role = edits[place], edits[place + 1]
                inserted = edit == "I" and place < closing
                given = {"role": NAMES[role]} if edit in "IR" else {}
                out.append(row | {"at": place // 2, "edit": edit} | given | ({"text": ""} if edit == "I" else {}))
                place += 2
        yield out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conversation, audit, digest, empty = object(), [], hashlib.sha256(), True

    def told() -> tuple:
        return conversation, "".join(audit), digest.hexdigest()

    for rows in repaired_batches(batches):
        out = []
        for row in rows:
            if not audit or row["conv_id"] != conversation:
                if audit:
                    out.append(told())
                conversation, audit, digest, empty = row["conv_id"], [], hashlib.sha256(), True
            audit.append(row["edit"])
            if row["edit"] != "D":
                digest.update(f"{'' if empty else chr(10)}{row['role']}:{row['text']}".encode("utf-8", "replace"))
                empty = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])
    if audit:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(told(), (pa.int64(), pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])


def repair(rows: DataFrame, grammar: RoleGrammar | None = None) -> Repair:
    """Cheapest repair of every conversation of (conv_id, turn, role, text) rows.

    The rows of a conversation follow in the order of turns, nulls first, those of one turn by role and text (see
    ``ordered``). A row's fault is the first that applies: blank (no character but ASCII white space), duplicate (role and
    text of an earlier row), truncated (does not end in a full stop, an exclamation or question mark). Blank and duplicate rows are
    deleted; of all edits that make the roles a sentence of the grammar, the cheapest are chosen, of these the ones whose initials are
    least. Null roles and texts are one space, so such rows are blank or of no known role; rows of the null
    conv_id are one conversation; repeated rows are duplicates; texts are never cut; an empty table has no conversation; further
    columns are ignored. ``report`` has one row per conversation with its counts, gaps of turns (turns missing between the
    first and the last) and cost.
    """
    grammar = grammar or RoleGrammar()
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversations")
    placed = scratch.save(in_batches(ordered(rows)).mapInArrow(tidy(_first_pass), ROWS), "rows")
    # Conversations in several parts: fewer than there are parts.
    spans = scratch.save(placed.groupBy("conv_id").agg(F.min("part").alias("first_part"), F.max("part").alias("last_part")).where("first_part < last_part"), "spans")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    spanning = F.broadcast(spans.select(F.col("conv_id").alias("_conv_id"), "first_part"))
    slim = placed.select("part", "segment", "at", "conv_id", "turn", "role", "fault")
    if not spans.isEmpty():
        opened = placed.where(F.col("signature").isNotNull()).join(spanning, same).select("part", "segment", "at", "conv_id", "signature")
        firsts = opened.groupBy("conv_id", "signature").agg(F.min("part").alias("_part")).withColumnsRenamed({"conv_id": "_conv_id", "signature": "_signature"})
        # One row per part and text, so no key is hot.
        late = opened.join(firsts, same & (F.col("signature") == F.col("_signature")) & (F.col("part") > F.col("_part"))).select("part", "segment", "at", F.lit(True).alias("late"))
        slim = slim.join(scratch.save(late, "late"), ["part", "segment", "at"], "left").withColumn("fault", F.when(F.col("late"), F.lit(DUPLICATE)).otherwise(F.col("fault"))).drop("late")
    heads = placed.where("at = 0").groupBy("part", "conv_id").agg(F.min("segment").alias("head"))
    firsts = heads.join(spanning, same, "left").where(F.coalesce(F.col("part") == F.col("first_part"), F.lit(True))).select("part", F.col("head").alias("segment"), F.lit(True).alias("starts"))
    marked = slim.join(firsts, ["part", "segment"], "left").withColumn("starts", F.coalesce("starts", F.lit(False)))
    marked = marked.select("part", "segment", "at", "conv_id", "turn", "role", "fault", "starts")
    by_place = marked.repartition("part", "segment").sortWithinPartitions("part", "segment", "at")
    segments = scratch.save(in_batches(by_place).mapInArrow(tidy(_segment_rows(grammar)), SEGMENTS), "segments")
    scratch.drop("late")

    links = segments.drop("edits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    chained = scratch.save(in_batches(links).mapInArrow(tidy(_chain(grammar)), CHAINED), "chained")
    report = chained.where(F.col("cost").isNotNull()).select(*[c.split()[0] for c in REPORT.split(", ")])
    way = F.filter(F.arrays_zip("ways", "edits"), lambda w: (w["ways"]["start"] == F.col("start")) & (w["ways"]["end"] == F.col("end")))
    chosen = chained.select("conv_id", "part", "segment", "start", "end", "closing").join(segments.select("part", "segment", "ways", "edits"), ["part", "segment"])
    chosen = scratch.save(chosen.select("conv_id", "part", "segment", F.concat(way[0]["edits"], "closing").alias("edits")), "chosen")
    return Repair(scratch, placed, chosen, report)
