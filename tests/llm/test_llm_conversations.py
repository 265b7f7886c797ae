"""Conversation repair against plain searches over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tracelab.llm import conversation_repair, queries
from tracelab.llm.role_grammar import BLANK, DUPLICATE, NONE, TRUNCATED, RoleGrammar

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SENTENCE = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"
#: What follows which role in a sentence, as a plain automaton: nothing, s, u, a.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def every_edit(rows):
    """(cost, audit) of the best of all edits with at most three inserts at a place."""
    found = []
    gaps = [g for n in range(4) for g in product("ua", repeat=n)]

    def go(at, roles, audit, cost):
        if cost > 40 or not any(SENTENCE.fullmatch(roles + tail) for tail in ("", "a", "ua", "uaua")):
            return
        if at == len(rows):
            for gap in gaps:
                if SENTENCE.fullmatch(roles + "".join(gap)):
                    found.append((cost + 5 * len(gap), audit + "I" * len(gap)))
            return
        initial, fault = rows[at]
        for gap in gaps:
            here, before, paid = roles + "".join(gap), audit + "I" * len(gap), cost + 5 * len(gap)
            go(at + 1, here, before + "D", paid + 2)
            if fault in (NONE, TRUNCATED):
                more = 5 * (fault == TRUNCATED)
                go(at + 1, here + initial, before + "K", paid + more)
                for role in "ua":
                    go(at + 1, here + role, before + "R", paid + more + 1)

    go(0, "", "", 0)
    return min(found)


def plain(rows):
    """The same by strings over the plain automaton, and the repaired roles: for rows of (role, fault)."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for role in "ua":
                    if role in NEXT[state]:
                        to, new = NEXT[state][role], (cost + 5, audit + "I", out + ((None, role),))
                        best[to] = min(best.get(to, new), new, key=lambda x: x[:2])
        return best

    best = {0: (0, "", ())}
    for at, (role, fault) in enumerate(rows):
        after = {}
        for state, (cost, audit, out) in inserted(dict(best)).items():
            offers = [(state, (cost + 2, audit + "D", out))]
            if fault in (NONE, TRUNCATED):
                more = cost + 5 * (fault == TRUNCATED)
                if role[:1] and role[0] in NEXT[state]:
                    offers.append((NEXT[state][role[0]], (more, audit + "K", out + ((at, None),))))
                offers += [(NEXT[state][r], (more + 1, audit + "R", out + ((at, r),))) for r in "ua" if r in NEXT[state]]
            for to, new in offers:
                after[to] = min(after.get(to, new), new, key=lambda x: x[:2])
        best = after
    return min((v for s, v in inserted(dict(best)).items() if s in (0, 3)), key=lambda x: x[:2])


def expected(rows):
    """One conversation as the query reports it."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append(BLANK if not body else DUPLICATE if (role, text) in seen else NONE if body[-1] in ".!?" else TRUNCATED)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = plain([(r, f) for (_, r, _), f in zip(rows, faults)])
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names[r] if r else rows[at][1]}:{rows[at][2] if at is not None else ''}" for at, r in out]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got(repaired):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = repaired.report.join(repaired.digests().withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).collect()
    return {r["conv_id"]: (*[r[c] for c in names], r["audit"], r["repaired_sha256"]) for r in rows}


def wild_rows(seed, conversations, rows):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", " "], ["Yes.", "No!", "so", "", " \n", "a b?  ", "z"]
    return [
        (rng.randrange(conversations), rng.choice([None, *range(rows)]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts) + rng.choice(["", str(rng.randrange(30)) + "."]))
        for _ in range(conversations * rows)
    ]


def test_grammar_against_all_edits():
    grammar = RoleGrammar()
    assert len(grammar.shifts) < 12
    kinds = [(i, f) for i in ("s", "u", "a", "t") for f in (NONE, BLANK, TRUNCATED)]
    for n in range(3):
        for rows in product(kinds, repeat=n):
            tops = grammar.read([grammar.row(i, f) for i, f in rows])
            cost, end, closing = grammar.close({at: top[:2] for at, top in tops.items()})
            assert (cost, (tops[end][2] + closing)[::2]) == every_edit(rows) == plain(rows)[:2]


def test_grammar_against_the_plain_automaton():
    grammar, rng = RoleGrammar(), random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("suatu"), rng.randrange(4)) for _ in range(rng.randrange(25))]
        tops = grammar.read([grammar.row(i, f) for i, f in rows])
        cost, end, closing = grammar.close({at: top[:2] for at, top in tops.items()})
        assert (cost, (tops[end][2] + closing)[::2]) == plain(rows)[:2]


def test_grammar_refuses_stacks_of_any_depth():
    with pytest.raises(ValueError):
        RoleGrammar((("S", ""), ("S", "uaS")))


@pytest.mark.parametrize("segment, conversations, rows", [(4096, 40, 9), (3, 6, 40), (5, 1, 200)])
def test_repair_against_plain(spark, monkeypatch, segment, conversations, rows):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    table = wild_rows(segment, conversations, rows) + [(None, 3, "user", "Null id."), (None, None, None, None), (None, 4, "assistant", "x.")]
    frame = spark.createDataFrame(table, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("part", "at", "fault", "edits", "segment")})
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        repaired = conversation_repair.repair(frame)
        by = {}
        for conv_id, turn, role, text in table:
            by.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
        assert got(repaired) == {k: expected(v) for k, v in by.items()}
        if segment == 4096:
            kept = repaired.rows().collect()
            digests = {r["conv_id"]: r["repaired_sha256"] for r in repaired.digests().collect()}
            for conv_id in {r["conv_id"] for r in kept}:
                mine = sorted((r for r in kept if r["conv_id"] == conv_id), key=lambda r: (r["part"], r["segment"], r["at"]))
                assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == digests[conv_id]
                assert SENTENCE.fullmatch("".join(r["role"][:1] for r in mine))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query_over_conversations(spark, sf_dir):
    rows = {}
    for conv_id, turn, role, text in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        fate = zlib.crc32(f"{conv_id}:{turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows.setdefault(conv_id, []).extend([(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    want = {k: expected(v) if v else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for k, v in rows.items()}
    found = queries.QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert {r["conv_id"]: tuple(r)[1:] for r in found.collect()} == want


def test_no_rows(spark):
    repaired = conversation_repair.repair(spark.createDataFrame([], SCHEMA))
    assert repaired.report.count() == repaired.digests().count() == repaired.rows().count() == 0
