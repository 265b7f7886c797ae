"""Generalised LR parsing of role sequences with weighted edits.

The automaton is the SLR table of a small grammar over role initials. Stacks are nodes of a graph: a node is a state on top of
another node, equal nodes are one, and a left-recursive grammar has finitely many of them, found once.
Reading a row, each stack top branches over the edits (any inserts, then keep, rerole or delete); tops that
fall together keep the smallest (cost, audit).

Audits are not compared as strings. Every top ends with the edit of the same row, so no audit is the beginning of another one,
and the order of two audits is the order of the tops that they come from, then that of the newest edits. Ranks of tops are enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

END = "$"
#: A role sequence: nothing, or perhaps one system row and then user and assistant rows in turn.
ROLES = (("S", ""), ("S", "sT"), ("S", "T"), ("T", "ua"), ("T", "Tua"))
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
MOST_STACKS = 1000


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class RoleGrammar:
    """Productions are (head, body); upper-case letters are heads, all others role initials. ``free`` initials may be inserted or given."""

    def __init__(self, productions: Sequence[tuple[str, str]] = ROLES, free: str = "ua", costs: Costs = Costs()) -> None:
        self.productions = [("", productions[0][0]), *productions]
        self.free, self.costs = free, costs
        self.terminals = sorted({c for _, body in productions for c in body if not c.isupper()})
        self.follow = self._follow()
        self._states()
        self._stacks()
        self.arcs = {(initial, fault): self._arcs(initial, fault) for initial in [*self.terminals, ""] for fault in range(4)}

    def _follow(self) -> dict[str, set[str]]:
        heads = {h for h, _ in self.productions}
        empty: set[str] = set()
        first: dict[str, set[str]] = {h: set() for h in heads} | {t: {t} for t in self.terminals}
        follow: dict[str, set[str]] = {h: set() for h in heads}
        follow[""] = {END}
        for _ in range(len(self.productions) * (len(heads) + 1)):  # more rounds than the sets can grow
            for head, body in self.productions:
                if all(c in empty for c in body):
                    empty.add(head)
                for i, c in enumerate(body):
                    if all(b in empty for b in body[:i]):
                        first[head] |= first[c]
                    if c in follow:
                        for after in body[i + 1 :]:
                            follow[c] |= first[after]
                            if after not in empty:
                                break
                        else:
                            follow[c] |= follow[head]
        return follow

    def _states(self) -> None:
        def closure(items: frozenset[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            found, new = set(items), list(items)
            while new:
                production, dot = new.pop()
                wanted = self.productions[production][1][dot : dot + 1]
                more = {(i, 0) for i, (head, _) in enumerate(self.productions) if head and head == wanted} - found
                found |= more
                new.extend(more)
            return frozenset(found)

        states = [closure(frozenset([(0, 0)]))]
        self.goto: list[dict[str, int]] = []
        for state in states:
            moved: dict[str, set[tuple[int, int]]] = {}
            for production, dot in state:
                if wanted := self.productions[production][1][dot : dot + 1]:
                    moved.setdefault(wanted, set()).add((production, dot + 1))
            targets = {}
            for symbol, items in sorted(moved.items()):
                target = closure(frozenset(items))
                if target not in states:
                    states.append(target)
                targets[symbol] = states.index(target)
            self.goto.append(targets)
        self.reduces = [[p for p, dot in sorted(s) if dot == len(self.productions[p][1])] for s in states]

    def _reduced(self, stack: tuple, ahead: str) -> list[tuple]:
        """The stack and what reductions under the next initial make of it."""
        out, new = [stack], [stack]
        while new:
            state, below = new.pop()
            for production in self.reduces[state]:
                head, body = self.productions[production]
                if head and ahead in self.follow[head]:
                    base = (state, below)
                    for _ in body:
                        base = base[1]
                    made = (self.goto[base[0]][head], base)
                    if made not in out:
                        out.append(made)
                        new.append(made)
        return out

    def _stacks(self) -> None:
        stacks: list[tuple] = [(0, None)]
        self.shifts: list[dict[str, list[int]]] = []
        for stack in stacks:
            moves: dict[str, list[int]] = {}
            for terminal in self.terminals:
                for top in self._reduced(stack, terminal):
                    if terminal in self.goto[top[0]]:
                        made = (self.goto[top[0]][terminal], top)
                        if made not in stacks:
                            stacks.append(made)
                        moves.setdefault(terminal, []).append(stacks.index(made))
            if len([t for t in self.free if t in moves]) > 1 or any(len(m) > 1 for m in moves.values()):
                raise ValueError("an audit would not tell which role a row was given")
            if len(stacks) > MOST_STACKS:
                raise ValueError("the grammar needs stacks of any depth; make it left-recursive")
            self.shifts.append(moves)
        whole = (self.goto[0][self.productions[0][1]], (0, None))
        self.accepts = [whole in self._reduced(stack, END) for stack in stacks]

    @cached_property
    def inserted(self) -> list[list[tuple[int, str]]]:
        """Per stack: the stacks that inserts lead to, with the fewest inserts for each."""
        out = []
        for start in range(len(self.shifts)):
            found, new = {start: ""}, [start]
            while new:
                at = new.pop(0)
                for terminal in self.free:
                    for to in self.shifts[at].get(terminal, ()):
                        if to not in found:
                            found[to] = found[at] + "I" + terminal
                            new.append(to)
            out.append(list(found.items()))
        return out

    def _arcs(self, initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
        """Per stack: (next stack, cost, edits) of reading a row; edits are pairs of an edit's initial and a role's."""
        kept = self.costs.truncated if fault == TRUNCATED else 0
        out = []
        for start in range(len(self.shifts)):
            best: dict[int, tuple[int, str]] = {}

            def offer(to: int, cost: int, edits: str) -> None:
                best[to] = min(best.get(to, (cost, edits)), (cost, edits))

            for at, inserts in self.inserted[start]:
                before = len(inserts) // 2 * self.costs.insert
                offer(at, before + self.costs.delete, inserts + "D.")
                if fault in (BLANK, DUPLICATE):
                    continue
                for to in self.shifts[at].get(initial, ()):
                    offer(to, before + kept, inserts + "K.")
                for role in self.free:
                    for to in self.shifts[at].get(role, ()):
                        offer(to, before + kept + self.costs.rerole, inserts + "R" + role)
            out.append([(to, cost, edits) for to, (cost, edits) in best.items()])
        return out

    def row(self, role: str, fault: int) -> list[list[tuple[int, int, str]]]:
        return self.arcs[role[:1] if role[:1] in self.terminals else "", fault]

    def read(self, rows: Sequence[list[list[tuple[int, int, str]]]], start: int = 0) -> dict[int, tuple[int, int, str]]:
        """Stack tops after some rows from a stack: (cost, rank of the audit among the tops, edits)."""
        tops = {start: (0, 0)}
        back: list[dict[int, tuple[int, str]]] = []
        for arcs in rows:
            best: dict[int, tuple[tuple[int, int, str], int]] = {}
            for at, (cost, rank) in tops.items():
                for to, more, edits in arcs[at]:
                    key = (cost + more, rank, edits)
                    if to not in best or key < best[to][0]:
                        best[to] = key, at
            order = {audit: i for i, audit in enumerate(sorted({key[1:] for key, _ in best.values()}))}
            tops = {to: (key[0], order[key[1:]]) for to, (key, _) in best.items()}
            back.append({to: (at, key[2]) for to, (key, at) in best.items()})
        out = {}
        for end, (cost, rank) in tops.items():
            edits, at = [], end
            for step in reversed(back):
                at, edit = step[at]
                edits.append(edit)
            out[end] = cost, rank, "".join(reversed(edits))
        return out

    def close(self, tops: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
        """(cost, stack, last inserts) of the cheapest way to a whole sequence from stack tops of (cost, rank)."""
        ends = [
            (cost + len(inserts) // 2 * self.costs.insert, rank, inserts, at)
            for at, (cost, rank) in tops.items()
            for to, inserts in self.inserted[at]
            if self.accepts[to]
        ]
        cost, _, inserts, at = min(ends)
        return cost, at, inserts
