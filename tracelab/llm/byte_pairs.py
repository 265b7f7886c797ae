"""Byte-pair encoding of many words at once.

Every round finds the best-ranked pair of each word and merges all its places, for all words together; words without a pair are done.
That equals merging one place at a time if a token is always made before it is merged further, which is checked
when the merges are read.
"""

from __future__ import annotations

import json

import numpy as np

from tracelab.llm.unit_table import HashIndex, ranges
from tracelab.llm.word_hash import mix

NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    return [letters[b] for b in range(256)]


class Merges:
    """Merges of a byte-level tokenizer file; ``ends`` if the last letter of a word carries the file's suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        #: Strings that the tokenizer finds before it cuts words.
        self.added = [t["content"] for t in whole["added_tokens"]]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.byte_id = np.array([vocabulary[x] for x in letters], dtype=np.int64)
        self.last_id = np.array([vocabulary[x + suffix] for x in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        one, two = (np.array([vocabulary[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        made = np.full(max(vocabulary.values()) + 1, -1)
        np.maximum.at(made, self.merged, np.arange(len(pairs)))
        #: Whether all places of a pair may be merged at once.
        self.orderly = bool((np.maximum(made[one], made[two]) < np.arange(len(pairs))).all())
        self.index = HashIndex()
        self.index.add(self._key(one, two))

    @staticmethod
    def _key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return mix((one << 32 | two).astype(np.uint64))  # a bijection: no two pairs share a key

    def ranks(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = self.index.find(self._key(one, two))
        return np.where(found < 0, NO_RANK, found).astype(np.int32)

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words given as joined bytes and lengths; no word is empty."""
        token = self.byte_id[data]
        ends = np.cumsum(lengths)
        token[ends - 1] = self.last_id[data[ends - 1]]
        word, counts = np.arange(len(lengths)), lengths.astype(np.int64)
        rank = np.full(len(token), NO_RANK, dtype=np.int32)
        rank[:-1] = self.ranks(token[:-1], token[1:])
        rank[ends - 1] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(token):
            starts = np.cumsum(counts) - counts
            best = np.minimum.reduceat(rank, starts)
            open_ = best != NO_RANK
            if not open_.all():
                done.append((word[~open_], counts[~open_], token[ranges(starts[~open_], counts[~open_])]))
                at = ranges(starts[open_], counts[open_])
                word, counts, best, token, rank = word[open_], counts[open_], best[open_], token[at], rank[at]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            # Of places that overlap (x x x), the first, third and so on.
            fresh = np.append(True, np.diff(hit) != 1)
            run = np.flatnonzero(fresh)
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            token[hit] = self.merged[rank[hit]]
            gone = np.zeros(len(token), dtype=np.int64)
            gone[hit + 1] = 1
            removed = np.cumsum(gone)
            last = np.cumsum(counts) - 1  # last places of words, before the places shift
            before = np.append(0, removed)
            counts = counts - (before[last + 1] - before[last + 1 - counts])
            kept = gone == 0
            token, rank = token[kept], rank[kept]
            hit = hit - removed[hit]
            last = np.cumsum(counts) - 1
            rank[hit] = self.ranks(token[hit], token[np.minimum(hit + 1, len(token) - 1)])
            previous = hit[hit > 0] - 1
            rank[previous] = self.ranks(token[previous], token[previous + 1])
            rank[last] = NO_RANK
        words, sizes = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        ids, order = np.concatenate([d[2] for d in done]), np.argsort(words)
        starts = np.cumsum(sizes) - sizes
        return ids[ranges(starts[order], sizes[order])].astype(np.uint32), sizes[order]
