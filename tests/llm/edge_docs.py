"""Documents with every awkward value, and columns whose names clash with those of the operators."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977} lang{i % 31}," for i in range(30_000))
WORDS = "the of and tion ing ble re er on th stupid idiot plain river stone light".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ly", "s,", "."]) + str(rng.randrange(40)) for _ in range(n))


ROWS = [
    (1, prose(1, 60), "a"),
    (2, prose(1, 60), "a"),
    (3, prose(1, 60) + " tail", "b"),
    (4, prose(4, 200), None),
    (4, prose(4, 200), None),
    (5, None, "b"),
    (6, "", "b"),
    (7, " \t\n ", "c"),
    (8, "one", "c"),
    (9, "One", "c"),
    (10, LONG, "a"),
    (11, "  lead  double \n\n tail ", "a"),
    (12, "日本語 テスト 😀😀 é É ﬁ", "a"),
    (13, "<|endoftext|> x <s> </s> ▁ a<|startoftext|>b", "a"),
    (None, prose(9, 30), "a"),
    (None, None, None),
    (14, "a" * 5000, "a"),
    (15, "x\x00y\x1cz\x85w　v", "d"),
]
SCHEMA = "doc_id bigint, text string, source string"
CLASHING = ["n", "part", "ids", "key", "label", "good", "score", "fp", "_n", "_fp", "_key", "_toxicity", "_position", "_bucket", "_id", "base", "_in_block"]


def edge_docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


def no_docs(spark):
    return edge_docs(spark).limit(0)
