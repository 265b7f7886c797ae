"""Text expressions: word tokens, common subsequences, ROUGE-L, visible tokens, safe names, specs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Characters that Python counts as white space.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.btrim(text, F.lit(WHITE))


def word_tokens(text: Column) -> Column:
    """Lower-case ASCII words; every other character separates words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two token arrays.

    Bit-parallel form (Hyyro 2004): one integer holds a whole row of the table, so two texts of n
    and m words cost about n * m / 64 word operations. Spark has no such built-in, and an SQL fold
    copies an array per word; hence an Arrow function.
    """

    @F.pandas_udf("int")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        def length(x, y):
            if x is None or y is None:
                return None
            places: dict = {}
            for i, word in enumerate(x):
                places[word] = places.get(word, 0) | (1 << i)
            full = (1 << len(x)) - 1
            row = full
            for word in y:
                hit = row & places.get(word, 0)
                row = ((row + hit) | (row - hit)) & full
            return len(x) - bin(row).count("1")

        return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="Int32")

    return lcs(left, right)


def rouge_l(lcs: Column, candidate_size: Column, reference_size: Column) -> dict[str, Column]:
    """Precision, recall and F1 from the common subsequence length; 0 for empty texts."""
    precision = F.when(candidate_size > 0, lcs / candidate_size).otherwise(F.lit(0.0))
    recall = F.when(reference_size > 0, lcs / reference_size).otherwise(F.lit(0.0))
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / F.when(both > 0, both)).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


# How tokens that cannot be seen are shown.
VISIBLE = {
    " ": "[SPACE]",
    "\n": "[NEWLINE]",
    "\t": "[TAB]",
    "\r": "[CARRIAGE_RETURN]",
    "": "[EMPTY]",
    "<|mdm_mask|>": "[MDM_MASK]",
}


def visible_token(token: Column) -> Column:
    """Named forms of invisible tokens; other all-blank tokens as their escaped spelling in brackets."""
    out = None
    for raw, shown in VISIBLE.items():
        out = F.when(token == raw, shown) if out is None else out.when(token == raw, shown)
    escaped = token
    for raw, spelled in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(spelled))
    blank = strip(token) == ""
    return out.when(blank, F.concat(F.lit("['"), escaped, F.lit("']"))).otherwise(token)


def safe_name(text: Column, max_len: int = 120) -> Column:
    """A file name: reserved characters and blank runs to ``_``, ends trimmed, cut, never empty."""
    name = F.regexp_replace(text, r'[\\/:*?"<>|]+', "_")
    name = F.regexp_replace(name, r"(?U)\s+", "_")
    name = F.regexp_replace(name, r"^[._]+|[._]+$", "")
    return F.substring(F.when(name == "", "untitled").otherwise(name), 1, max_len)


def sample_title(label: Column, question: Column) -> Column:
    """``[Correct]`` or ``[Halluc]`` and the question cut to 40 characters."""
    tag = F.when(label == 0, "Correct").otherwise("Halluc")
    short = F.when(F.length(question) > 40, F.concat(F.substring(question, 1, 40), F.lit("..."))).otherwise(question)
    return F.concat(F.lit("["), tag, F.lit("] "), short)


def spec_options(spec: Column) -> tuple[Column, Column]:
    """Name and option map of ``name[a:b,c:d]`` or ``a=b,c=d``.

    Bracket entries win over outer ones; whole numbers lose their underscores; an entry without a
    colon raises.
    """
    text = strip(spec)
    bracket = F.regexp_extract(text, r"\[(.*?)\]$", 1)
    outer = F.rtrim(F.regexp_replace(text, r"\[.*?\]$", ""))
    entries = F.filter(F.transform(F.split(bracket, ","), strip), lambda e: e != "")

    def pair(e: Column) -> Column:
        value = strip(F.substring_index(F.regexp_replace(e, r"^[^:]*:", "\u0001"), "\u0001", -1))
        number = F.when(value.rlike(r"^\d(?:_?\d)*$"), F.replace(value, F.lit("_"), F.lit(""))).otherwise(value)
        bad = F.raise_error(F.concat(F.lit("expected key:value, found "), e))
        return F.when(F.instr(e, ":") == 0, bad.cast("string")).otherwise(
            F.concat(strip(F.substring_index(e, ":", 1)), F.lit("\u0002"), number)
        )

    has_outer = F.contains(outer, F.lit("="))
    plain = F.filter(F.split(outer, ","), lambda e: F.contains(e, F.lit("=")))
    pairs = F.concat(
        F.when(has_outer, F.transform(plain, lambda e: F.concat(F.substring_index(e, "=", 1), F.lit("\u0002"), F.regexp_replace(e, r"^[^=]*=", "")))).otherwise(F.array().cast("array<string>")),
        F.transform(entries, pair),
    )
    keys = F.transform(pairs, lambda p: F.substring_index(p, "\u0002", 1))
    # The last entry of a key wins.
    distinct = F.array_distinct(keys)
    options = F.map_from_arrays(
        distinct,
        F.transform(
            distinct,
            lambda k: F.substring_index(F.element_at(F.filter(pairs, lambda p: F.substring_index(p, "\u0002", 1) == k), -1), "\u0002", -1),
        ),
    )
    name = F.when(~has_outer & (outer != ""), outer)
    return name, options
