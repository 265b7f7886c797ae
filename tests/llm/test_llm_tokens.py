"""Token operators against the tokenizer libraries, position by position."""

import random
import zlib

import numpy as np
import pytest
from edge_docs import ROWS, edge_docs, no_docs, prose
from pyspark.sql import functions as F

from tracelab.llm import id_files, packing, prefix_counts, unit_table
from tracelab.llm.store import Scratch, tokenizer_file
from tracelab.llm.token_ids import WordIds

TEXTS = [t or "" for _, t, _ in ROWS]
IRREGULAR = ["", " ", "  ", " a", "a ", "a  b", "\n a\t b ", "it's 'S we'll", "x\r\n y\n\nz \n", "é ́a", "ΑΣ Σ ΣΑ", "a.\nB, c!?\nD", "İstanbul ǅ"]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


IRREGULAR += ["\nx", "x\n", "a \nb", "a\n b", "don't   x", "a　 b", "“Hi” — ok… £5 ½ ²", "x<|endoftext|> y <|startoftext|>", "\x85 a \x1c b", "1234 12a34 ÉÈ", "a" * 300 + " b"]
LETTERS = [*"ab cde.,  \n'1é É ñ\t“日<|", "<|endoftext|>", " the "]


@pytest.mark.parametrize("window", [1 << 20, 64])
@pytest.mark.parametrize("name, drops, plain", [("byte_bpe_50k.json", False, False), ("byte_bpe_50k.json", False, True), ("word_bpe_49k.json", True, False)])
def test_word_ids_equal_the_tokenizer(monkeypatch, name, drops, plain, window):
    monkeypatch.setattr(unit_table, "WINDOW", window)
    own, rng = WordIds(tokenizer_file(name), drops, plain=plain), random.Random(window)
    texts = TEXTS + IRREGULAR + [prose(i, 50) + x + prose(i + 1, 5) for i, x in enumerate(IRREGULAR)]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(1000)]
    assert own.merges.orderly
    for text, ids in zip(texts, own.ids(texts)):
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text[:60]


def test_units_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(unit_table, "range_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    own = WordIds(tokenizer_file("byte_bpe_50k.json"), False)
    for text, ids in zip(IRREGULAR, own.ids(IRREGULAR)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.tokenizer.encode(text).ids


def test_many_units_in_the_index():
    index, rng = unit_table.HashIndex(), np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    for part in np.split(hashes, 10):
        index.add(part)
    assert (index.find(hashes) == np.arange(30_000)).all() and (index.find(hashes + np.uint64(1)) == -1).all()
    index.keep(100)
    assert (index.find(hashes) == np.where(np.arange(30_000) < 100, np.arange(30_000), -1)).all()


def test_unit_table_keeps_results_when_it_overflows():
    own = WordIds(tokenizer_file("byte_bpe_50k.json"), False, 20)
    for seed in range(6):
        texts = [prose(seed, 30)] + IRREGULAR
        assert [len(x) // 4 for x in own.ids(texts)] == [len(own.tokenizer.encode(t).ids) for t in texts]


def test_counts_at_every_prefix_equal_the_library(pieces):
    own = prefix_counts.counter(tokenizer_file("piece_bpe_32k.model"))
    for text in [t[:400] for t in TEXTS] + IRREGULAR:
        width, steps = own.text_steps(text)
        got = prefix_counts.decoded(width, steps).tolist()
        assert got == [len(pieces.encode(text[: i + 1])) for i in range(len(text))], text[:60]


def test_prefix_counts_rows(spark, pieces):
    docs = edge_docs(spark)
    counted = prefix_counts.prefix_counts(docs, tokenizer_file("piece_bpe_32k.model"))
    rows = counted.select("doc_id", "n_bytes", "n_chars", "n_tokens").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(i, len((t or "").encode()), len(t or ""), len(pieces.encode(t or ""))) for i, t, _ in ROWS], key=str)
    assert prefix_counts.prefix_counts(no_docs(spark), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_budgets_need_no_second_encoding(spark, pieces):
    text = ROWS[3][1]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    counted = prefix_counts.prefix_counts(docs, tokenizer_file("piece_bpe_32k.model"))
    row = counted.select("doc_id", prefix_counts.chars_within(F.lit(50)).alias("cut"), prefix_counts.tokens_at(F.lit(100)).alias("at")).orderBy("doc_id").collect()
    counts = [len(pieces.encode(text[: i + 1])) for i in range(len(text))]
    assert row[0]["cut"] == max(i + 1 for i, c in enumerate(counts) if c <= 50) and row[0]["at"] == counts[99]
    assert row[1]["cut"] == 0 and row[1]["at"] == 0


def expected_ids(name, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for i, t, _ in ROWS]


@pytest.mark.parametrize("order", [None, ["source", "doc_id"]])
def test_packing_round_trip(spark, order):
    docs = edge_docs(spark).repartition(5)
    rows = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, length=64, order=order, with_ids=True).collect()
    want = expected_ids("byte_bpe_50k.json", 1)
    total = sum(len(ids) for _, ids in want)
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:  # gapless, in windows of 64
        assert r["sequence_id"] * 64 + r["offset"] == at and r["offset"] + r["length"] <= 64
        assert len(r["ids"]) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["length"]
    assert at == total
    joined, whole = [], []
    for r in stream:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        if r["start"] == 0:
            whole = []
        assert r["start"] == len(whole)
        whole = whole + ids
        if len(whole) == r["doc_tokens"]:
            joined.append((r["doc_id"], whole))
    assert sorted(joined, key=str) == sorted(want, key=str)
    if order:
        sources = {i: s for i, _, s in ROWS if i is not None}
        seen = [sources[i] for i, _ in joined if i is not None]
        assert seen == sorted(seen, key=lambda s: (s is not None, s or ""))
    assert packing.pack(no_docs(spark), tokenizer_file("byte_bpe_50k.json"), 1).count() == 0


def test_id_files_round_trip(spark):
    folder = Scratch(spark, "test-ids").folder
    id_files.write_ids(edge_docs(spark), folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    want = expected_ids("word_bpe_49k.json", 2)
    stored = id_files.with_starts(id_files.read_rows(spark, folder), folder).orderBy("start").collect()
    assert sorted([(r["doc_id"], r["ids"]) for r in stored], key=str) == sorted(want, key=str)
    assert [r["start"] for r in stored] == np.cumsum([0] + [r["n_tokens"] for r in stored])[:-1].tolist()
    ids = [r["doc_id"] for r in stored]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    digest = {(r["start"], r["ids_crc32"]) for r in id_files.digests(spark, folder).collect()}
    assert digest == {(r["start"], zlib.crc32(np.asarray(r["ids"], dtype="<u4").tobytes())) for r in stored}
    one = id_files.read_rows(spark, folder).where("doc_id = 12")
    assert "EqualTo(doc_id,12)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    empty = Scratch(spark, "test-ids").folder
    id_files.write_ids(no_docs(spark), empty, tokenizer_file("word_bpe_49k.json"), end_id=2)
    assert id_files.digests(spark, empty).count() == 0
