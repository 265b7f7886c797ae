"""Alignment of two tokenizers against a plain version on sets and dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_docs import ROWS, edge_docs, no_docs, prose

from tracelab.llm import alignment, queries
from tracelab.llm.store import tokenizer_file

WORDS, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(WORDS)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    spelled = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    names = {i: bytes(spelled[c] for c in t) for t, i in one.get_vocab().items() if i != 50256}
    pieces = [two.id_to_piece(i) for i in range(two.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
    return one, two, names, pieces


def plain_groups(text, libraries):
    one, two, names, pieces = libraries
    if not text:
        return []
    whole = (" " + text).encode()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    if b"".join(names[i] for i in a) != whole or b"".join(pieces[i] for i in b) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(names[i]) for i in a]).tolist(), np.cumsum([len(pieces[i]) for i in b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def plain(rows, libraries):
    every = [(i, plain_groups(t, libraries)) for i, t in rows]
    holders = Counter()
    for _, groups in every:
        holders.update({(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in every:
        counts = [(x, holders[x, y]) for a, b in groups for x in a for y in b]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(counts),
            sum(n == best[x] for x, n in counts), sum(n for _, n in counts), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def collected(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=str)


def test_gallop():
    rng = random.Random(2)
    for n, m in [(0, 5), (5, 0), (1, 1), (3000, 200_000), (5000, 5001), (2, 90_000)]:
        one, two = (np.array(sorted(rng.sample(range(300_000), k)), dtype=np.int64) for k in (n, m))
        a, b = alignment.common_ends(one, two)
        assert one[a].tolist() == two[b].tolist() == sorted(set(one.tolist()) & set(two.tolist()))
        b, a = alignment.common_ends(two, one)
        assert one[a].tolist() == two[b].tolist() == sorted(set(one.tolist()) & set(two.tolist()))


def test_query_over_documents(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert collected(queries.QUERIES["op12_token_alignment"](spark, sf_dir)) == plain(docs, libraries)


@pytest.mark.parametrize("pairs, listed, stretch", [(500_000, 1 << 12, 1024), (30, 1, 2)])
def test_awkward_texts(spark, libraries, monkeypatch, pairs, listed, stretch):
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    monkeypatch.setattr(alignment, "LISTED", listed)
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "TEXT_BYTES", 200)
    more = [(100 + i, t) for i, t in enumerate(["  two  spaces ", "tab\tand\nline\n\n", "x" * 4000, "é" * 300, "日本" * 200, "Ж я", "1 22 333 4444", "<unk> <0x41>", prose(3, 80)])]
    docs = edge_docs(spark).select("doc_id", "text", "n", "part", "ids", "key").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    want = plain([(i, t) for i, t, _ in ROWS] + more, libraries)
    assert collected(alignment.aligned(docs.repartition(3), WORDS, PIECES)) == want
    assert sum(r[1] == 0 for r in want) >= 4


def test_no_documents(spark):
    assert alignment.aligned(no_docs(spark), WORDS, PIECES).count() == 0


def test_large_group_is_counted_by_distinct_ids():
    a, b = np.array([5, 6] * 300), np.array([7, 8, 7] * 100)
    groups = alignment.Groups(a, np.array([0, 600]), b, np.array([0, 300]), np.full(10, 1), np.full(10, 2))
    text, code, times = groups.pairs(10)
    assert int(times.sum()) == int(groups.n_links.sum())
    assert set(code.tolist()) <= {57, 58, 67, 68} and text.tolist() == [0] * len(code)
