"""Jaccard join, toxic passages and importance resampling against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge_docs import ROWS, edge_docs, no_docs, prose
from pyspark.sql import functions as F

from tracelab.llm import importance, shingle_join, toxic_passages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_components(rows, k, percent):
    """Component of each row (a list position), null ids and empty sets alone."""
    sets = [plain_set(t, k) if i is not None else frozenset() for i, t in rows]
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    holders = defaultdict(list)
    for at, own in enumerate(sets):
        for x in own:
            holders[x].append(at)
    common = Counter((a, b) for own in holders.values() for a in own for b in own if a < b)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            label[root(a)] = root(b)
    return [root(a) for a in range(len(rows))]


def plain_links(rows, k, percent):
    roots = plain_components(rows, k, percent)
    smallest = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return sorted([(i, len(plain_set(t, k)), None if i is None else smallest[r]) for (i, t), r in zip(rows, roots)], key=str)


def near_copies(seed):
    """Chains and groups of copies of several distances, a passage in many documents, some loners."""
    rng = random.Random(seed)
    rows, at = [], 100
    passage = prose(900 + seed, 80)
    for base in range(25):
        words = prose(1000 * seed + base, rng.choice([3, 5, 12, 40, 150, 600])).split()
        for copy in range(rng.choice([1, 2, 3, 14, 30])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            text = " ".join(own)
            if base % 5 == 0 and copy % 2:
                text = text.upper() + "\n\n"
            rows.append((at, text))
            at += 1
    rows += [(at + i, passage + " " + prose(5000 + 50 * seed + i, 10 + 7 * i)) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words, percent, block", [(1, 4, 85, 1 << 20), (2, 5, 80, 4096), (3, 5, 80, 600)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, words, percent, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rows = near_copies(seed) + [(i, t) for i, t, _ in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("n", "fp", "key", "label", "sketch")})
    linked = shingle_join.link_components(docs.repartition(3), words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, linked), key=str) == plain_links(rows, words, percent)


def test_null_id_before_copies_and_a_near_copy(spark):
    text = prose(31, 120)
    rows = [(None, text), (2, text), (1, text), (3, text + " tail"), (None, text + " tail")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    linked = shingle_join.link_components(docs, 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, linked), key=str) == plain_links(rows, 5, 80)
    assert sorted(r["component_id"] for r in linked if r["doc_id"]) == [1, 1, 1]


@pytest.mark.parametrize("block, lows", [(1 << 20, 32), (3000, 2)])
def test_group_around_the_threshold(spark, monkeypatch, block, lows):
    """Every pair shares keys, few are linked: links leave the buckets, not pairs."""
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    monkeypatch.setattr(shingle_join, "LOWS", lows)
    rng, words, rows = random.Random(8), prose(77, 300).split(), []
    for i in range(70):
        own = list(words)
        for _ in range(rng.choice([2, 3, 4, 5, 6, 7])):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    made = []
    plain_joining = shingle_join.joining_links
    monkeypatch.setattr(shingle_join, "joining_links", lambda dealt, *rest: made.append((dealt.count(), plain_joining(dealt, *rest).count())) or plain_joining(dealt, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    linked = shingle_join.link_components(docs.repartition(3), 5, 90).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_links(rows, 5, 90)
    assert sorted(map(tuple, linked), key=str) == want and 1 < len({c for _, _, c in want}) < 70
    assert made[0][1] <= made[0][0]


def test_repeated_id_with_an_empty_text_stays(spark):
    text = prose(41, 100)
    rows = [(1, text), (2, text + " tail"), (2, ""), (3, "something else"), (3, None), (4, text)]
    kept = shingle_join.one_per_component(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text), (2, ""), (3, "something else"), (3, None)], key=str)


def test_no_documents_no_links(spark):
    assert shingle_join.link_components(no_docs(spark)).count() == 0
    assert shingle_join.one_per_component(no_docs(spark)).count() == 0


def test_one_document_of_each_component_stays(spark):
    docs = edge_docs(spark).unionByName(
        spark.createDataFrame([(i, t, "z") for i, t in near_copies(4)], "doc_id bigint, text string, source string").withColumns(
            {c: F.lit("clash") for c in edge_docs(spark).columns[3:]}))
    kept = shingle_join.one_per_component(docs, 5, 80)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    roots = plain_components(rows, 5, 80)
    first = {}
    for (i, t), r in zip(rows, roots):
        first[r] = min((i, t), first.get(r, (i, t)), key=lambda x: (x[0] is not None, x[0] or 0))
    want = Counter(i for i, _ in first.values())
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def recursive_segments(scores, offset=0):
    """Maximal scoring segments by their definition: the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return recursive_segments(scores[:a], offset) + [(offset + a, offset + b, best)] + recursive_segments(scores[b:], offset + b)


@pytest.mark.parametrize("seed", range(20))
def test_segments_are_the_maximal_ones(seed):
    rng = np.random.default_rng(seed)
    n, penalty = 40, 0.25
    own = np.sort(rng.choice(n, 18, replace=False))
    scores = rng.normal(0.2, 1.5, len(own))
    dense = np.full(n, -penalty)
    dense[own] = scores
    got = toxic_passages.maximal_segments(own, scores, penalty)
    want = recursive_segments(dense.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def toxic_corpus(spark):
    rng = random.Random(6)
    bad = ["scum", "vermin", "moron", "filth"]
    rows, labels = [], []
    for i in range(600):
        words = prose(7000 + i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(40)
            words[at : at + 12] = [rng.choice(bad) for _ in range(12)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_passages_are_found_where_they_are(spark):
    docs, labels = toxic_corpus(spark)
    model = toxic_passages.train(docs, labels.where("doc_id % 3 != 0"))
    rows = toxic_passages.score(docs, model).join(docs, "doc_id").join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)
    assert right >= 0.97 * len(rows)
    for r in rows:
        if r["toxic"]:
            data = r["text"].encode()
            found = b" ".join(data[p["start"] : p["end"]] for p in r["passages"]).split()
            assert sum(w in (b"scum", b"vermin", b"moron", b"filth") for w in found) >= 10


def test_scores_of_awkward_rows(spark):
    docs, labels = toxic_corpus(spark)
    model = toxic_passages.train(docs, labels)
    rows = toxic_passages.score(edge_docs(spark), model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in ROWS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = {r["score"] for r in rows if r["doc_id"] in (5, 6, 7)}
    assert len(none) == 1 and none.pop() < 0.5
    assert toxic_passages.score(no_docs(spark), model).count() == 0
    with_score = toxic_passages.with_score(edge_docs(spark), model)
    assert sorted(with_score.columns) == sorted(edge_docs(spark).columns)
    got = sorted([(r["doc_id"], r["_toxicity"]) for r in with_score.collect()], key=str)
    assert got == sorted([(r["doc_id"], r["score"]) for r in rows], key=str)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(None, 1), (3, None)]])
def test_toxicity_without_both_labels(spark, labels):
    model = toxic_passages.train(edge_docs(spark), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert all(r["score"] < 0.5 for r in toxic_passages.score(edge_docs(spark), model).collect())


@pytest.mark.parametrize("n, k", [(0, 3), (10, 0), (10, 10), (10, 40), (5000, 1), (5000, 1234), (5000, 4999)])
def test_kth_largest(spark, n, k):
    rng = random.Random(n + k)
    values = [rng.gauss(0, 1) if rng.random() < 0.7 else float(rng.randrange(3)) for _ in range(n)]
    rows = spark.createDataFrame([(v,) for v in values], "key double")
    got = importance.kth_largest(rows, "key", k, bins=7, most=50)
    assert got == (float("inf") if not k or not n else sorted(values, reverse=True)[min(k, n) - 1])


def test_resampling_equals_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, 20 + i % 30) if i % 3 else " ".join(rng.choice(["junk", "spam", "click", "here"]) for _ in range(25))) for i in range(400)]
    rows += [(i, t) for i, t, _ in ROWS if i is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    setting = importance.Resampling(bits=12)
    got = {(r["doc_id"], round(r["log_weight"], 6)): r for r in importance.resample(docs, labels, setting=setting).collect()}
    unseen = {r["id"] for r in spark.range(400).where(F.pmod(F.xxhash64("id", F.lit(setting.seed + 1)), F.lit(3)) == 0).collect()}
    raw, target, grams = np.zeros(1 << 12), np.zeros(1 << 12), []
    for i, text in rows:
        own = np.concatenate([b for b, _ in importance._buckets(pa.array([text], pa.string()), 12)])
        grams.append(own)
        np.add.at(raw, own, 1)
        if i < 300 and i % 3 and i not in unseen:
            np.add.at(target, own, 1)
    ratios = np.log((target + setting.smoothing) / (raw * target.sum() / raw.sum() + setting.smoothing))
    weights = [float(ratios[own].sum()) for own in grams]
    assert {(i, round(w, 6)) for (i, _), w in zip(rows, weights)} == set(got)
    assert all(w == 0 for (_, t), w in zip(rows, weights) if not (t or "").strip())
    order = sorted(got.values(), key=lambda r: -r["key"])
    kept = [r["kept"] for r in order]
    assert kept == sorted(kept, reverse=True) and 0 < sum(kept) < len(kept)
    test = [r for r in got.values() if r["doc_id"] in unseen and r["doc_id"] < 300]
    right = sum(r["kept"] == (r["doc_id"] % 3 > 0) for r in test)
    assert right >= 0.95 * len(test)


def test_resampling_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (2, 0), (10, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    rows = importance.resample(edge_docs(spark), labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in ROWS)
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert all(r["kept"] for r in importance.resample(edge_docs(spark), none).collect())
    assert importance.resample(no_docs(spark), labels).count() == 0
    half = importance.resample(edge_docs(spark), labels, keep=0.5).collect()
    assert sum(r["kept"] for r in half) >= len(ROWS) // 2
    fitted = importance.fit(edge_docs(spark), labels)
    keyed = importance.with_keys(edge_docs(spark), fitted)
    assert set(keyed.columns) == set(edge_docs(spark).columns) | {"_log_weight", "_key", "_kept"}
    assert keyed.count() == len(ROWS)
