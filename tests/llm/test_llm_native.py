"""URL templates and Pfair mixing against plain Python."""

import heapq
import random
import re
from collections import Counter, defaultdict

import duckdb
import oracle
import pytest
from edge_docs import edge_docs, no_docs
from pyspark.sql import functions as F

from tracelab.llm import mixing, url_templates
from tracelab.llm.queries import URL_RULES
from tracelab.llm.store import Scratch
from tracelab.llm.url_templates import TemplateTree

URLS = [
    None, "", "no scheme", "https://", "http://EXAMPLE.com/en/1?q=://x#y", "https://www.example.com/en/a.html", "ftp://a.net/es/", "https://a.net/es",
    "https://xnet/es/1", "https://b.org?x", "https://b.org#y", "https://É.org/Ab/C", "s://t://u/v", "https://user@h.com:80/p",
] + [f"https://s{i % 3}.shop.org/item/{i}" for i in range(60)] + [f"https://s0.shop.org/{x}/p{i}.html" for x in "ab" for i in range(20)] + ["https://a.net/fr/" + "x/" * 3000]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]|$", rest).start()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split(r"[?#]", rest[cut:], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def plain_judge(rows, tree, labels=None):
    pages = []
    for i, url in rows:
        host, path = parse(url)
        rule = rule_of(host, path)
        label = labels.get(i) if labels is not None else (None if rule is None else int(rule[1] == "block"))
        pages.append({"id": i, "host": host, "path": path, "rule": rule, "label": label, "segs": [s for s in path.split("/") if s], "t": ""})
    for level in range(tree.depth):
        children = defaultdict(Counter)
        for p in pages:
            if len(p["segs"]) > level:
                c = children[p["host"], p["t"], p["segs"][level]]
                c["n"] += 1
                c["l"] += p["label"] is not None
                c["b"] += p["label"] == 1
        nodes = defaultdict(Counter)
        for (h, t, _), c in children.items():
            nodes[h, t].update(c)
        branch = {}
        for (h, t, s), c in children.items():
            if c["n"] >= tree.support:
                p = nodes[h, t]
                n1, k1, n2, k2 = c["l"], c["b"], p["l"] - c["l"], p["b"] - c["b"]
                apart = False
                if n1 and n2 and k1 * n2 != k2 * n1:
                    pooled = p["b"] / p["l"]
                    apart = (k1 / n1 - k2 / n2) ** 2 >= tree.z**2 * pooled * (1 - pooled) * (1 / n1 + 1 / n2)
                branch[h, t, s] = s if apart or not n1 else "+"
        for p in pages:
            if len(p["segs"]) > level:
                s = p["segs"][level]
                ending = re.search(r"(\.[A-Za-z]{1,5})$", s)
                p["t"] = p["t"] + "/" + branch.get((p["host"], p["t"], s), "*" + (ending[1] if ending else ""))
    stats = defaultdict(Counter)
    for p in pages:
        p["t"] += "/**" * (len(p["segs"]) > tree.depth)
        stats[p["host"], p["t"]].update(l=p["label"] is not None, b=p["label"] == 1)
    out = []
    for p in pages:
        c = stats[p["host"], p["t"]]
        purity = (c["b"] + tree.prior_weight / 2) / (c["l"] + tree.prior_weight)
        verdict = p["rule"][1] if p["rule"] else ("block" if purity >= tree.purity else "allow")
        out.append((p["id"], p["host"], p["path"], p["rule"] and p["rule"][0], verdict, p["t"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tree", [TemplateTree(), TemplateTree(depth=2, support=3, z=1.0, purity=0.5)])
@pytest.mark.parametrize("given", [False, True])
def test_judge_equals_plain_python(spark, tree, given):
    rows = [*enumerate(URLS), (None, URLS[20]), (3, URLS[20])]
    labels = {i: i % 2 for i, _ in rows if i is not None and i % 5 == 0} if given else None
    pages = spark.createDataFrame([(i, u, labels.get(i) if labels else None) for i, u in rows], "page_id bigint, url string, bad int")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "template", "n", "segment", "branch", "rule", "labelled")})
    judged = url_templates.judge(pages, URL_RULES, tree, "bad" if given else None)
    got = judged.select("page_id", "host", "path", "rule", "verdict", "template").collect()
    assert sorted(map(tuple, got), key=str) == plain_judge(rows, tree, labels)


def test_deep_segments_part_pages(spark):
    ext = ["html"] * 4 + ["pdf"] * 3
    few = [f"https://few.org/{'a' if i < 4 else 'b'}/1/2/3/{i}.{e}" for i, e in enumerate(ext)]
    many = [f"https://many.org/a/b/c/d/{'x' if i < 20 else 'y'}/f/{i}.html" for i in range(40)]
    rows = list(enumerate(few + many))
    pages = spark.createDataFrame([(i, u, int("html" in u and "/y/" not in u) if i % 7 != 6 else None) for i, u in rows], "page_id bigint, url string, bad int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_templates.judge(pages, [], TemplateTree(), "bad").collect()}
    assert {got[i] for i in range(4)} == {("/*/*/*/*/*.html", "block")}
    assert {got[i][0] for i in range(4, 7)} == {"/*/*/*/*/*.pdf"} and {got[i][1] for i in range(4, 7)} == {"allow"}
    tails = {got[i] for i in range(7, 27)}, {got[i] for i in range(27, 47)}
    assert [len(x) for x in tails] == [1, 1] and {v for _, v in tails[0]} == {"block"} and {v for _, v in tails[1]} == {"allow"}


def test_nothing_is_blocked_on_no_evidence(spark):
    urls = ["https://bad.com/x", "https://good.org/y", "https://fine.edu/z", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    judged = url_templates.judge(pages, [("block", "bad.com", "/")])
    assert [r["verdict"] for r in judged.orderBy("page_id").collect()] == ["block", "allow", "allow", "allow"]


def test_sql_sees_all_levels(spark):
    rng = random.Random(6)
    hosts, words = ["a.com", "b.example.com", "c.net", "d.org"], ["en", "es", "fr", "it", "x", "y"]
    rows = []
    for i in range(1500):
        path = "/".join(rng.choice(words[: 2 + d % 5] * 6 + [str(i)]) for d in range(rng.randrange(9)))
        rows.append((i, f"https://{rng.choice(hosts)}/{path}" + rng.choice(["", ".html", ".pdf", "/"])))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    judged = url_templates.judge(pages, URL_RULES).drop("template", "purity")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
        assert oracle.compare(judged, con, url_templates.judge_sql(URL_RULES)) is None


def test_no_pages(spark):
    assert url_templates.judge(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).count() == 0


def test_native_plans_hold_no_python(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    for df in (url_templates.judge(pages, URL_RULES), mixing.mix(edge_docs(spark))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("parts", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 7, "b": 1, "c": 1, "d": 1}, {chr(97 + i): 1 + i % 4 for i in range(20)}])
def test_schedule_deviates_by_less_than_one_block(spark, parts):
    table = spark.createDataFrame([("+" + k, v) for k, v in parts.items()], "key string, parts bigint")
    rows = sorted(mixing.schedule(table).collect(), key=lambda r: r["slot"])
    period = sum(parts.values())
    assert [r["slot"] for r in rows] == list(range(period))
    done = Counter()
    for t, r in enumerate(rows, 1):
        assert r["nth"] == done[r["key"]]
        done[r["key"]] += 1
        assert all(abs(done["+" + k] - t * p / period) < 1 for k, p in parts.items())
    assert done == {"+" + k: p for k, p in parts.items()}


def test_mix_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 10 // 5 + (i % 10 > 7)]) for i in range(3000)], "doc_id bigint, source string")
    parts = {"a": 3, "b": 2, "c": 1}
    rows = mixing.mix(docs, spark.createDataFrame(list(parts.items()), "source string, parts int"), block=8).orderBy("_position").collect()
    assert len(rows) == 3000 and len({r["_position"] for r in rows}) == 3000
    sizes = Counter(r["source"] for r in rows)
    slots = {r["_slot"]: r["source"] for r in rows}
    live = min(max(r["_slot"] for r in rows if r["source"] == s) for s in sizes)
    done = Counter()
    for t in range(live):
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * p / 6) < 1 for s, p in parts.items())
    for s in sizes:  # blocks are full but for the last one
        own = Counter(r["_block"] for r in rows if r["source"] == s)
        assert sorted(own) == list(range(len(own))) and all(own[b] == 8 for b in range(len(own) - 1))


def test_mix_keeps_every_row(spark):
    docs = edge_docs(spark)
    mixed = mixing.mix(docs, spark.createDataFrame([("a", 2), ("zzz", 5), ("b", 0)], "source string, parts int"), block=2)
    rows = mixed.collect()
    assert set(mixed.columns) == set(docs.columns) | {"_block", "_slot", "_position"}
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    assert len({r["_position"] for r in rows}) == len(rows)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_too_many_slots_are_refused(spark):
    table = spark.createDataFrame([("+a", mixing.MAX_PERIOD + 1)], "key string, parts bigint")
    with pytest.raises(Exception, match="more than"):
        mixing.schedule(table).collect()


def plain_schedule(parts):
    """Slot of each (key, nth) by a heap of the released blocks, smallest deadline first."""
    period, slots, ready = sum(parts.values()), {}, []
    waiting = sorted((i * period // p, -(-(i + 1) * period // p), k, i) for k, p in parts.items() for i in range(p))[::-1]
    for t in range(period):
        while waiting and waiting[-1][0] <= t:
            heapq.heappush(ready, waiting.pop()[1:])
        deadline, key, nth = heapq.heappop(ready)
        assert t < deadline
        slots[key, nth] = t
    return slots


@pytest.mark.parametrize("parts", [{"+a": 3, "+b": 1}, {f"+{i}": 1 + i * i % 37 for i in range(150)}, {f"+{i}": 1 for i in range(70)}])
def test_schedule_in_rows_is_earliest_deadline_first(spark, parts, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    rows = spark.createDataFrame(list(parts.items()), "key string, parts bigint")
    got = mixing.schedule_rows(rows, sum(parts.values()), Scratch(spark, "schedule")).collect()
    assert {(r["key"], r["nth"]): r["slot"] for r in got} == plain_schedule(parts) and len(got) == sum(parts.values())


def test_mix_takes_periods_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_DOCS", 50)
    parts = {"a": mixing.MAX_PERIOD, "b": 300, "c": 1}
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(900)], "doc_id bigint, source string")
    rows = mixing.mix(docs, spark.createDataFrame(list(parts.items()), "source string, parts int"), block=2).collect()
    slots, period = plain_schedule({"+" + k: v for k, v in parts.items()}), sum(parts.values())
    assert len(rows) == len({r["_position"] for r in rows}) == 900
    for r in rows:
        p = parts[r["source"]]
        assert r["_slot"] == r["_block"] // p * period + slots["+" + r["source"], r["_block"] % p]


def test_weights_are_not_clipped(spark):
    docs = spark.range(25_001).selectExpr("id AS doc_id", "CASE WHEN id < 20000 THEN 'a' WHEN id < 25000 THEN 'b' END AS source")
    assert {tuple(r) for r in mixing.tempered_parts(docs).collect()} == {("a", 141), ("b", 71), (None, 1)}
    mixed = mixing.mix(docs).selectExpr("doc_id", "source", "_block AS block", "_slot AS slot", "_position AS position")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT range AS doc_id, CASE WHEN range < 20000 THEN 'a' WHEN range < 25000 THEN 'b' END AS source FROM range(25001)")
    assert oracle.compare(mixed, con, mixing.mix_sql()) is None
