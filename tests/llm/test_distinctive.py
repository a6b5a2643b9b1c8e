import math
import random
import re
from collections import Counter, defaultdict

import pytest

from veritrove.llm import distinctive as D

SCHEMA = "chunk_id string, doc_id bigint, text string, loaded_at timestamp, term string"


def rows(seed, n=120):
    pick = random.Random(seed)
    words = [f"word{chr(97 + i)}" for i in range(20)] + ["abc", "İstanbul", "STRASSE", "日本語文", "x²abcdé", "the", "one1two2three"]
    return [(f"{i // 3}:{i % 3}", i // 3, " ".join(pick.choices(words, weights=[1 + i for i in range(len(words))], k=pick.randint(0, 30))), None, "clash") for i in range(n)]


def expected(data, least, docs, smoothing=0.75):
    once = {}
    for c, d, t, *_ in data:
        if c is not None and t is not None:
            once.setdefault(c, (d, t))
    counts = {c: Counter(w.lower() for w in re.findall(r"[^\W\d_²]{4,}", t)) for c, (d, t) in once.items()}
    total, where = Counter(), defaultdict(set)
    for c, n in counts.items():
        total.update(n)
        for t in n:
            where[t].add(once[c][0])
    mass = sum(v**smoothing for v in total.values())
    out = {}
    for c, n in counts.items():
        for t, k in n.items():
            if k >= least and docs[0] <= len(where[t]) <= (docs[1] or 10**9):
                out[c, t] = (k, max(0.0, math.log(k * mass / (sum(n.values()) * total[t] ** smoothing))))
    return out


@pytest.mark.parametrize("least,docs,held", [(1, (1, None), 300_000), (1, (38, None), 300_000), (2, (30, None), 10), (1, (0, None), 10), (2, (2, 12), 300_000), (1, (2, 5), 10), (1, (1, None), 10)])
def test_like_brute_force(spark, monkeypatch, least, docs, held):
    monkeypatch.setattr(D, "HELD", held)
    data = rows(held + least)
    got = {(r["chunk_id"], r["term"]): (r["n"], r["score"]) for r in D.distinctive_terms(spark.createDataFrame(data * 2, SCHEMA).repartition(5), least, docs).collect()}
    want = expected(data, least, docs)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)


def test_edges(spark):
    data = [("1:0", 1, "rare rare rare rare common", None, "x"), ("1:0", 1, "rare rare rare rare common", None, "x"), ("2:0", 2, "common rare", None, "x"), ("3:0", None, "common", None, "x"), ("4:0", 4, None, None, "x"), ("5:0", 5, "", None, "x"), (None, 6, "common", None, "x")]
    frame = spark.createDataFrame(data, SCHEMA)
    assert [(r["chunk_id"], r["term"], r["n"]) for r in D.distinctive_terms(frame, 4, (2, 12)).collect()] == [("1:0", "rare", 4)]
    assert D.distinctive_terms(frame.limit(0)).count() == 0
    scores = {(r["chunk_id"], r["term"]): r["score"] for r in D.distinctive_terms(frame).collect()}
    assert scores["1:0", "rare"] > scores["1:0", "common"] and ("2:0", "common") in scores


def test_terms():
    assert D.terms("Ab ABCD efgh_ijkl m0nop qrst") == ["abcd", "efgh", "ijkl", "qrst"]
    assert D.terms("İstanbul ½abcd") == ["i̇stanbul", "abcd"]


def test_a_term_of_all_chunks_is_not_brought_together(spark, monkeypatch):
    data = rows(3)
    frame = spark.createDataFrame(data, SCHEMA)
    want = expected(data, 1, (1, None))
    monkeypatch.setattr(D.hot_join, "__defaults__", (60,))
    monkeypatch.setattr(D, "BROADCAST_TERMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = D.distinctive_terms(frame)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
        got = {(r["chunk_id"], r["term"]): r["score"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k][1], abs_tol=1e-9) for k in want)
