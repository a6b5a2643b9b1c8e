import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veritrove.llm import near as N
from veritrove.llm.shingles import shingle_sets
from veritrove.plans.durable import stored


def sets_of(text, words):
    found = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(texts, words, similarity):
    sets = {i + 1: sets_of(t, words) for i, t in enumerate(texts)}
    out = set()
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and similarity <= len(x & y) / len(x | y) < 1:
            out.add((a, b))
    return out


def edited(seed, n):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    while len(out) < n:
        base = pick.choices(words, k=pick.randint(30, 120))
        for _ in range(pick.randint(1, 5)):
            own = list(base)
            for _ in range(pick.randint(0, 4)):
                own[pick.randrange(len(own))] = pick.choice(words)
            out.append(" ".join(own))
        out.append(" ".join(base))
    return out


def pairs(df):
    return {(r["doc_a"], r["doc_b"]) for r in df.collect()}


@pytest.mark.parametrize("words,similarity", [(3, 0.6), (5, 0.8)])
def test_like_brute_force(frame, words, similarity):
    texts = edited(words, 220)
    want = brute(texts, words, similarity)
    assert len(want) > 20
    assert pairs(N.near_pairs(frame(texts), words, similarity)) == want


def test_copies_and_edges(frame):
    base = " ".join(f"word{i}" for i in range(40))
    close = base.replace("word5 ", "other ")
    texts = [base, base.upper(), close, close + "!", None, "", "two words", "!!", base + " İx", "short text here"]
    assert pairs(N.near_pairs(frame(texts), 3, 0.6)) == brute(texts, 3, 0.6)
    assert pairs(N.near_pairs(frame([]), 3, 0.6)) == set()
    links, members = N.near_duplicates(frame(texts), 3, 0.6)
    assert {(r["representative"], r["doc_id"]) for r in members.collect()} >= {(1, 1), (1, 2), (3, 3), (3, 4)}
    assert (1, 3) in {(r["a"], r["b"]) for r in links.collect()}


def test_rows_of_a_repeated_id_all_count(frame):
    x, y = (" ".join(f"{letter}{i}" for i in range(40)) for letter in "xy")
    near = [t.replace("5 ", "5other ", 1) for t in (x, y)]
    got = N.near_pairs(frame([x, y, *near, x, None, near[0].upper()], [1, 1, 2, 3, 1, 2, 1]), 3, 0.6).collect()
    # 1 stands with x twice and with y; its own near copy of x is no pair of 1 with itself
    assert sorted(tuple(r) for r in got) == [(1, 2), (1, 2), (1, 3)]


def test_large_buckets_are_split_and_lose_nothing(frame, monkeypatch):
    # all documents are alike, so no split can part them: levels, then blocks
    pick = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        own = list(base)
        own[pick.randrange(80)] = f"v{pick.randrange(1000)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(N, "LEVELS", 2)
    whole = frame(texts).select("doc_id", "text")
    depth = N.depth_for(60)
    described = stored(whole.mapInArrow(N._describe(3, N.runs_for(0.6, depth), depth, False), N.DESCRIBED))
    got = {(r["a"], r["b"]) for r in N.candidate_pairs(whole, described, 3, 0.6, small=8).collect()}
    assert brute(texts, 3, 0.6) <= got


def test_runs():
    assert N.runs_for(0.6, 3) == 9
    assert N.runs_for(0.9, 3) < N.runs_for(0.6, 3) and N.depth_for(10) == 2 and N.depth_for(10**9) > N.depth_for(10**5)
    assert all(len(set(p)) == 3 for p in N.paths(5, 3)) and len(N.paths(5, 3)) == 20


def test_pairs_at_the_threshold_meet_at_the_depth_of_a_million_documents():
    pick, pairs_made, depth = random.Random(11), 6000, N.depth_for(1_000_000)
    texts = []
    for _ in range(pairs_made):
        words = [f"w{pick.getrandbits(40)}" for _ in range(50)]
        texts += [" ".join(words[:40]), " ".join(words[:30] + words[40:])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    keys = np.concatenate([np.array(b.column(4).to_pylist()) for b in N._describe(1, N.runs_for(0.6, depth), depth, False)([batch])])
    # 3 are expected to be lost; runs that share coordinates lose 40
    assert (~(keys[::2] == keys[1::2]).any(1)).sum() <= 12


def met_keys(texts, runs, depth):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    return np.concatenate([np.array(b.column(4).to_pylist()) for b in N._describe(1, runs, depth, False)([batch])])


def pairs_at(similarity_tenths, n, seed):
    """Pairs of 1-word sets that share exactly so many tenths of their union of 50 words."""
    pick, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{pick.getrandbits(40)}" for _ in range(50)]
        own = (50 - 5 * similarity_tenths) // 2
        out += [" ".join(words[: 50 - own]), " ".join(words[own:])]
    return out


@pytest.mark.parametrize("documents,pairs_made", [(1_000_000, 2000), (100_000_000, 400)])
def test_recall_at_the_depth_of_very_many_documents(documents, pairs_made):
    depth = N.depth_for(documents)
    assert depth == (4 if documents == 1_000_000 else 5)
    keys = met_keys(pairs_at(6, pairs_made, 5), N.whole_runs(0.6, depth), depth)
    assert (~(keys[::2] == keys[1::2]).any(1)).mean() <= 0.005


def test_recall_of_pairs_whose_leaves_are_all_split_again():
    """Every leaf that a pair meets in counts as too large, on each of all levels."""
    depth, n = 4, 1500
    texts = pairs_at(6, n, 9)
    keys = met_keys(texts, N.whole_runs(0.6, depth), depth)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    values = np.concatenate([np.array(b.column(4).to_pylist()) for b in N._describe(1, 0, 0, True)([batch])])
    pair, leaf = np.nonzero(keys[::2] == keys[1::2])
    both = keys[::2][pair, leaf]
    for level in range(N.LEVELS):
        sides = []
        for side in (0, 1):
            flat = pa.array(values[2 * pair + side].astype(np.int64).ravel())
            offsets = pa.array(np.arange(len(pair) + 1, dtype=np.int32) * N.SIGNATURE)
            same = pa.array(np.zeros(len(pair), np.int64))
            rows = pa.RecordBatch.from_arrays([pa.array(both), same, same, same, pa.ListArray.from_arrays(offsets, flat)], ["key", "doc_id", "low", "high", "list"])
            sides.append(np.stack([b.column(0).to_numpy() for b in N._children(level)([rows])]))
        child, at = np.nonzero(sides[0] == sides[1])
        both, pair = sides[0][child, at], pair[at]
        _, first = np.unique(np.stack((pair, both)), axis=1, return_index=True)
        # what matters is that a pair goes on somewhere; a few of its buckets tell that
        order = np.argsort(pair[first], kind="stable")
        both, pair = both[first][order], pair[first][order]
        keep = np.arange(len(pair)) - np.searchsorted(pair, pair) < 40
        both, pair = both[keep], pair[keep]
    lost = n - len(np.unique(pair))
    assert lost / n <= 0.01


def test_hot_buckets_and_hot_sets_give_the_same_pairs(frame, monkeypatch, spark):
    """Half of all documents have one set, and all of the rest are close to it."""
    pick, base = random.Random(6), [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 40
    for i in range(40):
        own = list(base)
        own[pick.randrange(60)] = f"v{i}"
        texts.append(" ".join(own))
    want = brute(texts, 3, 0.6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert pairs(N.near_pairs(frame(texts), 3, 0.6)) == want
        for join in (N.hot_join, N.salted_join):
            monkeypatch.setattr(join, "__defaults__", (3,))
        found = N.near_pairs(frame(texts), 3, 0.6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 4 and "__part" in plan
        assert pairs(found) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_runs():
    for similarity, depth in itertools.product((0.5, 0.6, 0.8, 0.95), (2, 3, 4, 5)):
        runs = N.whole_runs(similarity, depth)
        assert runs >= N.runs_for(similarity, depth) and N.recall_of(similarity, runs, depth) >= N.RECALL
    assert N.whole_runs(1.0, 3) == 1 and N.whole_runs(0.6, 3) == 10
    used = [c for run in range(4) for c in {c for path in N.paths(4, 3)[run * 4 : run * 4 + 4] for c in path}]
    assert len(used) == len(set(used)) == 40 and min(used) == N.SIGNATURE


def test_sets():
    texts = ["A b c d", "a B c, D!", "", None, "a b", "x" * 300_000 + " b c", "ß_é ½ 日本"]
    found = shingle_sets(texts, 3)
    assert found[0].tolist() == found[1].tolist() and [len(f) for f in found] == [2, 2, 0, 0, 0, 1, 2]
