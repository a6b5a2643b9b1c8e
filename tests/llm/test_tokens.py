import bisect
import random

import numpy as np
import pytest

from veritrove.llm import tokens as T
from veritrove.llm.packing import exact_fill, pack_documents, plan_containers

POOL = "aé字 日本語\n\t  'sre123!?…🕵🏽 "


@pytest.fixture
def often_unsafe(monkeypatch):
    monkeypatch.setattr(T, "LONGEST", 64)


def test_repair(often_unsafe):
    encode = T.encoder().encode_ordinary
    pick = random.Random(0)
    texts = ["".join(pick.choices(POOL, k=pick.randint(1, 600))) for _ in range(150)] + ["".join(pick.choices("  \n'strevldm", k=400)) for _ in range(50)] + ["x" * 1000, " " * 500, "don't can't we'll " * 40]
    unsafe = 0
    for text in texts:
        starts, joined = T.cuts(text)
        parts = [np.array(encode(text[a:b])) for a, b in zip(starts, [*starts[1:], len(text)])]
        unsafe += joined.count(False)
        assert T.repair(parts, joined) == encode(text)
    assert unsafe > 500


def test_cuts_depend_on_the_content_only():
    body = " ".join(f"word{i}" for i in range(2000))
    a, b = (T.cuts(prefix + body)[0] for prefix in ("", "something else before "))
    tail = lambda starts, text: {text[s:] for s in starts[3:]}
    assert len(tail(a, body) & tail(b, "something else before " + body)) > len(a) * 0.8


def test_ids(frame):
    texts = ["Hello  world, it's 5 o'clock\r\n", None, "", " ", "<|endoftext|>", "日本語" * 4000, "same passage " * 3000, "same passage " * 3000, "🕵🏽\n\n\nİ"]
    got = {r["doc_id"]: r["ids"] for r in T.token_ids(frame(texts)).collect()}
    encode = T.encoder().encode_ordinary
    assert got == {i: encode(t or "") for i, t in enumerate(texts, start=1)}
    assert T.token_ids(frame([])).count() == 0 and T.token_ids(frame(["x"], [None])).count() == 0


def test_rows_of_a_repeated_id_keep_apart(frame):
    texts = ["one two three", "four five six " * 100, "one two three"]
    encode = T.encoder().encode_ordinary
    encoded = T.token_ids(frame(texts, [1, 1, 1]))
    assert sorted(r["ids"] for r in encoded.collect()) == sorted(map(encode, texts))
    assert sorted(r["text"] for r in T.decoded(encoded).collect()) == sorted(texts)


def test_exact_fill():
    counts = np.zeros(65, np.int64)
    counts[[5, 7, 20]] = 2, 1, 1
    assert exact_fill(counts, 20) == (20,) and exact_fill(counts, 12) == (7, 5) and exact_fill(counts, 10) == (5, 5) and exact_fill(counts, 17) == (7, 5, 5) and exact_fill(counts, 14) == () and exact_fill(counts, 1) == ()


@pytest.mark.parametrize("seed", range(30))
def test_plans_use_every_item_once(seed):
    pick = random.Random(seed)
    capacity = pick.choice([10, 64, 300])
    histogram = {pick.randint(1, capacity): pick.randint(1, 500) for _ in range(pick.randint(1, 40))}
    plan = plan_containers(histogram, capacity)
    used = {}
    for lengths, group in plan:
        assert group > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] = used.get(x, 0) + group
    assert used == histogram
    gaps, plain = [], 0  # best fit, item by item
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        plain += gap == capacity
        bisect.insort(gaps, gap - x)
    assert sum(g for _, g in plan) <= 1.02 * plain + 1


def test_containers(frame, monkeypatch):
    import veritrove.llm.packing as P

    monkeypatch.setattr(P, "BLOCK_ROWS", 7)
    pick = random.Random(2)
    texts = ["word " * pick.randint(0, 60) for _ in range(200)] + [None, "", "word " * 700] + ["same size"] * 100
    rows = pack_documents(frame(texts), 100).collect()
    encode = T.encoder().encode_ordinary
    sizes = {i: len(encode(t or "")) for i, t in enumerate(texts, start=1)}
    held, pieces = {}, {}
    for r in rows:
        held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held))) and len(held) <= -(-sum(sizes.values()) // 100) + 2
    for doc, size in sizes.items():
        own = sorted(pieces[doc])
        assert sum(n for *_, n in own) == size and (len(own) == 1 or size > 100) and [f for _, f, _ in own] == [i * 100 for i in range(len(own))]
    assert pack_documents(frame([]), 100).count() == 0
