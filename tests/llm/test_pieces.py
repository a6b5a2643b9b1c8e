import random

import pytest

from veritrove.llm.pieces import oversized_pieces, split, split_chunks

SCHEMA = "chunk_id string, doc_id bigint, source string, text string, ordinal int, piece string"


def long_text(seed, size):
    pick = random.Random(seed)
    out = ""
    while len(out) < size:
        out += "".join(pick.choices("abcdé日", k=pick.randint(1, 12))) + pick.choice([" ", " ", " ", ". ", "\n", "\n\n", ", "])
    return out.strip()


@pytest.mark.parametrize("limit,overlap", [(1200, 150), (300, 150), (400, 40)])
def test_pieces_cover_the_text(limit, overlap):
    for seed in range(40):
        text = long_text(seed, random.Random(seed).randint(limit + 1, 9 * limit))
        pieces = split(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and len(pieces) > 1
        assert all(0 < b - a <= limit for a, b in pieces)
        for (a, b), (c, d) in zip(pieces, pieces[1:]):
            assert a < c < b < d and overlap - 61 <= b - c <= overlap + 61
            assert text[b].isspace() or text[b - 1].isspace()


def test_boundaries():
    paragraph = "word " * 150
    text = f"{paragraph.strip()}.\n\n{paragraph.strip()}."
    first = split(text)[0]
    assert text[first[0] : first[1]].endswith("word.") and text[first[1] : first[1] + 2] == "\n\n"
    assert split("x" * 1200) == [(0, 1200)]
    solid = split("x" * 5000)
    assert all(b - a <= 1200 for a, b in solid) and solid[-1][1] == 5000
    assert [b - a for a, b in split("é" * 1201)][0] <= 1200


def test_chunks(spark):
    big = long_text(1, 3000)
    rows = [("1:0", 1, "s", "short", 0, "x"), ("1:1", 1, None, f"  {big}\n", 1, "x"), ("1:1", 1, None, f"  {big}\n", 1, "x"), ("1:2", 1, "s", None, 2, "x"), ("2:0", 2, "s", "y" * 1200 + "   ", 0, "x"), (None, None, "s", big, None, "x")]
    chunks = spark.createDataFrame(rows, SCHEMA)
    found = oversized_pieces(chunks).collect()
    assert {r["chunk_id"] for r in found} == {"1:1", None}
    every = [r for r in split_chunks(chunks).collect() if r["doc_id"] == 1]
    assert sorted(r["ordinal"] for r in every) == list(range(len(every)))
    ordered = sorted(every, key=lambda r: r["ordinal"])
    assert ordered[0]["text"] == "short" and ordered[-1]["text"] is None and [r["piece"] for r in ordered[1:-1]] == list(range(len(every) - 2))
    assert all(r["text"] is None or len(r["text"]) <= 1200 for r in every)
    assert split_chunks(chunks.limit(0)).count() == 0


def test_pieces_are_balanced_and_long_texts_take_linear_time():
    pieces = split(" ".join(["word"] * 3000))
    sizes = [b - a for a, b in pieces]
    assert len(pieces) == 15 and max(sizes) - min(sizes) < 30
    import time

    began = time.monotonic()
    assert all(b - a <= 1200 for a, b in split(long_text(1, 2_000_000)))
    assert time.monotonic() - began < 20


def test_starts_snap_to_paragraphs_and_rows():
    text = "\n".join(f"row {i} " + "word " * 8 + "end" for i in range(200))
    assert all(text[a - 1] == "\n" for a, _ in split(text)[1:])


def test_a_document_of_half_of_all_chunks(spark):
    rows = [(f"{d}:{i}", d, "s", f"text {i}", i, "x") for d in (1, 2, 3) for i in range(2500 if d == 1 else 60)]
    found = split_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["ordinal"], r["text"]) for r in found) == sorted((d, i, t) for _, d, _, t, i, _ in rows)
