import re

import pytest
from pyspark.sql import functions as F

from veritrove.functions import text as T

GROUNDING = set(T.GROUNDING_STOP_WORDS)


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


SPACES = "a\tb c d　e\x1cf g\n\n h \x85 i"


def test_words_split_at_every_white_space(spark):
    values = [SPACES, "", "   ", None, "one"]
    assert column(spark, values, T.words) == [(v or "").split() for v in values]


def test_strip(spark):
    values = ["  x y \n", "", " \t ", "z"]
    assert column(spark, values, T.stripped) == [v.strip() for v in values]
    assert column(spark, values, T.right_stripped) == [v.rstrip() for v in values]


def test_content_tokens(spark):
    values = ["The cat-sat on a MAT, the mat --- 50% of it_", None, "", "of the", "É tude café"]
    want = []
    for v in values:
        seen = dict.fromkeys(t.lower() for t in re.findall(r"[A-Za-z0-9_%-]+", v or "") if len(t) >= 3 and t.lower() not in GROUNDING)
        want.append(list(seen))
    assert column(spark, values, T.content_tokens) == want


def test_sentences(spark):
    values = ["One. Two!  Three?\nFour", " . x", "", None, "No end", "A.B. C"]
    want = [[p.strip() for p in re.split(r"(?<=[.!?])\s+", (v or "").strip()) if p.strip()] for v in values]
    assert column(spark, values, T.sentences) == want


@pytest.mark.parametrize("value", [0.0, 250.0, 0.5, 1e6, 999999.0, 1234567.0, 0.0001, 0.00001234, 12345.678, 3.14159265, 100.0, 1e15])
def test_general_format(spark, value):
    assert spark.range(1).select(T.general_format(F.lit(value)).alias("o")).head()["o"] == f"{value:g}"


def test_word_terms_bridge_removed_words():
    assert T.word_terms("The system must log café errors") == ["log", "café", "errors", "log café", "café errors"]
    assert T.word_terms("") == [] and T.word_terms("the of a") == []


def test_character_terms():
    assert T.character_terms("ab") == [" ab", "ab ", " ab "]
    assert T.character_terms("a") == [" a "]
    assert T.character_terms("abc d") == [" ab", "abc", "bc ", " abc", "abc ", " abc ", " d "]
    assert T.character_terms(" ") == []


def test_stop_words_are_all_there():
    assert len(T.ENGLISH_STOP_WORDS) == 318 and len(T.GROUNDING_STOP_WORDS) == 23
