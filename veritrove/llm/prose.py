"""Statistics of a document's text, and whether it is prose.

Method: the text's visible tokens are cut into stretches of some ten words. The
distribution of each stretch over function words, other words, numbers, links,
symbols and kinds of punctuation is compared with the prose profile of every
language and with profiles of lists, records, key words and junk by the
Jensen-Shannon divergence; the nearest profile names the stretch. A document is
prose if at least half of its words stand in stretches of prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm.markup import convert
from veritrove.plans.parallel import spread

#: Kinds of events that a distribution is over.
EVENTS = ("function", "word", "number", "link", "symbol", "end", "pause", "mark")
# Shares of the events, by language for prose, else by structure.
PROFILES = {
    "prose_en": (0.340, 0.470, 0.040, 0.000, 0.005, 0.070, 0.060, 0.015),
    "prose_de": (0.360, 0.450, 0.030, 0.000, 0.005, 0.075, 0.075, 0.005),
    "prose_fr": (0.390, 0.430, 0.030, 0.000, 0.010, 0.065, 0.070, 0.005),
    "prose_es": (0.390, 0.430, 0.030, 0.000, 0.005, 0.070, 0.070, 0.005),
    "list": (0.010, 0.820, 0.080, 0.000, 0.040, 0.010, 0.020, 0.020),
    "record": (0.020, 0.340, 0.220, 0.000, 0.060, 0.000, 0.160, 0.200),
    "keywords": (0.020, 0.750, 0.010, 0.080, 0.010, 0.010, 0.100, 0.020),
    "links": (0.010, 0.300, 0.030, 0.600, 0.020, 0.005, 0.015, 0.020),
    "junk": (0.070, 0.330, 0.200, 0.000, 0.200, 0.080, 0.060, 0.060),
}
NAMES = tuple(PROFILES)
_TABLE = np.array([PROFILES[n] for n in NAMES])
_TABLE = _TABLE / _TABLE.sum(1, keepdims=True)
#: Texts whose stretches are compared in one go.
TOGETHER = 500
#: Tokens of a stretch: at least, at most.
SHORT, LONG = 8, 24

_LINK = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)\S|^#[^\W\d_]\w*[,;|]?$|^\S+@\S+\.\w", re.I)
_ITEM = re.compile(r"\s*(?:[-*+•–·»o]|\(?\w{1,3}[.)])\s")
_CORE = re.compile(r"[^\W_]+(?:[-'’._/][^\W_]+)*")
_ELISION = re.compile(r"^(?:l|d|n|s|c|j|m|t|qu|jusqu|lorsqu|puisqu)['’]", re.I)
_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")
_PAUSE = re.compile(r"[,;:،、]+[\"'”’»)\]]*$")


class Signs(dict):
    """What a token is: kind, events and length of its core, packed into an integer.

    Bits 0-2: index of the first five events; 3: ends a sentence; 4: pauses; 5:
    holds a delimiter of records; from 8: length of the core. Looked up once per
    distinct token while it is held.
    """

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        core = _CORE.search(token)
        if core is None:
            kind = 4
        elif _LINK.search(token):
            kind = 3
        elif any(c.isdigit() for c in core[0]):
            kind = 2
        else:
            lower = core[0].lower()
            kind = 0 if lower in self.common or _ELISION.match(lower) else 1
        out = kind | (len(core[0]) << 8 if core else 0)
        if core:
            out |= 8 if _END.search(token) else 16 if _PAUSE.search(token) else 0
        if "|" in token or "{" in token or "}" in token or '":' in token or token.count('"') > 2:
            out |= 32
        self[token] = out
        return out


@dataclass
class Shape:
    """The tokens of a text, their signs, and its stretches with the number of words and the profile of each."""

    tokens: list[str]
    signs: np.ndarray
    words: list[int]
    labels: list[str]
    lines: int
    ended: int


def _stretches(text: str) -> tuple[list[str], list[int], list[bool], int, int]:
    """Tokens, the stretches' starts, which of them are list items, lines, and lines that end in punctuation."""
    tokens: list[str] = []
    starts: list[int] = []
    items: list[bool] = []
    last = 0
    listed = False
    lines = ended = 0

    def close() -> None:
        nonlocal last
        size = len(tokens) - last
        if size:
            parts = max(1, round(size / LONG))
            starts.extend(last + size * p // parts for p in range(parts))
            items.extend([listed] * parts)
            last = len(tokens)

    for line in text.splitlines():
        found = line.split()
        if not found:
            close()
            continue
        lines += 1
        ended += _END.search(found[-1]) is not None
        item = _ITEM.match(line) is not None
        if len(tokens) - last >= SHORT or item:
            close()
        if len(tokens) == last:
            listed = item
        tokens += found
    close()
    return tokens, starts, items, lines, ended


def shapes(texts: list[str], known: Signs) -> list[Shape]:
    """The shape of each text; the stretches of all texts are compared with the profiles at once."""
    cut = [_stretches(t) for t in texts]
    flat = np.fromiter((known[x] for c in cut for x in c[0]), np.int64, sum(len(c[0]) for c in cut))
    ends = np.cumsum([len(c[0]) for c in cut]).tolist()
    starts = np.array([ends[i] - len(c[0]) + a for i, c in enumerate(cut) for a in c[1]], np.int64)
    if not len(starts):
        return [Shape([], flat[:0], [], [], c[3], c[4]) for c in cut]
    events = np.empty((len(flat), len(EVENTS)), np.float32)
    for k in range(5):
        events[:, k] = (flat & 7) == k
    for k in range(3):
        events[:, 5 + k] = (flat >> (3 + k)) & 1
    sums = np.add.reduceat(events, starts, axis=0)
    share = (sums + 0.02) / (sums + 0.02).sum(1, keepdims=True)
    near = divergence(share).argmin(1)
    sizes = np.diff(np.concatenate((starts, [len(flat)])))
    # a stretch of a few words says little by itself and follows its neighbour, unless it is a list's item
    brief = (sizes < 4) & (sums[:, 3] == 0) & ~np.array([x for c in cut for x in c[2]], bool)
    words = sums[:, :4].sum(1).astype(np.int64).tolist()
    labels = [NAMES[i] for i in near.tolist()]
    out, at = [], 0
    for i, (tokens, own, _, lines, ended) in enumerate(cut):
        till = at + len(own)
        for k in range(at + 1, till):
            if brief[k] and labels[k - 1].startswith("prose"):
                labels[k] = labels[k - 1]
        out.append(Shape(tokens, flat[ends[i] - len(tokens) : ends[i]], words[at:till], labels[at:till], lines, ended))
        at = till
    return out


def divergence(share: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of each row from each profile."""
    p, q = share[:, None, :], _TABLE[None, :, :] + 1e-4
    m = (p + q) / 2
    return (p * np.log(np.maximum(p, 1e-12) / m) + q * np.log(q / m)).sum(2) / 2


def visible(text: str) -> str:
    return convert(text)[0].replace("", "").replace("", "")


#: Share of the words in prose from which a document is prose.
HALF = 0.5


_BLANK, _OTHER = re.compile(r"\s+"), re.compile(r"[\W_]+")


def statistics(texts: list[str | None], known: Signs) -> list[dict | None]:
    """The statistics of each text, or None if it is null, empty or blank."""
    there = [i for i, t in enumerate(texts) if t and not t.isspace()]
    out: list[dict | None] = [None] * len(texts)
    for i, s in zip(there, shapes([visible(texts[i]) for i in there], known)):
        by: dict[str, int] = {}
        for label, n in zip(s.labels, s.words):
            by[label] = by.get(label, 0) + n
        words = s.signs[(s.signs & 7) != 4]
        total = len(words)
        solid, letters = len(_BLANK.sub("", texts[i])), len(_OTHER.sub("", texts[i]))
        prose = sum(n for label, n in by.items() if label.startswith("prose"))
        out[i] = {
            "words": total,
            "mean_word_length": float((words >> 8).mean()) if total else 0.0,
            "symbol_ratio": 1 - letters / solid,
            "ended_lines": s.ended / s.lines if s.lines else 0.0,
            "common_words": float((words & 7 == 0).mean()) if total else 0.0,
            "prose_share": prose / total if total else 0.0,
            "profile": max(by, key=lambda x: (by[x], x)) if by else "junk",
        }
    return out


STATISTICS = "doc_id bigint, words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, prose_share double, profile string, prose boolean"


def common_words(words: DataFrame) -> frozenset[str]:
    """The words of a short fixed table; more than 10,000 are refused."""
    listed = [r["word"] for r in words.select("word").where("word is not null").distinct().limit(10_001).collect()]
    if len(listed) > 10_000:
        raise ValueError("the table of common words is not a short list")
    return frozenset(w.lower() for w in listed)


def text_statistics(documents: DataFrame, words: DataFrame) -> DataFrame:
    """The columns of ``STATISTICS`` for every row of ``documents``.

    Null, empty and blank texts have null statistics and a null ``prose``; a
    text of symbols only has 0 words and is not prose. Rows without an id and
    repeated rows stay. Lengths are code points of words without outer
    punctuation; ``symbol_ratio`` is the share of signs that are neither letter
    nor digit among those that aren't blank; lines are those that aren't blank.
    Further columns are ignored; an empty table gives an empty result. No
    shuffle.
    """
    common = common_words(words)
    names = ["words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", "prose_share", "profile"]
    kinds = [pa.int64(), *[pa.float64()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Signs(common)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [x for i in range(0, len(texts), TOGETHER) for x in statistics(texts[i : i + TOGETHER], known)]
            columns = [pa.array([f and f[n] for f in found], k) for n, k in zip(names, kinds)]
            prose = pa.array([None if f is None else f["prose_share"] >= HALF for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, prose], ["doc_id", *names, "prose"])

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, STATISTICS)
