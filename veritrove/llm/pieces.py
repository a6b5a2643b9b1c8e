"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: balanced targets. The least number of pieces that the limit allows gives
pieces of equal length; each target is snapped to the strongest boundary nearby
(paragraph, row, sentence, clause, word). What is left after a piece is balanced
anew, with a piece more where those planned would break the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.operators.ranking import grouped_rank
from veritrove.plans.durable import stored
from veritrove.plans.parallel import spread

LIMIT, OVERLAP = 1200, 150
#: How far from its target a cut may lie, as a share of the limit; how far an overlap may deviate.
REACH, LEEWAY = 0.2, 60
#: Ordinals of one document that are numbered in one task.
BLOCK = 1000
BLANKS = " \t\r\n"

#: Boundaries from strong to weak; a piece ends where the match starts, the next text where it ends.
_BOUNDARIES = tuple(map(re.compile, (r"(?<=\S)\s*\n\s*\n\s*(?=\S)", r"(?<=\S)[^\S\n]*\n\s*(?=\S)", r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+(?=\S)", r"(?<=[;:,|])\s+(?=\S)", r"(?<=\S)\s+(?=\S)")))


def _marks(text: str) -> list[tuple[list[int], list[int]]]:
    out = []
    for pattern in _BOUNDARIES:
        found = [(m.end() - len(m[0].lstrip("\"'”’»)]")), m.end()) for m in pattern.finditer(text)]
        out.append(([a for a, _ in found], [b for _, b in found]))
    return out


def _snap(places: list[list[int]], low: int, target: int, high: int) -> int | None:
    """The nearest place of the strongest kind that has one from ``low`` to ``high``."""
    for at in places:
        first, last = bisect_left(at, low), bisect_right(at, high)
        if first < last:
            right = min(max(bisect_left(at, target), first), last - 1)
            left = max(right - 1, first)
            return min(at[left], at[right], key=lambda x: (abs(x - target), x))
    return None


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the pieces of ``text``; one piece if it is within the limit.

    Every code point but blanks at a cut lies in a piece, no piece is longer than
    ``limit``, and neighbours share about ``overlap`` code points. A word longer
    than the reach of a cut is cut inside.
    """
    size = len(text)
    if size <= limit:
        return [(0, size)]
    marks = _marks(text)
    ends, starts = [m[0] for m in marks], [m[1] for m in marks]
    reach, leeway = int(limit * REACH), min(LEEWAY, overlap // 2)
    pieces, start = [], 0
    left = -(-(size - overlap) // (limit - overlap))
    while True:
        # pieces of equal length for what is left; one more if the cuts so far have left too much
        even = (size - start + (left - 1) * overlap) / left
        while even > limit:
            left += 1
            even = (size - start + (left - 1) * overlap) / left
        if left == 1:
            return [*pieces, (start, size)]
        target = round(start + even)
        high = min(start + limit, size - 1)
        low = min(start + overlap + leeway + 1, high)
        end = _snap(ends, max(low, target - reach), target, min(target + reach, high))
        if end is None:  # no boundary near the target: any that the limit allows, else a cut inside a word
            end = _snap(ends, low, target, high)
        if end is None:
            end = min(max(target, low), high)
        pieces.append((start, end))
        wanted = end - overlap
        # the next piece starts with a paragraph, row or sentence if one is near, else with a word
        begin = _snap([starts[0], starts[1], starts[2], starts[4]], max(start + 1, wanted - leeway), wanted, wanted + leeway)
        start = wanted if begin is None else begin
        left = max(1, left - 1)


CUTS = "array<struct<piece:int,start:int,end:int>>"


def _cut(limit: int, overlap: int):
    @F.pandas_udf(CUTS)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"piece": i, "start": a, "end": b} for i, (a, b) in enumerate(split(t, limit, overlap))] for t in texts])

    return cut


def _piece(text: str, cut: str):
    return F.substring(text, F.col(f"{cut}.start") + 1, F.col(f"{cut}.end") - F.col(f"{cut}.start"))


def _clean(chunks: DataFrame) -> DataFrame:
    """The chunks without outer blanks, and ``digest``, 128 bits that stand for the text where rows are compared."""
    text = F.btrim(F.col("text").cast("string"), F.lit(BLANKS))
    return chunks.select("chunk_id", "doc_id", "source", F.col("ordinal").alias("ordinal"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def oversized_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all chunks whose text, without outer blanks, is longer than ``limit``.

    Columns ``chunk_id``, ``doc_id``, ``source``, ``ordinal`` (the chunk's),
    ``piece`` from 0, ``start``, ``end`` (in the stripped text), ``text``. Rows
    that stand twice are one (same ``chunk_id``, ``doc_id``, ``ordinal`` and
    text), with the smallest source; null texts are not oversized; a null
    ``chunk_id`` stays. Further columns are ignored; an empty table gives an
    empty result.

    Only oversized texts leave the JVM or are shuffled.
    """
    long = _clean(chunks).where(F.length("text") > limit)
    once = long.groupBy("chunk_id", "doc_id", "ordinal", "digest").agg(F.min("source").alias("source"), F.min("text").alias("text"))
    cut = once.select("chunk_id", "doc_id", "source", "ordinal", "text", F.explode(_cut(limit, overlap)("text")).alias("p"))
    return cut.select("chunk_id", "doc_id", "source", "ordinal", "p.piece", "p.start", "p.end", _piece("text", "p").alias("text"))


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All chunks, the oversized ones as pieces, with a new ``ordinal`` from 0 within each ``doc_id``.

    Columns ``chunk_id``, ``doc_id``, ``source``, ``piece``, ``text``,
    ``old_ordinal``, ``ordinal``. The order is that of the old ordinals, then
    ``chunk_id``, the text's digest and piece, nulls first. Rows that stand twice
    are one; null texts stay as a row with null text. A document of any number
    of chunks is numbered in blocks of ``BLOCK`` old ordinals.

    Rows are compared and numbered by ids and digests; texts are only brought to
    their numbers, by a row's own id.
    """
    size = F.length("text")
    rows = stored(spread(_clean(chunks)).withColumn("row", F.monotonically_increasing_id()).withColumn("long", F.coalesce(size > limit, F.lit(False))))
    once = rows.groupBy("chunk_id", "doc_id", "ordinal", "digest").agg(F.min("source").alias("source"), F.min("row").alias("row"), F.first("long").alias("long"))
    kept = stored(once)
    whole = kept.where("not long").select("row", "chunk_id", "doc_id", "ordinal", "digest", "source", F.lit(0).alias("piece"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    cuts = rows.where("long").select("row", F.explode(_cut(limit, overlap)("text")).alias("p"))
    parts = kept.where("long").join(cuts, "row").select("row", "chunk_id", "doc_id", "ordinal", "digest", "source", "p.piece", "p.start", "p.end")
    order = [F.col(c).asc_nulls_first() for c in ("ordinal", "chunk_id", "digest", "piece")]
    ranked = grouped_rank(stored(whole.unionByName(parts)), ["doc_id"], order, F.floor(F.col("ordinal") / BLOCK), "rank")
    # row ids are unique, so no key is hot
    joined = ranked.select("row", "chunk_id", "doc_id", "source", "piece", F.struct("start", "end").alias("p"), "ordinal", "rank").join(rows.select("row", "text"), "row")
    text = F.when(F.col("p.start").isNull(), F.col("text")).otherwise(_piece("text", "p"))
    return joined.select("chunk_id", "doc_id", "source", "piece", text.alias("text"), F.col("ordinal").alias("old_ordinal"), F.col("rank").cast("int").alias("ordinal"))
