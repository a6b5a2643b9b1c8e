"""Filling containers of a fixed capacity with documents of varying length.

Method: exact-complement hashing. The lengths form a histogram of at most
``capacity`` classes. From the longest class down, the gap that an item leaves
is looked up among the available single lengths, sums of pairs and sums of
triples; a combination that fills it exactly is used as often as its counts
allow. Where none does, the longest item that fits goes in (best fit), and the
search goes on with the smaller gap.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm.tokens import VOCABULARY, encoder
from veritrove.operators.ranking import grouped_rank
from veritrove.plans.durable import stored
from veritrove.plans.parallel import spread

CAPACITY = 1024
#: Rows of one length that are numbered in one task.
BLOCK_ROWS = 200_000


def exact_fill(counts: np.ndarray, gap: int) -> tuple[int, ...]:
    """One to three available lengths that sum to ``gap``, fewest and longest first; empty if there are none."""
    if counts[gap]:
        return (gap,)
    free = counts[: gap + 1] > 0
    low = np.arange(1, gap // 2 + 1)
    both = free[low] & free[gap - low]
    if gap % 2 == 0 and gap and counts[gap // 2] < 2:
        both[-1:] = False
    found = np.flatnonzero(both)
    if len(found):
        a = int(low[found[0]])
        return (gap - a, a)
    for a in np.flatnonzero(free)[::-1].tolist():
        rest = gap - a
        if rest < 2 or a * 3 < gap:
            continue
        low = np.arange(max(1, rest - a), rest // 2 + 1)
        low = low[free[low] & free[rest - low]]
        # of these at most two can fail by count: the one with b equal to a or to the third, so four are as good as all
        for b in low[:4].tolist():
            need = np.bincount([a, b, rest - b])
            if (counts[: len(need)] >= need).all():
                return (a, rest - b, b)
    return ()


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many containers are filled by each.

    The work depends on the number of distinct lengths (at most ``capacity``),
    not on the number of items: a pattern is used as often as its lengths last,
    so every step uses up a class or leaves fewer of it than the pattern needs.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, number in histogram.items():
        counts[length] = number
    plan: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            left, held, gap = counts.copy(), (longest,), capacity - longest
            left[longest] -= 1
            while gap:
                add = exact_fill(left, gap)
                if not add:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    add = (int(fits[-1]),)
                for length in add:
                    left[length] -= 1
                held, gap = held + add, gap - sum(add)
            need = Counter(held)
            times = min(int(counts[length]) // n for length, n in need.items())
            for length, n in need.items():
                counts[length] -= n * times
            plan.append((held, times))
    return plan


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """A container for every document: ``doc_id``, ``piece``, ``first_token``, ``n_tokens``, ``container_id``.

    Lengths are numbers of tokens. A document over ``capacity`` gives full
    pieces and one rest, any other is piece 0. Documents without tokens (null or
    empty text) need no room and go to container 0. Rows without an id are left
    out, repeated ids are packed as separate items, further columns are ignored;
    an empty table gives an empty result.

    Only the histogram (at most ``capacity`` rows) reaches the driver, and only
    the patterns made from it return. Items are numbered within their length in
    blocks of bounded size, so a length that a third of all documents share is
    no hot group.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary, folder).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    sized = stored(spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")).select("doc_id", tokens(F.col("text").cast("string")).alias("total")))
    full = F.floor(F.col("total") / capacity)
    last = F.when((F.col("total") % capacity > 0) | (F.col("total") == 0), full).otherwise(full - 1)
    items = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", F.col("piece").cast("int"), (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("n_tokens")
    )
    histogram = {row["n_tokens"]: row["n"] for row in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_containers({k: v for k, v in histogram.items() if k}, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for lengths, group in plan:
        for length in sorted(set(lengths)):
            times = lengths.count(length)
            slots.setdefault(length, []).append((used.get(length, 0), container, times))
            used[length] = used.get(length, 0) + times * group
        container += group
    table = {length: tuple(np.array(column) for column in zip(*rows)) for length, rows in slots.items()}

    @F.pandas_udf("long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(lengths), np.int64)
        for length, at in lengths.groupby(lengths).groups.items():
            if length in table:
                first, base, times = table[length]
                where = lengths.index.get_indexer(at)
                rank = ranks.to_numpy()[where]
                slot = np.searchsorted(first, rank, "right") - 1
                out[where] = base[slot] + (rank - first[slot]) // times[slot]
        return pd.Series(out)

    blocks = max(1, -(-max(histogram.values(), default=1) // BLOCK_ROWS))
    ranked = grouped_rank(items, ["n_tokens"], [F.col("doc_id"), F.col("piece")], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)), "rank")
    return ranked.select("doc_id", "piece", "first_token", "n_tokens", place("n_tokens", "rank").alias("container_id"))
