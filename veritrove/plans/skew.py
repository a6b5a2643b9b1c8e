"""Joins on keys that a large part of the rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.durable import stored

#: A key is hot if it has more than this share of the rows, so that there are fewer hot keys than 1 / HOT.
HOT = 1 / 2000
#: Rows of a key that no task minds.
LEAST = 100_000


def hot_bound(rows: int, least: int = LEAST) -> int:
    """Rows of a key beyond which it counts as hot; fewer than ``1 / HOT`` keys of ``rows`` rows can be."""
    return max(least, int(rows * HOT))


def hot_join(large: DataFrame, small: DataFrame, keys: list[str], weight: str, rows: int, least: int = LEAST) -> DataFrame:
    """``large`` joined with ``small``, which has one row per key, on ``keys``, whatever share of ``large`` a key has.

    ``weight`` is the column of ``small`` that holds the key's number of rows in
    ``large``, which has ``rows`` rows in all; it is dropped. The few hot keys,
    whose number has a bound by their weight, are broadcast and their rows of
    ``large`` stay where they are; the rest is joined by a shuffle in which no
    key has more rows than ``hot_bound``. Null keys match nothing. ``small`` is
    stored here if there may be hot keys; ``large`` is read twice if there are,
    so it should be stored.
    """
    bound = hot_bound(rows, least)
    if rows <= bound:
        return large.join(small.drop(weight), keys)
    small = stored(small)
    hot = small.where(F.col(weight) > bound)
    if hot.isEmpty():
        return large.join(small.drop(weight), keys)
    cold = small.where(F.col(weight) <= bound).drop(weight)
    among = F.broadcast(hot.drop(weight))
    there = large.join(among, keys)
    rest = large.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return there.unionByName(rest)



def salted_join(large: DataFrame, other: DataFrame, keys: list[str], weights: DataFrame, weight: str, rows: int, least: int = LEAST) -> DataFrame:
    """``large`` joined with ``other``, which may have several rows per key, on ``keys``; hot keys of ``large`` are spread over many tasks.

    ``weights`` holds a key's number of rows in ``large``, which has ``rows`` in
    all, as ``weight``; it is stored here if there may be hot keys. A hot key's rows are dealt out by their hash
    to as many parts as its weight needs, and every part meets a copy of the
    key's rows of ``other``. The list of hot keys, whose number has a bound by
    their weight, is broadcast. Null keys match nothing.
    """
    bound = hot_bound(rows, least)
    if rows <= bound:
        return large.join(other, keys)
    weights = stored(weights)
    if weights.where(F.col(weight) > bound).isEmpty():
        return large.join(other, keys)
    hot = F.broadcast(weights.where(F.col(weight) > bound).select(*keys, F.ceil(F.col(weight) / bound).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = large.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*large.columns), parts).cast("int")).drop("__parts")
    copied = other.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"]).drop("__part")


#: Counters of ``frequent``.
COUNTERS = 4000


def frequent(values: DataFrame, least: int, counters: int = COUNTERS) -> DataFrame:
    """``key``: the integers of the one column of ``values`` that stand in a large share of its rows, at most ``counters`` of them.

    Every value in at least 2 / ``counters`` of the rows and at least twice
    ``least`` times is there, and none with fewer than ``least`` rows. Each task
    keeps ``counters`` counts (Misra and Gries), nothing else is shuffled.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, counts, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            column = batch.column(0)
            found, n = np.unique(column.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            seen += int(n.sum())
            keys, place = np.unique(np.concatenate((keys, found)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)), len(keys)).astype(np.int64)
            if len(keys) > counters:
                counts = counts - np.partition(counts, -counters - 1)[-counters - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(np.full(len(keys), seen))], ["key", "n", "seen"])
        # under null, the number of all
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([seen])], ["key", "n", "seen"])

    counted = values.mapInArrow(run, "key bigint, n bigint, seen bigint")
    sums = stored(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))
    every = sums.where("key is null").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    return sums.where(F.col("key").isNotNull() & (F.col("n") * counters >= every) & (F.col("n") >= least)).select("key")
