"""Pairs of documents with nearly the same content.

Method: chosen-path join. Each document is the set of its word runs, embedded
in a vector of MinHash values. One run of the join is a tree of splits: every
node has a few coordinates, and each member goes down to the child that its
value at the coordinate names, so that only documents with a shared token stay
together. No two nodes of all runs have a coordinate in common, so that a pair's
chances are independent of each other. Small buckets are compared by brute force
on sketches, large ones are split again, and runs repeat until the target
recall. What is left is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm.shingles import SIGNATURE, mixed, shingle_sets, signatures
from veritrove.plans.durable import stored
from veritrove.plans.parallel import spread
from veritrove.plans.skew import frequent, hot_join, salted_join

#: Chance that a pair just at the similarity threshold is found; of the losses, the share that the sketches may have.
RECALL, SKETCHED = 0.9995, 0.25
#: MinHash values that are held at once while leaf keys are made.
HELD = 2_000_000
#: Buckets up to this size are compared by brute force; children of a node of a larger bucket.
SMALL, CHILDREN = 1024, 4
#: Times that a large bucket is split again; beyond, its members share nearly all tokens and are compared in blocks.
LEVELS = 5
#: A collection of so many documents needs one split per factor of SPLIT beyond.
UNSPLIT, SPLIT = 64, 20
#: Ids up to this number (16 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def depth_for(documents: int) -> int:
    return max(2, math.ceil(math.log(max(documents, UNSPLIT) / UNSPLIT) / math.log(SPLIT)))


def runs_for(similarity: float, depth: int, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met in a leaf with the given chance."""
    alive = similarity  # the last split has one child, those above have two
    for _ in range(depth - 1):
        alive = 1 - (1 - similarity * alive) ** 2
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _upto(most: int, trials: int, p: float) -> float:
    """Chance of at most ``most`` successes."""
    return sum(math.comb(trials, k) * p**k * (1 - p) ** (trials - k) for k in range(min(most, trials) + 1))


def least_agreement(similarity: float) -> int:
    """Two-bit sketch fields that a pair at the threshold shares but for a chance of ``SKETCHED`` of the losses."""
    p = similarity + (1 - similarity) / 4
    return next(n for n in range(SIGNATURE, -1, -1) if _upto(n - 1, SIGNATURE, p) <= (1 - RECALL) * SKETCHED)


def recall_of(similarity: float, runs: int, depth: int) -> float:
    """Chance that a pair at the threshold meets in a leaf and its sketches agree, though all its leaves are split again ``LEVELS`` times.

    Sketches and further splits read the same ``SIGNATURE`` values; the sum is over how many of these agree.
    """
    least, found = least_agreement(similarity), 0.0
    for same in range(SIGNATURE + 1):
        alive = 1.0
        for _ in range(LEVELS):
            alive = 1 - (1 - same / SIGNATURE * alive) ** CHILDREN
        alive *= similarity
        for _ in range(depth - 1):
            alive = 1 - (1 - similarity * alive) ** 2
        passed = 1 - _upto(least - same - 1, SIGNATURE - same, 0.25)
        found += math.comb(SIGNATURE, same) * similarity**same * (1 - similarity) ** (SIGNATURE - same) * passed * (1 - (1 - alive) ** runs)
    return found


def whole_runs(similarity: float, depth: int) -> int:
    """Runs for ``RECALL`` with sketches and further splits.

    At most twice ``runs_for``, which is enough down to a similarity of 0.4. Below, pairs whose leaves are all split again
    may be lost more often.
    """
    runs = most = 1
    if similarity < 1:
        runs = runs_for(similarity, depth)
        most = 2 * runs
    while runs < most and recall_of(similarity, runs, depth) < RECALL:
        runs += 1
    return runs


@lru_cache(maxsize=8)
def paths(runs: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """The coordinates on the way to each leaf; leaves of a run share those of their common nodes, and no others are shared."""
    fresh = count(SIGNATURE)  # those before are the sketches' and further splits'
    out: list[tuple[int, ...]] = []
    for _ in range(runs):
        level: list[tuple[int, ...]] = [()]
        for at in range(depth):
            level = [(*node, next(fresh)) for node in level for _ in range(1 if at == depth - 1 else 2)]
        out += level
    return tuple(out)


def _sketches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = (mixed(values) >> np.uint64(20)) & np.uint64(3)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return (bits[:, :32] << shifts).sum(1, dtype=np.uint64), (bits[:, 32:] << shifts).sum(1, dtype=np.uint64)


def _agreement(a0, a1, b0, b1) -> np.ndarray:
    fields = np.uint64(0x5555555555555555)
    x, y = a0 ^ b0, a1 ^ b1
    return SIGNATURE - np.bitwise_count((x | (x >> np.uint64(1))) & fields).astype(np.int64) - np.bitwise_count((y | (y >> np.uint64(1))) & fields)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(words: int, runs: int, depth: int, whole: bool):
    """Sets as digest, sketch and leaf keys; ``whole`` gives the MinHash values instead of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        leaves = () if whole else paths(runs, depth)
        values_each = max((c for path in leaves for c in path), default=SIGNATURE - 1) + 1
        step = max(1, HELD // values_each)
        for batch in batches:
            every = shingle_sets(batch.column(1).to_pylist(), words)
            held = [i for i, s in enumerate(every) if len(s)]
            for begin in range(0, len(held), step):
                there = held[begin : begin + step]
                sets = [every[i] for i in there]
                values = signatures(sets, values_each)
                if whole:
                    lists = values
                else:
                    lists = np.empty((len(sets), len(leaves)), np.uint64)
                    with np.errstate(over="ignore"):
                        for at, path in enumerate(leaves):
                            key = np.full(len(sets), at, np.uint64)
                            for c in path:
                                key = mixed(key * np.uint64(5) + values[:, c])
                            lists[:, at] = key
                low, high = _sketches(values[:, :SIGNATURE])
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * lists.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(there, pa.int64())), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _longs(low), _longs(high), pa.ListArray.from_arrays(offsets, _longs(lists.ravel()))],
                    ["doc_id", "digest", "low", "high", "list"],
                )

    return run


DESCRIBED = "doc_id bigint, digest binary, low bigint, high bigint, list array<bigint>"
#: A pair to be verified, or, with b null, a member of a bucket that is too large.
MET = "key bigint, a bigint, b bigint, low bigint, high bigint"


def _brute(least: int, small: int):
    """Pairs of sketches that agree, within runs of equal keys of up to ``small`` rows; members of longer runs as they are.

    The input is sorted by key. Memory holds one batch and one bucket.
    """

    def pairs(rows: np.ndarray) -> np.ndarray:
        """rows: key, doc, low, high; whole buckets, sorted by key."""
        key, doc, low, high = rows
        bound = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        rest = np.repeat(bound[1:], np.diff(bound)) - np.arange(len(key)) - 1  # followers in the bucket
        found = []
        at, step = np.flatnonzero(rest > 0), 1
        while len(at):
            to = at + step
            good = _agreement(low[at], high[at], low[to], high[to]) >= least
            if good.any():
                x, y = doc[at[good]].view(np.int64), doc[to[good]].view(np.int64)
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
            step += 1
            at = at[rest[at] >= step]
        out = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return np.unique(out[:, out[0] < out[1]], axis=1)

    def give(met: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        none = lambda n: pa.nulls(n, pa.int64())
        n, m = met.shape[1], large.shape[1]
        columns = [(none(n), _longs(large[0])), (pa.array(met[0]), _longs(large[1])), (pa.array(met[1]), none(m)), (none(n), _longs(large[2])), (none(n), _longs(large[3]))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["key", "a", "b", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros((4, 0), np.uint64)
        held, over = empty, None  # rows of the last bucket; the key of a bucket that is known to be too large
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(4)])
            if over is not None:
                more = int(np.argmax(rows[0] != over)) if (rows[0] != over).any() else rows.shape[1]
                if more:
                    yield give(np.zeros((2, 0), np.int64), rows[:, :more])
                rows = rows[:, more:]
                if not rows.shape[1]:
                    continue
                over = None
            rows = np.concatenate((held, rows), 1)
            bound = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]))
            size = np.repeat(np.diff(bound), np.diff(bound))
            last = bound[-2] if len(bound) > 1 else 0
            whole, held = rows[:, :last], rows[:, last:]
            size = size[:last]
            large = whole[:, size > small]
            if held.shape[1] > small:
                large, over, held = np.concatenate((large, held), 1), held[0, 0], empty
            yield give(pairs(whole[:, size <= small]), large)
        if held.shape[1]:
            yield give(pairs(held), empty)

    return run


MEMBER = ("key", "doc_id", "low", "high")


def _buckets(members: DataFrame, least: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``) met in the buckets of up to ``small`` of ``members`` (stored; ``MEMBER``), and the members of larger ones.

    Buckets that hold a large share of all members are large for sure and are
    known by ``frequent``, so that no task has to sort them.
    """
    hot = frequent(members.select("key"), small + 1)
    some = not hot.isEmpty()
    rest = members.join(F.broadcast(hot), "key", "left_anti") if some else members
    met = stored(rest.select(*MEMBER).repartition("key").sortWithinPartitions("key").mapInArrow(_brute(least, small), MET))
    large = met.where("b is null").select("key", F.col("a").alias("doc_id"), "low", "high")
    if some:
        large = large.unionByName(members.join(F.broadcast(hot), "key", "left_semi").select(*MEMBER))
    return met.where("b is not null").select("a", "b"), large


def _children(level: int):
    """Keys of the children that each member of a large bucket goes to; the coordinates depend on the node, and its children's differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, low, high = (batch.column(i).to_numpy().view(np.uint64) for i in range(4))
            values = batch.column(4).flatten().to_numpy().view(np.uint64).reshape(len(key), SIGNATURE)
            first = (mixed(key * np.uint64(9) + np.uint64(level)) % np.uint64(SIGNATURE)).astype(np.int64)
            for child in range(CHILDREN):
                with np.errstate(over="ignore"):
                    node = mixed(key * np.uint64(9) + np.uint64(level * CHILDREN + child))
                    down = mixed(node + values[np.arange(len(key)), (first + child * (SIGNATURE // CHILDREN)) % SIGNATURE])
                yield pa.RecordBatch.from_arrays([_longs(down), _longs(doc), _longs(low), _longs(high)], ["key", "doc_id", "low", "high"])

    return run


def _in_blocks(members: DataFrame, small: int) -> DataFrame:
    """Members (stored) of buckets of any size as buckets of two blocks each, so that every two members meet."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") * 3 / small).cast("int"))
    joined = hot_join(members, sizes, ["key"], "n", members.count())
    numbered = joined.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "doc_id", "low", "high")


def candidate_pairs(documents: DataFrame, described: DataFrame, words: int, similarity: float, small: int = SMALL) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of representatives whose sketches agree, from all leaves of all runs; ``described`` is stored."""
    least = least_agreement(similarity)
    met, large = _buckets(described.select(F.explode("list").alias("key"), "doc_id", "low", "high"), least, small)
    found = [met]
    for level in range(LEVELS + 1):
        if large.isEmpty():
            break
        large = stored(large)
        if level == LEVELS:
            # hash blocks are uneven, hence a bound well above the two blocks' expected size
            met = stored(_in_blocks(large, small).repartition("key").sortWithinPartitions("key").mapInArrow(_brute(least, 1 << 30), MET)).select("a", "b")
        else:
            wanted = large.select("doc_id").distinct()
            again = documents.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_describe(words, 0, 0, True), DESCRIBED)
            split = large.join(again.select("doc_id", "list"), "doc_id").select("key", "doc_id", "low", "high", "list")
            met, large = _buckets(stored(split.mapInArrow(_children(level), "key bigint, doc_id bigint, low bigint, high bigint")), least, small)
        found.append(met)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links between distinct sets of word runs, and which documents have each set.

    Returns ``links`` (``a`` < ``b``, ``shared``, ``united``: sizes of the
    intersection and the union, which are at least ``similarity`` apart from
    rounding, exactly compared) between representatives, the smallest ``doc_id``
    of each set, and ``members`` (``representative``, ``doc_id``) of all
    documents with at least one run. Documents with null, empty or shorter texts
    have no run and are in neither; rows without an id are left out; of a
    repeated id each row counts. If any id is repeated, representatives are
    64-bit hashes of a row's id and text instead, as an id may then stand for
    several sets. Further columns are ignored.

    Copies with the same set are one representative from the start, so a group
    of copies of any size costs one bucket entry. Only ids that a pair needs are
    brought together with their texts again, by a broadcast up to
    ``BROADCAST_IDS`` ids and by a shuffle beyond.
    """
    whole = spread(documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rows, ids = whole.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return _links_and_members(whole, rows, words, similarity)
    keyed = whole.withColumn("key", F.xxhash64("doc_id", "text"))
    links, members = _links_and_members(stored(keyed.select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"])), rows, words, similarity)
    return links, members.withColumnRenamed("doc_id", "key").join(keyed.select("key", "doc_id"), "key").select("representative", "doc_id")


def _links_and_members(whole: DataFrame, rows: int, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """As ``near_duplicates``, of unique ids."""
    depth = depth_for(rows)
    described = stored(whole.mapInArrow(_describe(words, whole_runs(similarity, depth), depth, False), DESCRIBED))
    members = described.select("digest", "doc_id")
    first = stored(members.groupBy("digest").agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("n")))
    ones = stored(described.join(first.select(F.col("representative").alias("doc_id")), "doc_id", "left_semi"))
    candidates = stored(candidate_pairs(whole, ones, words, similarity))
    ids = stored(candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(1).to_pylist(), words)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), _longs(values))], ["doc_id", "runs"])

    texts = whole.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id bigint, runs array<bigint>")
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("runs").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("runs").alias("y"))
    size = candidates.count()
    both = candidates
    for side, runs in (("a", left), ("b", right)):
        both = salted_join(both, runs, [side], candidates.groupBy(side).agg(F.count(F.lit(1)).alias("n")), "n", size)
    compared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    links = compared.select("a", "b", "shared", (F.col("total") - F.col("shared")).alias("united")).where(F.col("shared") / F.col("united") >= similarity)
    return links, hot_join(members, first, ["digest"], "n", rows).select("representative", "doc_id")


def near_pairs(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """All pairs ``doc_a`` < ``doc_b`` of documents whose sets share at least ``similarity`` and less than 1 of their union.

    Rows of the same id are no pair.
    """
    links, members = near_duplicates(documents, words, similarity)
    members, found = stored(members), stored(links.select("a", "b"))
    sizes = members.groupBy("representative").agg(F.count(F.lit(1)).alias("n"))
    rows = members.count()
    for side, to in (("a", "p"), ("b", "q")):
        # the rows of a set that very many documents have are dealt out, and its links copied
        renamed = members.select(F.col("representative").alias(side), F.col("doc_id").alias(to))
        found = salted_join(renamed, found, [side], sizes.select(F.col("representative").alias(side), "n"), "n", rows)
    return found.where("p <> q").select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"))
