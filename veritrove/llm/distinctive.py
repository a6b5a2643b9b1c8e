"""How characteristic a term is of a chunk compared with the whole collection.

Method: positive pointwise mutual information of term and chunk from their joint
count and the marginal counts, the terms' counts smoothed by a fractional
exponent. Group-bys and joins only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.durable import stored
from veritrove.plans.skew import hot_join

#: Exponent of the terms' counts.
SMOOTHING = 0.75
#: Distinct terms, or chunks' terms, that a task holds before it hands on its partial counts.
HELD = 300_000
#: Terms up to which the vocabulary is broadcast (some 60 bytes each), so that the chunks' terms stay where they are.
BROADCAST_TERMS = 500_000

_RUN = re.compile(r"[^\W\d_]{4,}")


def terms(text: str) -> list[str]:
    """Maximal runs of at least four letters of any script, lower-cased."""
    special = "İ" in text  # its lower case holds a mark, which is no letter, so runs are found before
    found = _RUN.findall(text if special else text.lower())
    if not text.isascii() and not all(map(str.isalpha, found)):
        # \w also holds numerals that are no digits
        found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split() if len(w) > 3]
    return [w.lower() for w in found] if special else found


COUNTED = "chunk_id string, term string, n bigint, size bigint, docs array<bigint>, many boolean"


def _count(least: int, enough: int, out: bool):
    """Two kinds of rows: the counts of a chunk's terms, and (without chunk_id) partial counts of the terms, with the number of chunks as ``size``.

    A partial count holds the distinct documents of a term, up to one more than
    ``enough``: more can't matter, as ``many`` then says so. If ``many`` puts a
    term ``out``, counts of a chunk's terms that are already out are not handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        uses: Counter[str] = Counter()
        docs: dict[str, set[int]] = {}
        rows: list[tuple[str, str, int, int]] = []

        def give() -> pa.RecordBatch:
            there = [r for r in rows if not out or len(docs[r[1]]) <= enough]
            names = list(total)
            n, m = len(there), len(names)
            held = [None] * n + [[] if len(docs[t]) > enough else list(docs[t]) for t in names]
            columns = [
                pa.array([r[0] for r in there] + [None] * m, pa.string()),
                pa.array([r[1] for r in there] + names, pa.string()),
                pa.array([r[2] for r in there] + [total[t] for t in names], pa.int64()),
                pa.array([r[3] for r in there] + [uses[t] for t in names], pa.int64()),
                pa.array(held, pa.list_(pa.int64())),
                pa.array([None] * n + [len(docs[t]) > enough for t in names], pa.bool_()),
            ]
            total.clear()
            uses.clear()
            docs.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["chunk_id", "term", "n", "size", "docs", "many"])

        for batch in batches:
            for chunk, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = Counter(terms(text))
                total.update(counts)
                size = sum(counts.values())
                for term, n in counts.items():
                    have = docs.get(term)
                    if have is None:
                        have = docs[term] = set()
                    if doc is not None and len(have) <= enough:
                        have.add(doc)
                    if n >= least:
                        uses[term] += 1
                        rows.append((chunk, term, n, size))
            if len(total) > HELD or len(rows) > HELD:
                yield give()
        yield give()

    return run


def distinctive_terms(chunks: DataFrame, least: int = 1, docs: tuple[int, int | None] = (1, None), smoothing: float = SMOOTHING) -> DataFrame:
    """``chunk_id``, ``term``, ``n``, ``score``: every term that a chunk holds at least ``least`` times.

    ``docs`` bounds the number of distinct documents that hold the term. The
    score is ln(n * S / (size * N ** smoothing)), at least 0, with the chunk's
    number of terms, the collection's count N of the term, and S the sum of all
    N ** smoothing; all counts are over the whole collection.

    A repeated ``chunk_id`` counts once, with its earliest ``loaded_at``, then
    its smallest text. Chunks with null, empty or blank text give no rows; rows
    without ``chunk_id`` are left out; a null ``doc_id`` is no document. Further
    columns are ignored; an empty table gives an empty result.

    Partial counts are made in the scan's tasks; only they are shuffled, and
    terms that are out of bounds are dropped before the join back. For it, up to
    ``BROADCAST_TERMS`` terms are broadcast, of more those of a large share of
    the rows (``hot_join``).
    """
    low, high = docs
    once = (
        chunks.where("chunk_id is not null and text is not null")
        .groupBy(F.col("chunk_id").cast("string").alias("chunk_id"))
        .agg(F.min(F.struct("loaded_at", F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))).alias("row"))
    )
    # a term is out beyond high documents, or, without such a bound, in from low documents on; no more of them are held
    enough = low - 1 if high is None else high
    counted = stored(once.select("chunk_id", "row.doc_id", "row.text").mapInArrow(_count(least, enough, high is not None), COUNTED))
    some = counted.where("chunk_id is null").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (["term", "part"], ["term"]):
        held = F.slice(F.array_distinct(F.flatten(F.collect_list("docs"))), 1, enough + 1)
        some = some.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), held.alias("docs"), F.max("many").alias("many"))
    documents = F.size("docs")
    bounds = F.col("many") | (documents >= low) if high is None else ~F.col("many") & documents.between(low, high)
    vocabulary = some.where(bounds).select("term", F.col("n").alias("total"), F.col("size").alias("uses"))
    mass = counted.where("chunk_id is null").groupBy("term").agg(F.sum("n").alias("n")).agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(smoothing))).alias("mass")).first()["mass"]
    vocabulary = stored(vocabulary)
    joint = counted.where("chunk_id is not null").select("chunk_id", "term", "n", "size")
    if vocabulary.count() <= BROADCAST_TERMS:
        joint = joint.join(F.broadcast(vocabulary.drop("uses")), "term")
    else:  # a term of nearly every chunk isn't brought together
        joint = hot_join(joint, vocabulary, ["term"], "uses", joint.count())
    score = F.log(F.col("n") * F.lit(mass) / (F.col("size") * F.pow(F.col("total").cast("double"), F.lit(smoothing))))
    return joint.select("chunk_id", "term", "n", F.greatest(F.lit(0.0), score).alias("score"))
