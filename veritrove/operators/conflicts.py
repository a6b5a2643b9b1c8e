"""Contradictions between pairs of requirements."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions.text import general_format
from veritrove.plans.durable import stored
from veritrove.plans.skew import hot_join

# Ranks of modal words in the order in which ties are resolved, and negating words.
MODALITIES = {"shall": 3, "must": 3, "required": 3, "should": 2, "recommended": 2, "may": 1, "optional": 1}
NEGATIONS = ("not", "never", "prohibited", "forbidden", "without")
# A number and its unit, the alternatives in the order that decides.
NUMBER = r"(\d+(?:\.\d+)?)\s*(ms|s|sec|seconds?|minutes?|hours?|days?|%|percent|mb|gb|kb)?"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def requirement_tokens(text: Column) -> Column:
    """Distinct ASCII tokens of three or more signs without modal and negating words; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zA-Z0-9_]{3,})"))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*MODALITIES, *NEGATIONS)))


def numeric_facts(text: Column) -> Column:
    """Array of (value, unit); a number without a unit has the unit ``number``."""
    source = F.coalesce(text, F.lit(""))
    values, units = (F.regexp_extract_all(source, F.lit("(?i)" + NUMBER), F.lit(i)) for i in (1, 2))
    return F.transform(
        F.arrays_zip(values.alias("v"), units.alias("u")), lambda x: F.struct(x["v"].cast("double").alias("value"), F.when(F.coalesce(x["u"], F.lit("")) == "", F.lit("number")).otherwise(F.lower(x["u"])).alias("unit"))
    )


def strongest_modality(text: Column) -> Column:
    """Struct of ``word`` and ``rank``; null and 0 if there is none. The first of the highest rank wins."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("rank"))
    # a later case takes precedence, so the words go from the weakest to the strongest and within a rank from last to first
    for rank in sorted(set(MODALITIES.values())):
        for word in reversed([w for w, r in MODALITIES.items() if r == rank]):
            out = F.when(lowered.rlike(f"{_BEFORE}{word}{_AFTER}"), F.struct(F.lit(word).alias("word"), F.lit(rank).alias("rank"))).otherwise(out)
    return out


def has_negation(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(f"{_BEFORE}(?:{'|'.join(NEGATIONS)}){_AFTER}")


def described(requirements: DataFrame) -> DataFrame:
    """One row per distinct requirement (``requirement_id``, ``text``) with its features; null texts and ids are left out."""
    once = requirements.where("requirement_id is not null and text is not null").select("requirement_id", "text").distinct()
    text = F.col("text")
    return once.select(
        "requirement_id",
        "text",
        F.array_sort(requirement_tokens(text)).alias("tokens"),
        numeric_facts(text).alias("facts"),
        strongest_modality(text).alias("modality"),
        has_negation(text).alias("negated"),
    )


def overlapping_pairs(rows: DataFrame, minimum_overlap: float, condition=None) -> DataFrame:
    """Pairs ``l``, ``r`` of different ``n`` of ``rows`` that may overlap by at least ``minimum_overlap``, which is positive; all that do are there.

    ``rows``: ``n`` (unique), ``tokens``, and what ``condition``, a function of
    two prefixes of columns, needs to rule pairs out early.

    Candidates come from an inverted join on prefixes: two sets of Jaccard
    similarity t share a token among the rarest |x| - ceil(t |x|) + 1 of each.
    The prefixes hold the rarest tokens, so common words, which a third of all
    rows may share, make no candidates unless nothing rarer is left.
    """
    rest = [c for c in rows.columns if c not in ("n", "tokens", "requirement_id", "text", "facts", "modality")]
    exploded = stored(rows.select("n", *rest, F.size("tokens").alias("size"), F.explode("tokens").alias("token")))
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("uses", F.col("df"))
    # a token of most requirements isn't brought together
    ranked = hot_join(exploded, counts, ["token"], "uses", exploded.count()).groupBy("n", "size", *rest).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("sorted"))
    length = F.col("size") - F.ceil(F.lit(minimum_overlap) * F.col("size") - 1e-9).cast("int") + 1
    prefix = ranked.select("n", "size", *rest, F.explode(F.slice("sorted", F.lit(1), F.greatest(F.lit(1), length))).alias("t")).select("n", "size", *rest, "t.token")
    left, right = (prefix.select("token", F.col("n").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("size", *rest)]) for side in ("l", "r"))
    near = F.least("l_size", "r_size") >= F.lit(minimum_overlap) * F.greatest("l_size", "r_size") - 1e-9
    met = left.join(right, "token").where((F.col("l") < F.col("r")) & near)
    return (met if condition is None else met.where(condition("l_", "r_"))).select("l", "r").distinct()


def numbered(requirements: DataFrame) -> DataFrame:
    """``described`` requirements, written once, with a number ``n`` each and what rules pairs out early."""
    # the numbers are written, as those of two scans may differ
    # and rise with the ids, then the texts
    return stored(described(requirements).orderBy("requirement_id", "text").select(F.monotonically_increasing_id().alias("n"), "*", F.col("modality.rank").alias("rank"), (F.size("facts") > 0).alias("counted")))


#: Requirements of a block where all pairs are compared.
BLOCK = 500


def all_pairs(rows: DataFrame, condition, block: int = BLOCK) -> DataFrame:
    """All pairs ``l``, ``r`` of ``rows`` (stored, ``n``) that ``condition`` lets pass: every two blocks of rows meet in a task of their own."""
    rest = [c for c in rows.columns if c not in ("n", "tokens", "requirement_id", "text", "facts", "modality")]
    blocks = max(1, -(-rows.count() // block))
    placed = rows.select("n", *rest, F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = placed.select("n", *rest, "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    left, right = (met.select("x", "y", F.col("n").alias(side), F.col("own").alias(f"{side}_own"), *[F.col(c).alias(f"{side}_{c}") for c in rest]) for side in ("l", "r"))
    # two rows of one block meet only where it meets itself
    return left.join(right, ["x", "y"]).where((F.col("l") < F.col("r")) & ((F.col("l_own") != F.col("r_own")) | (F.col("x") == F.col("y")))).where(condition("l_", "r_")).select("l", "r")


#: Most requirements of a block whose pairs are counted in one task, blocks that a small input gets, and pairs handed on at once.
MEETING, FEW, PAIRS = 16_384, 8, 20_000


def _meet(first: pa.Table, second: pa.Table | None, least: float, conflicting: bool) -> Iterator[pa.RecordBatch]:
    """``l``, ``r``, ``overlap`` of the pairs of rows of two blocks, or of one, with a Jaccard similarity of ``least``."""
    both = pa.concat_tables([first] + ([second] if second is not None else [])).combine_chunks()
    n, negated, counted, rank = (both[c].to_numpy() for c in ("n", "negated", "counted", "rank"))
    tokens, sides = both["tokens"].combine_chunks(), both["s"].combine_chunks()
    sizes = np.diff(tokens.offsets.to_numpy())
    start = np.concatenate(([0], np.cumsum(sizes)))
    words = tokens.flatten().dictionary_encode()
    words = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).indices.to_numpy()
    begin = 0 if second is None else first.num_rows
    size = len(n) - begin
    # the rows of the second block by word
    owner = np.repeat(np.arange(len(n)), sizes)[start[begin] :] - begin
    order = np.argsort(words[start[begin] :], kind="stable")
    owner, df = owner[order], np.bincount(words[start[begin] :], minlength=int(words.max()) + 1 if len(words) else 0)
    at = np.concatenate(([0], np.cumsum(df)))
    found: list[tuple] = []
    waiting = 0

    def give() -> pa.RecordBatch:
        a, b, overlap = (np.concatenate(x) for x in zip(*found))
        turned = n[a] > n[b]
        l, r = np.where(turned, b, a), np.where(turned, a, b)  # noqa: E741
        return pa.RecordBatch.from_arrays([sides.take(pa.array(l)), sides.take(pa.array(r)), pa.array(overlap)], ["l", "r", "overlap"])

    for i in range(first.num_rows):
        own = words[start[i] : start[i + 1]]
        if not len(own):
            continue
        shared = np.bincount(np.concatenate([owner[at[w] : at[w + 1]] for w in own]), minlength=size)
        if second is None:
            shared[: i + 1] = 0
        (near,) = ((1 + least) * shared >= least * (sizes[i] + sizes[begin:]) - 1e-6).nonzero()
        near = near[shared[near] > 0]
        overlap = shared[near] / (sizes[i] + sizes[begin + near] - shared[near])
        keep = overlap >= least
        if conflicting:
            j = begin + near
            keep &= (negated[j] != negated[i]) | (counted[j] & counted[i]) | ((rank[j] > 0) & (rank[i] > 0) & (np.abs(rank[j] - rank[i]) >= 2))
        near, overlap = near[keep], overlap[keep]
        for cut in range(0, len(near), PAIRS):
            part = near[cut : cut + PAIRS]
            found.append((np.full(len(part), i), begin + part, overlap[cut : cut + PAIRS]))
            waiting += len(part)
            if waiting >= PAIRS:
                yield give()
                found, waiting = [], 0
    if found:
        yield give()


def met_pairs(rows: DataFrame, minimum_overlap: float, conflicting: bool = False, most: int | None = None) -> DataFrame:
    """Pairs of ``rows`` (``numbered``) that overlap by ``minimum_overlap``, which is positive: ``l``, ``r``, ``overlap``, ``l`` with the smaller ``n``.

    ``l`` and ``r`` are structs of the requirements' columns but their texts and
    tokens. With ``conflicting`` only pairs are there that ``may_conflict``.
    Every two blocks of rows meet in a task of their own, which hands the pairs
    on as it finds them: what is shuffled are copies of the rows, one for each
    block, and no pairs, which are quadratic.
    """
    count = rows.count()
    blocks = max(1, min(FEW, -(-count // BLOCK)), -(-count // (most or MEETING)))
    side = F.struct("requirement_id", "facts", "modality", "negated")
    placed = rows.select("n", "tokens", "negated", "counted", "rank", side.alias("s"), F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = placed.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    together = met.repartition(blocks * (blocks + 1) // 2, "x", "y").sortWithinPartitions("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(x: int, y: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            own = table["own"].to_numpy()
            yield from _meet(table.filter(pa.array(own == x)), table.filter(pa.array(own == y)) if x != y else None, minimum_overlap, conflicting)

        key, parts = None, []
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            cuts = [0, *(np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(x)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if (now := (int(x[begin]), int(y[begin]))) != key:
                    if parts:
                        yield from judged(*key, parts)
                    key, parts = now, []
                parts.append(batch.slice(begin, end - begin))
        if parts:
            yield from judged(*key, parts)

    kind = rows.select(side.alias("s")).schema["s"].dataType.simpleString()
    return together.mapInArrow(run, f"l {kind}, r {kind}, overlap double")


def may_conflict(a: str, b: str) -> Column:
    """Whether any kind of conflict is possible, by prefixes of the columns of ``numbered``."""
    ranks = (F.col(f"{a}rank") > 0) & (F.col(f"{b}rank") > 0) & (F.abs(F.col(f"{a}rank") - F.col(f"{b}rank")) >= 2)
    return (F.col(f"{a}negated") != F.col(f"{b}negated")) | (F.col(f"{a}counted") & F.col(f"{b}counted")) | ranks


def with_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` with both requirements' columns under ``l_`` and ``r_``, ``l`` being the one with the smaller id, then text."""
    names = ["requirement_id", "text", "tokens", "facts", "modality", "negated"]
    side = rows.select("n", F.struct(*names).alias("s"))
    both = pairs.join(side.select(F.col("n").alias("l"), F.col("s").alias("a")), "l").join(side.select(F.col("n").alias("r"), F.col("s").alias("b")), "r")
    ordered = (F.col("a.requirement_id") < F.col("b.requirement_id")) | ((F.col("a.requirement_id") == F.col("b.requirement_id")) & (F.col("a.text") < F.col("b.text")))
    turned = both.select(F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("y"))
    return turned.select(*[F.col(f"{v}.{c}").alias(f"{s}_{c}") for v, s in (("x", "l"), ("y", "r")) for c in names])


def overlap_of(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def find_conflicts(requirements: DataFrame, minimum_overlap: float = 0.18) -> DataFrame:
    """All conflicting pairs (``conflicting_pairs``), the strongest first; equal scores are ordered by ids, then explanation."""
    return conflicting_pairs(requirements, minimum_overlap).orderBy(F.col("score").desc(), "left_id", "right_id", "explanation")


def conflicting_pairs(requirements: DataFrame, minimum_overlap: float = 0.18) -> DataFrame:
    """All conflicting pairs in any order: ``left_id``, ``right_id``, ``kind``, ``score``, ``explanation``, ``evidence``.

    ``left`` precedes ``right`` by id, then text. Negation decides before
    numbers, numbers before modality; the first pair of different values with
    the same unit counts, in the order of the left text. Repeated rows are one
    requirement. ``minimum_overlap`` 0 asks for all pairs, which are then compared
    block by block; that work is quadratic.
    """
    if not 0 <= minimum_overlap <= 1 or math.isnan(minimum_overlap):
        raise ValueError("minimum_overlap must lie between 0 and 1")
    # a fact is written out once per requirement, as it may stand in very many pairs
    rows = numbered(requirements).withColumn("facts", F.transform("facts", lambda x: F.struct(x["value"].alias("value"), x["unit"].alias("unit"), F.concat(general_format(x["value"]), F.lit(" "), x["unit"]).alias("shown"))))
    if minimum_overlap > 0:
        names = ["requirement_id", "facts", "modality", "negated"]
        scored = met_pairs(rows, minimum_overlap, True).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in names], "overlap")
    else:
        scored = with_sides(all_pairs(rows, may_conflict), rows).withColumn("overlap", overlap_of("l_tokens", "r_tokens"))
    differing = F.filter(
        F.flatten(F.transform("l_facts", lambda x: F.transform("r_facts", lambda y: F.struct(x["value"].alias("a"), x["unit"].alias("u"), x["shown"].alias("c"), y["value"].alias("b"), y["unit"].alias("v"), y["shown"].alias("d"))))),
        lambda p: (p["u"] == p["v"]) & (p["a"] != p["b"]),
    )
    judged = scored.withColumn("numbers", F.get(differing, F.lit(0)))
    gap = F.abs(F.col("numbers.a") - F.col("numbers.b")) / F.greatest(F.abs("numbers.a"), F.abs("numbers.b"), F.lit(1.0))
    negation = F.col("l_negated") != F.col("r_negated")
    numeric = F.col("numbers").isNotNull()
    modality = (F.col("l_modality.rank") > 0) & (F.col("r_modality.rank") > 0) & (F.abs(F.col("l_modality.rank") - F.col("r_modality.rank")) >= 2)
    kind = F.when(negation, F.lit("negation")).when(numeric, F.lit("numeric")).when(modality, F.lit("modality"))
    score = F.when(negation, 0.72 + 0.28 * F.col("overlap")).when(numeric, 0.60 + 0.30 * F.col("overlap") + 0.10 * gap).otherwise(0.55 + 0.35 * F.col("overlap"))
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    # fixed values: the wording of the explanations
    explanation = (
        F.when(negation, F.lit("Requirements have overlapping subject matter but opposite negation polarity."))
        .when(
            numeric,
            F.concat(F.lit("Requirements specify different values for the same unit: "), F.col("numbers.c"), F.lit(" vs "), F.col("numbers.d"), F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Normative strength differs materially: "), quoted("l_modality.word"), F.lit(" versus "), quoted("r_modality.word"), F.lit(".")))
    )
    found = judged.withColumn("kind", kind).where("kind is not null")
    return found.select(
        F.col("l_requirement_id").alias("left_id"),
        F.col("r_requirement_id").alias("right_id"),
        "kind",
        F.least(F.lit(1.0), score).alias("score"),
        explanation.alias("explanation"),
        F.array("l_requirement_id", "r_requirement_id").alias("evidence"),
    )
