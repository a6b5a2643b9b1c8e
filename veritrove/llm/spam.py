"""Pages that consist of repeated key words, lists of links or product tags.

Method: a robust Mahalanobis distance, per language, over features of density,
entropy, repetition and function words. Centre and scatter come from medians and
absolute deviations and are refined on the documents near the centre, so that
the pages looked for don't distort them. A language's estimates are drawn
towards those of all documents, the more so the fewer documents it has. An
outlier is spam if the direction in which it lies, in the whitened space, is
nearest to that of a sample page of spam rather than of a list, record, table,
junk or unusual prose (``llm/samples.py``, pages of invented words, so that no
word as such speaks for or against a page).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm.markup import convert
from veritrove.llm.prose import TOGETHER, Signs, common_words, shapes
from veritrove.llm.samples import SPAM, sample_pages
from veritrove.plans.durable import stored
from veritrove.plans.parallel import spread

#: Shares of function words, of repeated word pairs, entropy of words, shares of links, of words beside a link in short lines,
#: of words in other short lines, of the five most frequent words that are no function words, of numbers, of delimiters and names
#: before colons, of lines with equally many of these.
FEATURES = ("function", "repetition", "entropy", "link", "labelled", "brief", "density", "number", "mark", "regular")
#: Least scale of a feature, so that one that hardly varies in prose doesn't outweigh all others.
FLOOR = np.array([0.05, 0.08, 0.05, 0.05, 0.05, 0.2, 0.06, 0.04, 0.05, 0.15])
#: 0.9 and 0.999 quantiles of the squared distance if the features were normal (chi-square, 10 degrees).
INNER, OUTER = 15.99, 29.59
STEPS = 2
#: Documents that the whole collection counts as where a language's estimate is drawn towards it.
PRIOR = 200
#: Sample pages per kind.
SAMPLES = 16
#: Words of a short line, at most.
SHORT = 12

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LINKED = re.compile("([^]*)")
_URL = re.compile("://|\\bwww\\.|")
_PARTING = re.compile(r'[|;,\t]|":|:\s')


class Words(dict):
    """The numbers of the words in a token; ``plain`` tells by number whether a word is a function word."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common, self.numbers, self.plain = common, {}, []

    def __missing__(self, token: str) -> list[int]:
        found = []
        for word in _WORD.findall(token.lower()):
            number = self.numbers.get(word)
            if number is None:
                number = self.numbers[word] = len(self.plain)
                self.plain.append(word in self.common)
            found.append(number)
        self[token] = found
        return found

    def trim(self) -> None:
        if len(self) > 400_000:
            self.clear()
            self.numbers.clear()
            self.plain.clear()


def _lines(marked: str) -> tuple[float, float, float]:
    """Shares of words in short lines with a link, in other short lines, and of lines with the most frequent number of parting marks."""
    lines = words = labels = brief = 0
    marks: Counter[int] = Counter()
    for line in marked.splitlines():
        size = len(line.split())
        if size:
            lines += 1
            words += size
            if size <= SHORT:
                if _URL.search(line):
                    labels += size
                else:
                    brief += size
            marks[len(_PARTING.findall(line))] += 1
    regular = max((n for k, n in marks.items() if k), default=0) / lines if lines > 2 else 0.0
    return labels / max(1, words), brief / max(1, words), regular


def features(texts: list[str], known: Signs, words: Words) -> np.ndarray:
    """One row of ``FEATURES`` per text; every text must hold something that isn't blank."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words.trim()
    marked = [convert(t)[0] for t in texts]
    found = shapes([m.replace("", "").replace("", "") for m in marked], known)
    sizes = np.array([len(s.tokens) for s in found])
    doc = np.repeat(np.arange(n), sizes)
    signs = np.concatenate([s.signs for s in found])
    kinds = signs & 7
    size = np.maximum(1, sizes)

    def number(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n).astype(float)

    named = np.fromiter((t.endswith(":") for s in found for t in s.tokens), bool, len(doc))
    inside = np.array([sum(map(len, _LINKED.findall(m))) / len(m) if "" in m else 0.0 for m in marked])
    out[:, 0] = number(kinds == 0) / np.maximum(1, number(kinds != 4))
    out[:, 3] = np.maximum(number(kinds == 3) / size, inside)
    out[:, 4], out[:, 5], out[:, 9] = np.array([_lines(m) for m in marked]).T
    out[:, 7] = number(kinds == 2) / size
    out[:, 8] = number((signs & 32 > 0) | named) / size

    flat: list[int] = []
    lengths = np.zeros(n, np.int64)
    for i, s in enumerate(found):
        before = len(flat)
        for token, kind in zip(s.tokens, (s.signs & 7).tolist()):
            if kind < 3:
                flat += words[token]
        lengths[i] = len(flat) - before
    ids, of, every = np.array(flat, np.int64), np.repeat(np.arange(n), lengths), np.maximum(1, lengths)
    width = len(words.plain) + 1
    keys, counts = np.unique(of * width + ids, return_counts=True)
    owner, word = keys // width, keys % width
    share = counts / every[owner]
    out[:, 2] = np.where(lengths > 1, np.bincount(owner, -share * np.log(share), minlength=n) / np.log(np.maximum(2, every)), 1.0)
    other = ~np.array([*words.plain, True])[word]
    first, counts = owner[other], counts[other]
    order = np.lexsort((-counts, first))
    first, counts = first[order], counts[order]
    top = np.arange(len(first)) - np.searchsorted(first, first) < 5
    out[:, 6] = np.bincount(first[top], counts[top], minlength=n) / every
    same = of[1:] == of[:-1]
    left, place = np.unique(of[:-1][same] * width + ids[:-1][same], return_inverse=True)
    pairs, counts = np.unique(place * width + ids[1:][same], return_counts=True)
    again = counts > 1
    out[:, 1] = np.bincount(left[pairs[again] // width] // width, counts[again], minlength=n) / np.maximum(1, lengths - 1)
    return out


def language(column):
    """Two lower-case letters of a language's name or code, ``und`` if there are none."""
    code = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2})(?![a-z])", 1)
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("und")).otherwise(code)


def _mapped(table: DataFrame, models: dict, give, names: str) -> DataFrame:
    """``give(rows, centre, inverse)`` for the feature rows of each language, as columns ``names`` after ``doc_id`` and ``lang``."""
    kinds = [pa.string() if n.split()[1] == "string" else pa.float64() for n in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array(batch.column(1).to_pylist(), object)
            rows = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], 1)
            out = [np.empty(len(codes), object) for _ in kinds]
            for code in set(codes.tolist()):
                at = np.flatnonzero(codes == code)
                for column, values in zip(out, give(rows[at], *models[code])):
                    column[at] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "lang", *(n.split()[0] for n in names.split(", "))])

    return table.mapInArrow(run, f"doc_id bigint, lang string, {names}")


def _distances(rows: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    away = rows - centre
    return np.einsum("ij,jk,ik->i", away, inverse, away)


def measured(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id``, ``lang`` (normalised) and the features of every text that isn't null, empty or blank. No shuffle."""
    common = common_words(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = Signs(common), Words(common)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            there = [i for i, t in enumerate(texts) if t and not t.isspace()]
            parts = [features([texts[i] for i in there[k : k + TOGETHER]], known, numbers) for k in range(0, len(there), TOGETHER)]
            table = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            at = pa.array(there, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(table[:, k]) for k in range(len(FEATURES)))], ["doc_id", "lang", *FEATURES])

    schema = "doc_id bigint, lang string, " + ", ".join(f"{f} double" for f in FEATURES)
    return spread(documents.select(F.col("doc_id").cast("long"), language(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string"))).mapInArrow(run, schema)


def _and_all(table: DataFrame) -> DataFrame:
    """Each row once under its language and once under null."""
    return table.withColumn("lang", F.explode(F.array("lang", F.lit(None).cast("string"))))


def _drawn(own: np.ndarray, n: int, whole: np.ndarray) -> np.ndarray:
    """An estimate from ``n`` documents, drawn towards that of all documents."""
    return (n * own + PRIOR * whole) / (n + PRIOR)


def _medians(table: DataFrame) -> dict:
    rows = {r["lang"]: (r["n"], np.array(r["m"])) for r in _and_all(table).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(f, 0.5) for f in FEATURES]).alias("m")).collect()}
    return {code: m if code is None else _drawn(m, n, rows[None][1]) for code, (n, m) in rows.items()}


def models_of(table: DataFrame) -> dict:
    """Centre and inverse scatter per language, and of all documents under None.

    Only aggregates reach the driver, one row per language (at most 677) and step.
    """
    middle = _medians(table)
    if not middle:
        return {}
    same = np.eye(len(FEATURES))
    deviations = _medians(_mapped(table, {k: (m, same) for k, m in middle.items()}, lambda rows, m, _: np.abs(rows - m).T, ", ".join(f"{f} double" for f in FEATURES)))
    models = {k: (m, np.diag(1 / np.maximum(1.4826 * deviations[k], FLOOR) ** 2)) for k, m in middle.items()}
    cells = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    for _ in range(STEPS):
        near = _mapped(table, models, lambda rows, m, p: (*rows.T, _distances(rows, m, p)), ", ".join(f"{f} double" for f in (*FEATURES, "distance"))).where(F.col("distance") <= INNER)
        moments = [F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f) for f in FEATURES]).alias("m"), F.array(*[F.covar_pop(FEATURES[i], FEATURES[j]) for i, j in cells]).alias("c")]
        found = {}
        for row in _and_all(near).groupBy("lang").agg(*moments).collect():
            scatter = np.zeros((len(FEATURES), len(FEATURES)))
            for (i, j), value in zip(cells, row["c"]):
                scatter[i, j] = scatter[j, i] = value
            found[row["lang"]] = (row["n"], np.array(row["m"]), scatter)
        if None not in found:  # no document is near any centre
            break
        _, whole, spread_of_all = found[None]
        for code in models:
            n, centre, scatter = found.get(code, (0, whole, spread_of_all))
            if code is not None:
                centre, scatter = _drawn(centre, n, whole), _drawn(scatter, n, spread_of_all)
            models[code] = (centre, np.linalg.inv(scatter + np.diag(FLOOR**2)))
    return models


def sample_features(common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kind and features of each sample page, ``SAMPLES`` of every kind."""
    pages = sample_pages(sorted(common), SAMPLES)
    return np.array([kind for kind, texts in pages.items() for _ in texts], object), features([t for texts in pages.values() for t in texts], Signs(common), Words(common))


def spam_scores(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id``, ``distance`` (squared), ``direction`` (a kind of sample page), ``spam``.

    For every text that isn't null, empty or blank; repeated rows and rows
    without an id stay. ``spam`` is true for documents beyond ``OUTER`` whose
    direction from their language's centre is nearest to that of a sample page
    of spam. ``words`` is the short table of common words of all languages.
    Further columns are ignored; an empty table gives an empty result.
    """
    table = stored(measured(documents, words))
    models = models_of(table)
    if not models:
        return table.select("doc_id", F.lit(0.0).alias("distance"), F.lit("").alias("direction"), F.lit(False).alias("spam"))
    kinds, samples = sample_features(common_words(words))

    def judged(rows: np.ndarray, centre: np.ndarray, inverse: np.ndarray):
        whiten = np.linalg.cholesky(inverse)
        towards = (samples - centre) @ whiten
        towards /= np.linalg.norm(towards, axis=1, keepdims=True)
        return _distances(rows, centre, inverse), kinds[((rows - centre) @ whiten @ towards.T).argmax(1)]

    scored = _mapped(table, models, judged, "distance double, direction string")
    return scored.select("doc_id", "distance", "direction", ((F.col("distance") > OUTER) & F.col("direction").isin(*SPAM)).alias("spam"))
