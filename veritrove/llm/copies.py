"""Copies of documents that differ only in formatting.

Method: dictionary encoding. A text is one value, which stands for its letters
and digits, and, where it consists of named fields, also a structure of values:
its fields' names and contents. Every distinct value of the collection is reduced
to its letters and digits once, and every distinct outcome gets an integer. A
text's structure is rewritten as a tuple of such integers, the fields of a record
sorted by them; the compact tuples get integers in turn, and texts that share an
integer of either kind are copies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.operators.ranking import numbered
from veritrove.plans.durable import stored
from veritrove.plans.parallel import spread
from veritrove.plans.skew import hot_join

_REST = re.compile(r"[\W_]+")
_NAME = re.compile(r"\s*([^\W\d_][\w .\-]*?)\s*:\s*(.*?)\s*", re.S)
_FIELD_MARKS = ("|", ";", "\t", ",")
_ROW_MARKS = ("|", "\t", ";", ",")
_RULE = re.compile(r"[\s|:\-+=]*-{3,}[\s|:\-+=]*")


def letters(value: str) -> str:
    """Letters and digits of ``value`` in one case; both cases of every letter give the same."""
    return _REST.sub("", value).upper().casefold()


def _fields(line: str) -> list[tuple[str, str]] | None:
    """The fields of a line ``name: value | name: value``; at least two."""
    for mark in _FIELD_MARKS:
        if mark in line:
            found = [_NAME.fullmatch(part) for part in line.strip().strip(mark).split(mark)]
            if len(found) > 1 and all(found):
                names = [m[1] for m in found]
                if len({letters(n) for n in names}) == len(names):
                    return [(m[1], m[2]) for m in found]
    return None


def _cells(line: str, mark: str) -> list[str]:
    line = line.strip(" \r")
    if mark == "|":
        line = line.strip("|")
    if '"' in line and mark != "|":
        import csv

        return next(csv.reader([line], delimiter=mark, skipinitialspace=True), [])
    return line.split(mark)


def _rows(lines: list[str]) -> list[list[tuple[str, str]]] | None:
    """The records of delimited rows under a header line."""
    for mark in _ROW_MARKS:
        if mark not in lines[0] or mark not in lines[1]:
            continue
        body = [x for x in lines if not _RULE.fullmatch(x)]
        rows = [_cells(x, mark) for x in body]
        names = [letters(x) for x in rows[0]]
        if len(rows) > 1 and len(names) > 1 and all(names) and len(set(names)) == len(names) and all(len(r) == len(names) for r in rows) and all(":" not in x and x.rstrip()[-1] not in ".!?" for x in rows[0]):
            return [list(zip(rows[0], r)) for r in rows[1:]]
    return None


def _json(value):
    """A JSON value as nested tuples: objects as unordered fields, arrays in order, scalars as text."""
    if isinstance(value, _Object):
        return ("object", [(name, _json(x)) for name, x in value.fields])
    if isinstance(value, list):
        return ("array", [_json(x) for x in value])
    return value if isinstance(value, str) else json.dumps(value)


class _Object:
    def __init__(self, fields):
        self.fields = fields


_JSON = json.JSONDecoder(object_pairs_hook=_Object, parse_int=str, parse_float=str)
_BLANK = re.compile(r"\s*")


def _objects(text: str) -> list[_Object] | None:
    """The JSON objects that follow one another in ``text``, one per line or not, if there is nothing else."""
    found, at = [], 0
    while at < len(text):
        try:
            value, at = _JSON.raw_decode(text, at)
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, _Object):
            return None
        found.append(value)
        at = _BLANK.match(text, at).end()
    return found


def structure(text: str):
    """The records of ``text`` if it consists of named fields, else None.

    JSON with an object in it; JSON objects one after another, as in JSON Lines;
    lines of two or more ``name: value`` fields; one block of such single
    fields, whose names differ, or several that are parted by blank lines and
    share their names; delimited rows under a header line. One title line may
    stand above lines and rows.
    """
    stripped = text.strip()
    if not stripped:
        return None
    if stripped[0] in "[{":
        try:
            value = json.loads(stripped, object_pairs_hook=_Object, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            pass
        else:
            return _json(value) if "{" in stripped else None
        if found := _objects(stripped):
            return ("array", [_json(x) for x in found])
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) == 1:
        found = _fields(lines[0])
        return ("array", [("object", found)]) if found else None
    for title in (0, 1):
        if len(lines) - title < 1 + (not title):
            continue
        if found := _fields(lines[title]):
            records = [found, *map(_fields, lines[title + 1 :])]
            if all(records):
                return ("array", [*lines[:title], *(("object", r) for r in records)])
        if len(lines) - title > 1 and (rows := _rows(lines[title:])):
            return ("array", [*lines[:title], ("table", ""), *(("object", r) for r in rows)])
    blocks = [b for b in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text.replace("\r\n", "\n").strip()) if b.strip()]
    if ":" in lines[0]:
        records = [[m and (m[1], m[2]) for m in map(_NAME.fullmatch, b.splitlines())] for b in blocks]
        named = all(len(r) > 1 and all(r) for r in records)
        if named and (len({tuple(sorted(letters(n) for n, _ in r)) for r in records}) == 1 if len(blocks) > 1 else len({letters(n) for n, _ in records[0]}) == len(records[0])):
            return ("array", [("object", r) for r in records])
    return None


#: Signs in a structure's flat form: an object or an array begins, or the innermost one ends. Other integers are places in its list of values.
OBJECT, ARRAY, END = -1, -2, -3


def flattened(node) -> tuple[list[int], list[str]]:
    """A structure as signs and places, and its distinct values; an object's names and contents take turns."""
    shape: list[int] = []
    places: dict[str, int] = {}
    waiting = [node]
    while waiting:
        at = waiting.pop()
        if at is END:
            shape.append(END)
        elif isinstance(at, str):
            shape.append(places.setdefault(at, len(places)))
        else:
            kind, content = at
            shape.append(OBJECT if kind == "object" else ARRAY)
            waiting.append(END)
            waiting += [x for pair in reversed(content) for x in (pair[1], pair[0])] if kind == "object" else reversed(content)
    return shape, list(places)


def rewritten(shape: Sequence[int], numbers: Sequence[int]) -> bytes:
    """The tuple of a structure whose values have these numbers, the fields of each object sorted; nothing is hashed."""
    open_: list[list] = [[]]
    for sign in shape:
        if sign >= 0:
            open_[-1].append(b"v" + int(numbers[sign]).to_bytes(8, "big"))
        elif sign != END:
            open_.append([sign])
        else:
            kind, *parts = open_.pop()
            if kind == OBJECT:
                parts = sorted(map(b"".join, zip(parts[::2], parts[1::2])))
            open_[-1].append((b"o" if kind == OBJECT else b"a") + len(parts).to_bytes(4, "big") + b"".join(parts))
    return open_[0][0]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        plain, exact, shapes, values = [], [], [], []
        seen: dict[str, tuple] = {}
        for text in batch.column(1).to_pylist():
            if text not in seen:
                core = letters(text) if text else ""
                found = structure(text) if core else None
                seen[text] = (xxhash.xxh3_128_digest(core.encode()) if core else None, *((xxhash.xxh3_128_digest(text.encode()), *flattened(found)) if found else (None, None, None)))
            for column, value in zip((plain, exact, shapes, values), seen[text]):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(plain, pa.binary()), pa.array(exact, pa.binary()), pa.array(shapes, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.string()))], ["doc_id", "plain", "exact", "shape", "vals"]
        )


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(letters, batch.column(0).to_pylist()), pa.string()), batch.column(1)], ["value", "core", "uses"])


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [rewritten(shape, [x["id"] for x in sorted(ids, key=lambda x: x["pos"])]) for shape, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["plain", "record"])


def dictionary(occurrences: DataFrame) -> DataFrame:
    """``value``, ``id``, ``uses``: each distinct value of ``occurrences``, canonicalised once; values of the same letters and digits share the id."""
    values = stored(occurrences.groupBy("value").agg(F.count(F.lit(1)).alias("uses")).mapInArrow(_canonical, "value string, core string, uses bigint"))
    cores = stored(values.groupBy("core").agg(F.count(F.lit(1)).alias("spellings")))
    return stored(hot_join(values, numbered(cores, "core", "id"), ["core"], "spellings", values.count()).select("value", "id", "uses"))


def _record_pairs(texts: DataFrame) -> DataFrame:
    """``plain``, ``r``: the numbers of the tuples of all structured texts, each pair once."""
    once = texts.where("exact is not null").dropDuplicates(["exact"]).select(F.monotonically_increasing_id().alias("row"), "plain", "shape", "vals")
    once = stored(once)
    occurrences = stored(once.select("row", F.posexplode("vals").alias("pos", "value")))
    coded = hot_join(occurrences, dictionary(occurrences), ["value"], "uses", occurrences.count())
    # a text's own values; no more than it has signs
    ids = coded.groupBy("row").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
    tuples = stored(once.select("row", "plain", "shape").join(ids, "row").select("plain", "shape", "ids").mapInArrow(_tuples, "plain binary, record binary").distinct())
    records = stored(tuples.groupBy("record").agg(F.count(F.lit(1)).alias("texts")))
    return hot_join(tuples, numbered(records, "record", "r"), ["record"], "texts", tuples.count()).select("plain", "r")


def contents(texts: DataFrame) -> DataFrame:
    """``plain``, ``content``, ``copies``, ``least``: per distinct text by its letters and digits, the number of its content, its rows and smallest id.

    ``texts`` is stored. Texts that share a plain value or a tuple have the same
    content: the smallest number of a tuple that stands with a plain value,
    carried over shared values until nothing changes; a plain value without a
    tuple has a number of its own.
    """
    plains = stored(texts.groupBy("plain").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")))
    labels = stored(_record_pairs(texts).withColumn("content", F.col("r")))
    while True:
        # a plain value with two tuples, or the other way round, joins two groups
        lowest = stored(labels.groupBy("plain").agg(F.min("content").alias("m"), F.countDistinct("content").alias("n"), F.count(F.lit(1)).alias("rows")))
        if lowest.where("n > 1").isEmpty():
            break
        rows = labels.count()
        carried = hot_join(labels, lowest.select("plain", "m", "rows"), ["plain"], "rows", rows)
        by_record = carried.groupBy("r").agg(F.min("m").alias("to"), F.count(F.lit(1)).alias("rows"))
        labels = stored(hot_join(labels, by_record, ["r"], "rows", rows).select("plain", "r", F.col("to").alias("content")))
    named = lowest.select("plain", F.col("m").alias("content"))
    own = numbered(stored(plains.select("plain")), "plain", "number")
    # one row per plain value on each side
    joined = plains.join(named, "plain", "left").join(own, "plain")
    return joined.select("plain", F.coalesce("content", -1 - F.col("number")).alias("content"), "copies", "least")


def _texts(documents: DataFrame) -> DataFrame:
    whole = spread(documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return stored(whole.mapInArrow(_values, "doc_id bigint, plain binary, exact binary, shape array<int>, vals array<string>").where("plain is not null"))


def copy_counts(documents: DataFrame) -> DataFrame:
    """One row per distinct content: ``keep_doc_id``, the smallest id, and ``copies``, the number of rows.

    Texts with the same letters and digits in the same order are copies, and so
    are texts whose records have the same fields. Texts without a letter or digit
    (null, empty, blank ones too) and rows without an id have no content and are
    left out; a repeated id keeps its rows. Further columns are ignored; an empty
    table gives an empty result. The letters and digits of a whole text are held
    as 128 bits; values, tuples and numbers as they are.
    """
    return contents(_texts(documents)).groupBy("content").agg(F.min("least").alias("keep_doc_id"), F.sum("copies").alias("copies")).select("keep_doc_id", "copies")


def copies(documents: DataFrame) -> DataFrame:
    """``keep_doc_id`` and ``copy_doc_id`` for every document of a group of ``copy_counts`` other than its smallest id.

    Groups are reduced to one row before anything is joined back, and the rows
    of a text that very many documents share are not shuffled (``hot_join``).
    """
    texts = _texts(documents)
    known = stored(contents(texts))
    kept = known.groupBy("content").agg(F.min("least").alias("keep_doc_id"), F.sum("copies").alias("n"), F.count(F.lit(1)).alias("plains")).where("n > 1").drop("n")
    by_plain = hot_join(known.select("plain", "content", "copies"), kept, ["content"], "plains", known.count()).select("plain", "keep_doc_id", "copies")
    found = hot_join(texts.select("doc_id", "plain"), by_plain, ["plain"], "copies", texts.count())
    return found.where(F.col("doc_id") > F.col("keep_doc_id")).select("keep_doc_id", F.col("doc_id").alias("copy_doc_id"))
