"""Documents from files: text, Markdown, JSON, CSV and, where a library is there, PDF."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by suffix.
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".json": "application/json", ".csv": "text/csv", ".pdf": "application/pdf"}
LARGEST_UPLOAD = 20 * 1024 * 1024

Parsed = tuple[str, dict[str, str]]


def _decoded(content: bytes) -> str:
    return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


def _plain(content: bytes) -> Parsed:
    return _decoded(content), {}


def _markdown(content: bytes) -> Parsed:
    return _decoded(content), {"format": "markdown"}


def _json(content: bytes) -> Parsed:
    """Sorted keys, two blanks of indent, non-ASCII as it is."""
    payload = json.loads(_decoded(content))
    return json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True), {"root_type": type(payload).__name__}


def _csv(content: bytes) -> Parsed:
    """A line ``name: value | name: value`` per row under the header; a missing value is None, surplus ones are a list under None."""
    rows = [r for r in csv.reader(io.StringIO(_decoded(content))) if r]
    lines = []
    for row in rows[1:]:
        fields = dict(zip(rows[0], [*row, *[None] * (len(rows[0]) - len(row))]))
        if len(row) > len(rows[0]):
            fields[None] = row[len(rows[0]) :]
        lines.append(" | ".join(f"{name}: {value}" for name, value in fields.items()))
    return "\n".join(lines), {"rows": str(max(0, len(rows) - 1))}


def _pdf(content: bytes) -> Parsed:
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ValueError("PDF documents need the library pypdf, which isn't installed") from missing
    pages = [(page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(content)).pages]
    text = "\n\n".join(f"[Page {n}]\n{page}" for n, page in enumerate(pages, start=1))
    return text, {"pages": str(len(pages)), "pages_with_text": str(sum(map(bool, pages)))}


PARSERS: dict[str, Callable[[bytes], Parsed]] = {".txt": _plain, ".md": _markdown, ".json": _json, ".csv": _csv, ".pdf": _pdf}
PARSED = "source string, media_type string, text string, metadata map<string,string>, error string"


def suffix_of(name: Column) -> Column:
    """The lower-case suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for source, suffix, content in zip(*(c.to_pylist() for c in batch.columns)):
            parser = PARSERS.get(suffix)
            if parser is None:
                rows.append((None, None, None, f"unsupported document type: {suffix}"))
                continue
            try:
                text, metadata = parser(content or b"")
                rows.append((MEDIA_TYPES[suffix], text, list(metadata.items()), None))
            except Exception as problem:  # one bad file must not fail the others
                rows.append((MEDIA_TYPES[suffix], None, None, f"{type(problem).__name__}: {problem}"))
        kinds = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["source", "media_type", "text", "metadata", "error"])


def parse_contents(contents: DataFrame) -> DataFrame:
    """``source`` (a name with a suffix), ``content`` (bytes) as parsed documents; those that can't be parsed have an ``error`` and no text."""
    return contents.select("source", suffix_of(F.col("source")).alias("suffix"), "content").mapInArrow(_parse, PARSED)


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """All files of the known suffixes under ``paths``, which may be folders; others are passed over silently."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    known = found.where(suffix_of(F.col("path")).isin(*MEDIA_TYPES))
    return parse_contents(known.select(F.regexp_replace("path", r"^file:/+", "/").alias("source"), "content"))


def parse_metadata(text: Column) -> Column:
    """A JSON object as a map from its names to its values as text; null for anything else."""
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)), F.from_json(text, "map<string,string>"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``question``, ``relevant_doc_id``, ``expected_phrase``, numbered from 1 in the order of the file."""
    schema = "question string, relevant_doc_id string, expected_phrase string"
    return _numbered(spark.read.schema(schema).json(path, multiLine=True))


def read_prompt_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``question`` and ``expected_insufficient_evidence`` (false if missing), numbered from 1; anything but an array is refused."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).head()
    if first is None or first["c"] != "[":
        raise ValueError("prompt cases must be a JSON array")
    rows = spark.read.schema("question string, expected_insufficient_evidence boolean").json(path, multiLine=True)
    return _numbered(rows.withColumn("expected_insufficient_evidence", F.coalesce("expected_insufficient_evidence", F.lit(False))))


def _numbered(rows: DataFrame) -> DataFrame:
    """A case file is one JSON value and so one partition in file order."""
    return rows.select((F.monotonically_increasing_id() + 1).alias("query_id"), "*")


def json_lines(df: DataFrame) -> DataFrame:
    """The rows as one JSON text each, in column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
