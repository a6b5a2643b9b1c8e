import hashlib

import pytest
from pyspark.sql import functions as F

from veritrove.operators.chunking import chunk_words
from veritrove.operators.ingest import fingerprint, first_by_content, ingest_report
from veritrove.operators.ranking import grouped_rank
from veritrove.sources import files
from veritrove.sources.store import DIGITS, DocumentStore


def windows(text, size, overlap):
    words = (text or "").split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]


@pytest.mark.parametrize("size,overlap", [(110, 25), (5, 2), (1, 0), (7, 6)])
def test_windows_like_a_loop(spark, size, overlap):
    texts = {1: " ".join(f"w{i}" for i in range(100)), 2: "", 3: None, 4: " \n ", 5: "one", 6: "a b\tc d  e f\ng"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("ordinal", F.lit("clash"))
    got = {}
    for r in chunk_words(rows, "doc_id", size, overlap).collect():
        got.setdefault(r["doc_id"], {})[r["ordinal"]] = (r["chunk_id"], r["text"])
    want = {d: {i: (f"{d}:{i}", w) for i, w in enumerate(windows(t, size, overlap))} for d, t in texts.items() if windows(t, size, overlap)}
    assert got == want


def test_tail_window_comes_out(spark):
    rows = spark.createDataFrame([(1, " ".join(map(str, range(100))))], "doc_id bigint, text string")
    got = [len(r["text"].split()) for r in chunk_words(rows, "doc_id", 110, 25).orderBy("ordinal").collect()]
    assert got == [100, 15]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk_words(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", 10, 10)


def test_fingerprint_and_firsts(spark):
    rows = spark.createDataFrame([(3, "x", 1), (2, "x", 1), (1, "y", None), (5, None, 0), (6, "", 2), (7, "", 1)], "doc_id bigint, text string, t int")
    digest = hashlib.sha256(b"x").hexdigest()
    marked = {r["doc_id"]: r for r in fingerprint(rows).collect()}
    assert marked[3]["content_sha256"] == digest and marked[3]["doc_key"] == "doc-" + digest[:16] and marked[5]["doc_key"] is None
    assert sorted(r["doc_id"] for r in first_by_content(rows, ["t", "doc_id"]).collect()) == [1, 2, 7]


def test_report(spark):
    rows = spark.createDataFrame([(1, "a b c", "s", 1), (2, "a b c", "s", 2), (3, " ", "s", 3), (4, None, "s", 4)], "doc_id bigint, text string, source string, t int")
    got = {r["doc_id"]: (r["inserted"], r["chunks"]) for r in ingest_report(rows, ["t", "doc_id"], 2, 1).collect()}
    assert got == {1: (True, 3), 2: (False, 3), 3: (True, 0)}
    assert ingest_report(rows.limit(0), ["t", "doc_id"]).count() == 0


def test_grouped_rank_without_whole_groups(spark):
    rows = spark.createDataFrame([(g, i) for g in ("a", None, "b") for i in range(50)], "g string, i int")
    got = grouped_rank(rows, ["g"], [F.col("i")], F.floor(F.col("i") / 7), "r").collect()
    assert all(r["r"] == r["i"] for r in got) and len(got) == 150


def test_parsers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.TXT").write_bytes("one\r\ntwo é".encode())
    (tmp_path / "in" / "b.md").write_text("# T")
    (tmp_path / "c.json").write_text('{"b": [1, "ü"], "a": null}')
    (tmp_path / "d.csv").write_text("x,y\n1,2\n\n3\n4,5,6\n")
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.bin").write_bytes(b"\x00")
    (tmp_path / "g.txt").write_bytes(b"\xff\xfe")
    got = {r["source"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.TXT", "b.md", "c.json", "d.csv", "e.json", "g.txt"]
    assert got["a.TXT"]["text"] == "one\ntwo é" and got["a.TXT"]["media_type"] == "text/plain"
    assert got["b.md"]["metadata"] == {"format": "markdown"}
    assert got["c.json"]["text"] == '{\n  "a": null,\n  "b": [\n    1,\n    "ü"\n  ]\n}' and got["c.json"]["metadata"] == {"root_type": "dict"}
    assert got["d.csv"]["text"] == "x: 1 | y: 2\nx: 3 | y: None\nx: 4 | y: 5 | None: ['6']" and got["d.csv"]["metadata"] == {"rows": "3"}
    assert got["e.json"]["text"] is None and "JSONDecodeError" in got["e.json"]["error"]
    assert "UnicodeDecodeError" in got["g.txt"]["error"]


def test_case_files(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('[{"question": "a", "relevant_doc_id": "d", "expected_phrase": null}, {"question": "b", "relevant_doc_id": "e"}]')
    assert [(r["query_id"], r["question"]) for r in files.read_eval_cases(spark, str(path)).collect()] == [(1, "a"), (2, "b")]
    assert [r["expected_insufficient_evidence"] for r in files.read_prompt_cases(spark, str(path)).collect()] == [False, False]
    path.write_text('{"question": "a"}')
    with pytest.raises(ValueError):
        files.read_prompt_cases(spark, str(path))


def test_metadata(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{}",), ("[1]",), ("{bad",), (None,)], "m string")
    assert [r["o"] for r in rows.select(files.parse_metadata(F.col("m")).alias("o")).collect()] == [{"a": "1", "b": "x"}, {}, None, None, None]


def test_store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    assert store.documents().count() == 0 and tuple(store.health().head()) == (0, 0)
    schema = "source string, media_type string, text string, metadata map<string,string>"
    rows = [("a.txt", "text/plain", "one two three", {}), ("b.txt", "text/plain", "one two three", {}), ("c.txt", "text/plain", None, {})]
    first = {r["source"]: r for r in store.ingest(spark.createDataFrame(rows, schema), 2, 1).collect()}
    assert first["a.txt"]["inserted"] and not first["b.txt"]["inserted"] and first["a.txt"]["doc_id"] == first["b.txt"]["doc_id"]
    assert first["b.txt"]["chunks"] == 3 and "c.txt" not in first
    again = store.ingest(spark.createDataFrame([("z.md", "text/markdown", "one two three", {}), ("n.md", "text/markdown", "new", {"format": "markdown"})], schema), 10, 2).collect()
    assert {r["source"]: (r["inserted"], r["chunks"]) for r in again} == {"z.md": (False, 3), "n.md": (True, 1)}
    assert tuple(store.health().head()) == (2, 4)
    assert {r["source"]: r["metadata"] for r in store.documents().collect()} == {"a.txt": {}, "n.md": {"format": "markdown"}}
    assert [r["ordinal"] for r in store.chunks().collect() if r["source"] == "a.txt"] == [0, 1, 2]


PARSED = "source string, media_type string, text string, metadata map<string,string>"


def test_one_row_of_a_content_is_inserted(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    rows = [("a.txt", "text/plain", "same words", {})] * 3 + [("b.txt", "text/plain", "same words", {})] + [("c.txt", None, " ", None)]
    got = store.ingest(spark.createDataFrame(rows, PARSED)).collect()
    assert sorted((r["source"], r["inserted"], r["chunks"]) for r in got) == [("a.txt", False, 1), ("a.txt", False, 1), ("a.txt", True, 1), ("b.txt", False, 1), ("c.txt", True, 0)]
    assert not [r for r in store.ingest(spark.createDataFrame(rows, PARSED)).collect() if r["inserted"]] and tuple(store.health().head()) == (2, 1)
    assert store.ingest(spark.createDataFrame([], PARSED)).count() == 0


@pytest.mark.parametrize("step", ["documents", "chunks", "marker"])
def test_a_failed_ingest_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch, step):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.ingest(spark.createDataFrame([("a.txt", "text/plain", "one two three", {})], PARSED), 2, 1)
    more = spark.createDataFrame([("b.txt", "text/plain", "four five", {}), ("a.txt", "text/plain", "one two three", {})], PARSED)
    write = DocumentStore._write

    def failing(self, batch, documents, chunks):
        if step == "documents":
            raise OSError("lost before anything is written")
        write(self, batch, documents, chunks.limit(0) if step == "chunks" else chunks)
        if step == "chunks":
            raise OSError("lost while the chunks are written")

    def unmarked(self, batch, replaces):
        raise OSError("lost before the marker")

    with monkeypatch.context() as patched:
        patched.setattr(DocumentStore, "_write", failing)
        if step == "marker":
            patched.setattr(DocumentStore, "_publish", unmarked)
        with pytest.raises(OSError):
            store.ingest(more, 2, 1)
    assert tuple(store.health().head()) == (1, 3) and len(store.batches()) == 1
    assert {r["source"]: r["inserted"] for r in store.ingest(more, 2, 1).collect()} == {"b.txt": True, "a.txt": False}
    assert tuple(store.health().head()) == (2, 5) and store.chunks().select("chunk_id").distinct().count() == 5


def test_only_the_folders_of_new_contents_are_read(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.ingest(spark.createDataFrame([(f"{i}.txt", "text/plain", f"text {i}", {}) for i in range(40)], PARSED))
    part = hashlib.sha256(b"text 7").hexdigest()[:DIGITS]
    looked = store._table("documents", "content_sha256 string, part string").where(F.col("part").isin([part]))
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and part in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert looked.count() >= 1 and {r["f"].split("part=")[1][:DIGITS] for r in looked.select(F.input_file_name().alias("f")).collect()} == {part}


def test_compact_and_clean(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    for i in range(3):
        store.ingest(spark.createDataFrame([(f"{i}.txt", "text/plain", f"text number {i}", {"n": str(i)})], PARSED))
    before = sorted((r["doc_id"], r["metadata"]["n"]) for r in store.documents().collect())
    assert store.compact() == 3 and len(store.batches()) == 1 and store.clean() == 3 and store.clean() == 0
    assert sorted((r["doc_id"], r["metadata"]["n"]) for r in store.documents().collect()) == before and tuple(store.health().head()) == (3, 3)
    assert [r["inserted"] for r in store.ingest(spark.createDataFrame([("x.txt", "text/plain", "text number 1", {})], PARSED)).collect()] == [False]


def test_stream_adds_new_contents_once(spark, tmp_path):
    from veritrove.streaming.ingest import ingest_stream

    schema = "source string, media_type string, text string, metadata map<string,string>"
    store = DocumentStore(spark, str(tmp_path / "store"))
    for number, text in enumerate(["alpha beta", "gamma", "alpha beta"]):
        spark.createDataFrame([(f"{number}.txt", "text/plain", text, {})], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest_stream(stream, store, str(tmp_path / "state"), once=True).awaitTermination()
    assert tuple(store.health().head()) == (2, 2)
