"""Command line: ``python -m veritrove --store FOLDER COMMAND ...``; results are JSON lines on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from veritrove.operators.prompts import MODES
from veritrove.plans import service
from veritrove.sources.files import json_lines, read_eval_cases, read_prompt_cases
from veritrove.sources.generator import ChatGenerator
from veritrove.sources.store import DocumentStore


def _print(df: DataFrame) -> None:
    for row in json_lines(df).toLocalIterator():
        print(row["value"])


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="veritrove", description="Evidence-grounded document analysis on Spark")
    parser.add_argument("--store", default="veritrove-store")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="add files and folders")
    ingest.add_argument("paths", nargs="+")
    ingest.add_argument("--words-per-chunk", type=int, default=110)
    ingest.add_argument("--overlap", type=int, default=25)
    query = commands.add_parser("query", help="answer questions")
    query.add_argument("questions", nargs="+")
    query.add_argument("--llm", action="store_true", help="ask the configured generator")
    evaluate = commands.add_parser("evaluate", help="metrics of labelled cases")
    benchmark = commands.add_parser("prompt-benchmark", help="compare prompt modes with the configured generator")
    for command in (evaluate, benchmark):
        command.add_argument("--cases", required=True)
    for command in (query, evaluate, benchmark):
        command.add_argument("--k", type=int, default=5)
    for command in (query, evaluate):
        command.add_argument("--prompt-mode", choices=list(MODES), default="zero_shot")
    commands.add_parser("list", help="the stored documents")
    commands.add_parser("health", help="numbers of documents and chunks")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("veritrove").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = DocumentStore(spark, given.store)
    if given.command == "ingest":
        _print(service.ingest_paths(store, *given.paths, words_per_chunk=given.words_per_chunk, overlap=given.overlap))
    elif given.command == "query":
        asked = spark.createDataFrame(list(enumerate(given.questions, start=1)), "query_id bigint, question string")
        _print(service.answer(store, asked, given.k, given.prompt_mode, ChatGenerator.from_environment() if given.llm else None))
    elif given.command == "evaluate":
        row, spent = service.evaluate(store, read_eval_cases(spark, given.cases), given.k, given.prompt_mode)
        print(json.dumps(row.head().asDict() | {"average_latency_ms": spent}))
    elif given.command == "prompt-benchmark":
        generator = ChatGenerator.from_environment()
        quarantined, modes = service.prompt_benchmark(store, read_prompt_cases(spark, given.cases), generator, given.k)
        print(json.dumps({"retrieval_k": given.k, "quarantined_chunks": quarantined, "generator": generator.model}))
        _print(modes)
    else:
        _print(store.documents() if given.command == "list" else store.health())


if __name__ == "__main__":
    main(sys.argv[1:])
