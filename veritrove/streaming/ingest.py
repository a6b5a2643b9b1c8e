"""Continuous ingestion into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veritrove.operators.policy import assess_evidence
from veritrove.sources.store import DocumentStore


def ingest_stream(parsed: DataFrame, store: DocumentStore, checkpoint: str, words_per_chunk: int = 110, overlap: int = 25, once: bool = False) -> StreamingQuery:
    """Append each micro-batch of parsed documents whose content is new.

    A batch becomes part of the store as a whole or not at all; one that is run
    again after a failure adds what isn't in the store, each content once.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.ingest(batch, words_per_chunk, overlap)

    writer = parsed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recent_contents(documents: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream without repeated texts among those that come within ``delay`` of each other; the state stays bounded."""
    from veritrove.operators.ingest import fingerprint

    return fingerprint(documents).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_sha256"])


def flagged_stream(snippets: DataFrame) -> DataFrame:
    """The findings of the evidence policy as rows arrive."""
    return assess_evidence(snippets)
