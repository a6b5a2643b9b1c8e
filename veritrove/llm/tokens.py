"""Encoding of a whole collection with a public byte-level tokenizer.

Method: content-defined chunk reuse. A rolling hash over the code points cuts
each text into chunks at places that depend on the content only, so that equal
passages of different documents give equal chunks. Each distinct chunk is
encoded once per partition of its fingerprint, the ids go back to every place
where the chunk stands, and the joins are repaired by re-encoding until the
pieces agree with an encoding of the undivided text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.parallel import spread

VOCABULARY = "byte_bpe_50k"
#: Code points under the rolling hash, and one place in so many is a cut.
WINDOW, ONE_IN = 12, 64
#: A stretch of so many code points without a safe place is cut anywhere.
LONGEST = 8192
#: A chunk that one task meets more often is spread over the reducers.
HOT = 64

PARTS = "doc_id bigint, row bigint, pos int, joined boolean, key binary, spread int, text string"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """The tokenizer without special tokens; ``folder`` overrides where the vocabulary files lie."""
    import public_tokenizers
    import tiktoken

    path = f"{folder}/{vocabulary}.tiktoken" if folder else public_tokenizers.path(f"{vocabulary}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x3001)), bool, 0x3001)


def cuts(text: str) -> tuple[list[int], list[bool]]:
    """Starts of the chunks of ``text``, and whether each joins its predecessor safely.

    A white space between two other characters always starts a token, so a cut
    there leaves both sides' ids as they are. Only where no such place comes for
    ``LONGEST`` code points is a chunk cut at any rolling-hash hit; that join is
    marked as unsafe and repaired later.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(points)
    if size <= WINDOW + 2:
        return [0], [True]
    space = (points <= 0x3000) & _spaces()[np.minimum(points, 0x3000)]
    with np.errstate(over="ignore"):
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolling = np.zeros(size - WINDOW, np.uint64)
        for k in range(WINDOW):
            rolling += mixed[WINDOW - 1 - k : size - 1 - k] << np.uint64(4 * k)
    hit = np.zeros(size, bool)
    hit[WINDOW:] = (rolling >> np.uint64(40)) % np.uint64(ONE_IN) == 0
    safe = np.zeros(size, bool)
    safe[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
    starts = np.concatenate(([0], np.flatnonzero(hit & safe)))
    if np.diff(np.concatenate((starts, [size]))).max() <= LONGEST:
        return starts.tolist(), [True] * len(starts)
    anywhere = np.flatnonzero(hit)
    out, flags = [], []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), size]):
        out.append(start)
        flags.append(True)
        while end - out[-1] > LONGEST:
            at = np.searchsorted(anywhere, out[-1] + LONGEST // 2)
            place = int(anywhere[at]) if at < len(anywhere) and anywhere[at] < end else out[-1] + LONGEST
            if place >= end:
                break
            out.append(place)
            flags.append(False)
    return out, flags


def _cut(batches: Iterator[pa.RecordBatch], reducers: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    met: dict[bytes, int] = {}
    sent: set[tuple[bytes, int]] = set()
    for batch in batches:
        row, places, joins, keys, spreads, texts = [], [], [], [], [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            text = text or ""
            starts, safe = cuts(text) if text else ([0], [True])
            for pos, (start, end, joined) in enumerate(zip(starts, [*starts[1:], len(text)], safe)):
                piece = text[start:end]
                key = xxhash.xxh3_128_digest(piece.encode())
                times = met[key] = met.get(key, 0) + 1
                spread = times % reducers if times > HOT else 0
                first = (key, spread) not in sent
                if first:
                    sent.add((key, spread))
                row.append(at)
                places.append(pos)
                joins.append(joined)
                keys.append(key)
                spreads.append(spread)
                texts.append(piece if first else None)
            if len(met) > 200_000:  # the table only saves work; forgetting it never changes a result
                met.clear()
                sent.clear()
        at = pa.array(row, pa.int64())
        columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(places, pa.int32()), pa.array(joins, pa.bool_()), pa.array(keys, pa.binary()), pa.array(spreads, pa.int32()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "pos", "joined", "key", "spread", "text"])


def _encode(vocabulary: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder).encode_ordinary
        last, ids = None, []
        for batch in batches:  # sorted by key, the rows that hold the text first
            out, ends = [], [0]
            for key, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if key != last:
                    last, ids = key, encode(text) if text else []
                out += ids
                ends.append(len(out))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], ["doc_id", "row", "pos", "joined", "ids"])

    return run


def repair(parts: list[np.ndarray], joined: list[bool], vocabulary: str = VOCABULARY, folder: str | None = None) -> list[int]:
    """Join the ids of consecutive chunks into the ids of the undivided text.

    At an unsafe join the splitting pattern runs again from the last place where
    a pattern token certainly starts. Its starts on the left side hold but for
    the last two, which the cut may have changed; from the third last on, the
    text is split on into the right side up to the first boundary that the right
    side's own splitting has too. From there on both agree, since the splitting
    has no memory, and that boundary is the next certain place: every chunk is
    split again at most once.
    """
    import public_tokenizers
    import regex

    tokenizer = encoder(vocabulary, folder)
    pattern = _pattern(public_tokenizers.PATTERN, regex)
    done = list(parts[0])
    sure = 0
    for part, safe in zip(parts[1:], joined[1:]):
        right = list(part)
        if safe:
            sure = len(done)
            done += right
            continue
        left_text = tokenizer.decode_bytes(done[sure:]).decode("utf-8")
        right_text = tokenizer.decode_bytes(right).decode("utf-8")
        starts = [m.start() for m in pattern.finditer(left_text)]
        start = starts[-3] if len(starts) >= 3 else 0
        own = {m.start() for m in pattern.finditer(right_text)}
        doubtful, edge = left_text[start:] + right_text, len(left_text) - start
        again, meet = [], len(right_text)
        for token in pattern.finditer(doubtful):
            if token.start() - edge in own:
                meet = token.start() - edge
                break
            again += tokenizer.encode_ordinary(token.group())
        done = done[: sure + _count(tokenizer, done[sure:], len(left_text[:start].encode()))] + again
        if meet < len(right_text):
            sure = len(done)
        done += right[_count(tokenizer, right, len(right_text[:meet].encode())) :]
    return [int(i) for i in done]


@lru_cache(maxsize=1)
def _pattern(text: str, regex):
    return regex.compile(text)


def _count(tokenizer, ids: list[int], size: int) -> int:
    """How many of the first ids make up ``size`` bytes."""
    total = taken = 0
    while total < size:
        total += len(tokenizer.decode_single_token_bytes(int(ids[taken])))
        taken += 1
    return taken


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row of ``documents``.

    One output row for each row, also where an id is repeated; rows without an
    id are left out. An empty
    and a null text give an empty list. Strings of special tokens are ordinary
    text. Further columns are ignored. An empty table gives an empty result.

    Shuffles: the chunks by fingerprint (a repeated chunk carries its text only
    once per task, and one that is met very often is spread over all
    reducers), then the ids by document.
    """
    reducers = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = spread(documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    pieces = whole.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda batches: _cut(batches, reducers), PARTS)
    placed = pieces.repartition("key", "spread").sortWithinPartitions("key", F.col("text").isNull())
    encoded = placed.select("doc_id", "row", "pos", "joined", "key", "text").mapInArrow(_encode(vocabulary, folder), "doc_id bigint, row bigint, pos int, joined boolean, ids array<int>")
    parts = encoded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "joined", "ids"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def mended(ids: pd.Series, joined: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else repair(list(i), list(j), vocabulary, folder) for i, j in zip(ids, joined)], dtype=object)

    unsafe = F.exists("parts", lambda p: ~p["joined"])
    asked = parts.select("doc_id", "parts", F.when(unsafe, F.col("parts.ids")).alias("u"), F.when(unsafe, F.col("parts.joined")).alias("j"))
    return asked.select("doc_id", F.coalesce(mended("u", "j"), F.flatten("parts.ids")).alias("ids"))


def decoded(encoded: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of what ``token_ids`` gives; null for null ids."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        tokenizer = encoder(vocabulary, folder)
        return pd.Series([None if i is None else tokenizer.decode_bytes(list(i)).decode() for i in ids], dtype=object)

    return encoded.select("doc_id", decode("ids").alias("text"))
