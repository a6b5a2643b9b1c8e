"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from veritrove.llm.copies import copies, copy_counts
from veritrove.llm.distinctive import distinctive_terms
from veritrove.llm.markup import clean_documents
from veritrove.llm.near import near_pairs
from veritrove.llm.packing import pack_documents
from veritrove.llm.pieces import oversized_pieces, split_chunks
from veritrove.llm.prose import text_statistics
from veritrove.llm.spam import spam_scores
from veritrove.llm.tokens import decoded, encoder, token_ids
from veritrove.plans.durable import stored
from veritrove.plans.parallel import spread
from veritrove.sources.tables import table


def rebuilt_chunks(spark, folder):
    """Per oversized chunk its text put together again from its pieces, and whether all pieces keep the bounds of length and overlap."""
    pieces = oversized_pieces(table(spark, folder, "chunks"))
    parts = pieces.groupBy("chunk_id", "doc_id", "ordinal", F.col("source")).agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("p"))
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"), F.lit(True).alias("kept"))
    join = lambda a, x: F.struct(
        x["end"].alias("end"),
        F.concat(a["text"], F.substring(x["text"], a["end"] - x["start"] + 1, F.length(x["text"]))).alias("text"),
        (a["kept"] & (F.length(x["text"]) <= 1200) & ((x["piece"] == 0) | (a["end"] - x["start"]).between(90, 210))).alias("kept"),
    )
    whole = parts.withColumn("w", F.aggregate("p", start, join))
    return whole.select("chunk_id", F.length("w.text").cast("long").alias("size"), F.md5("w.text").alias("digest"), F.col("w.kept").alias("kept"))


def container_check(spark, folder):
    """One row: documents, ids whose pieces in containers aren't their documents' tokens cut at multiples of 1,024, overfull containers, and whether over 1 % more containers are used than the tokens need.

    Tokens are counted here once more from the whole texts, so the packing is
    held against the documents and not against itself. Pieces are compared as
    multisets: rows of a repeated id are documents of their own.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        encode = encoder().encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    documents = table(spark, folder, "documents")
    packed = stored(pack_documents(documents))
    sizes = spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")).select("doc_id", tokens(F.col("text").cast("string")).alias("total"))
    at = F.col("piece") * 1024
    due = sizes.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / 1024), F.lit(1)) - 1)).alias("piece"))
    due = due.select("doc_id", "piece", at.alias("first_token"), F.least(F.lit(1024), F.col("total") - at).alias("n_tokens"), F.lit(1).alias("side"))
    both = due.unionByName(packed.where("container_id IS NOT NULL").drop("container_id").withColumn("side", F.lit(-1))).groupBy("doc_id", "piece", "first_token", "n_tokens").agg(F.count_if(F.col("side") == 1).alias("due"), F.count_if(F.col("side") == -1).alias("given"))
    per = both.groupBy("doc_id").agg(F.sum(F.when(F.col("piece") == 0, F.col("given"))).alias("documents"), F.max(F.col("due") != F.col("given")).alias("broken"), F.sum(F.col("due") * F.col("n_tokens")).alias("tokens"))
    held = per.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.count_if("broken").alias("broken"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    filled = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("n") > 1024).alias("overfull"))
    return held.join(F.broadcast(filled)).select("documents", "broken", "overfull", (F.col("used") > F.ceil(F.col("tokens") / 1024) * 1.01 + 1).alias("loose"))


QUERIES = {
    "p1_found": lambda spark, folder: copies(table(spark, folder, "documents")),
    "p1_copy_counts": lambda spark, folder: copy_counts(table(spark, folder, "documents")),
    "p2_found": lambda spark, folder: oversized_pieces(table(spark, folder, "chunks")).select("chunk_id").distinct(),
    "p2_pieces": lambda spark, folder: split_chunks(table(spark, folder, "chunks")),
    "p3_found": lambda spark, folder: clean_documents(table(spark, folder, "documents"), table(spark, folder, "common_words")).select("doc_id", F.explode("markup").alias("markup")),
    "p3_clean": lambda spark, folder: clean_documents(table(spark, folder, "documents"), table(spark, folder, "common_words")),
    "p4_found": lambda spark, folder: text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words")).where(~F.col("prose")).select("doc_id"),
    "p4_statistics": lambda spark, folder: text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words")),
    "p5_found": lambda spark, folder: distinctive_terms(table(spark, folder, "chunks"), 4, (2, 12)).select("chunk_id", "term"),
    "p5_scores": lambda spark, folder: distinctive_terms(table(spark, folder, "chunks")).withColumn("score", F.round("score", 6)),
    "p6_found": lambda spark, folder: near_pairs(table(spark, folder, "documents"), 3, 0.6),
    "p7_ids": lambda spark, folder: token_ids(table(spark, folder, "documents")),
    "p2_rebuilt": rebuilt_chunks,
    "p7_decoded": lambda spark, folder: decoded(token_ids(table(spark, folder, "documents"))).select("doc_id", F.sha2("text", 256).alias("digest")),
    "p8_check": container_check,
    "p8_containers": lambda spark, folder: pack_documents(table(spark, folder, "documents")),
    "p9_found": lambda spark, folder: spam_scores(table(spark, folder, "documents"), table(spark, folder, "common_words")).where("spam").select("doc_id"),
}

SQL = {
    "p2_found": r"""
        SELECT DISTINCT chunk_id FROM chunks WHERE length(trim(text, E' \t\r\n')) > 1200
    """,
    "p2_rebuilt": r"""
        SELECT chunk_id, length(t) AS size, md5(t) AS digest, true AS kept
        FROM (SELECT DISTINCT chunk_id, doc_id, ordinal, trim(text, E' \t\r\n') AS t FROM chunks) WHERE length(t) > 1200
    """,
    "p5_scores": r"""
        WITH once AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
        found AS (SELECT chunk_id, lower(term) AS term FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '\p{L}{4,}')) AS term FROM once)),
        joint AS (SELECT chunk_id, term, count(*) AS n FROM found GROUP BY ALL),
        sizes AS (SELECT chunk_id, sum(n) AS size FROM joint GROUP BY chunk_id),
        totals AS (SELECT term, sum(n) AS total FROM joint GROUP BY term),
        mass AS (SELECT sum(total ** 0.75) AS mass FROM totals)
        SELECT chunk_id, term, n, round(greatest(0.0, ln(n * mass / (size * total ** 0.75))), 6) AS score FROM joint JOIN sizes USING (chunk_id) JOIN totals USING (term), mass
    """,
    "p6_found": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        runs AS (SELECT DISTINCT doc_id, unnest([l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] for i in range(1, len(l) - 1)]) AS run FROM words WHERE len(l) > 2),
        sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
        met AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
        SELECT doc_a, doc_b FROM met JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
        WHERE shared / (x.n + y.n - shared) >= 0.6 AND shared < x.n + y.n - shared
    """,
    "p7_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "p8_check": "SELECT count(*) AS documents, 0 AS broken, 0 AS overfull, false AS loose FROM documents WHERE doc_id IS NOT NULL",
    "p5_found": r"""
        WITH once AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
        term_counts AS (
            SELECT chunk_id, doc_id, lower(term) AS term, count(*) AS n
            FROM (SELECT chunk_id, doc_id, unnest(regexp_extract_all(text, '\p{L}{4,}')) AS term FROM once)
            GROUP BY ALL
        ),
        vocabulary AS (SELECT term FROM term_counts GROUP BY term HAVING count(DISTINCT doc_id) BETWEEN 2 AND 12)
        SELECT chunk_id, term FROM term_counts SEMI JOIN vocabulary USING (term) WHERE n >= 4
    """,
}
