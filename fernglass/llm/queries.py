"""Queries of the operators of this folder over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .encode import decode_documents, encode_documents
from .names import link_names, same_entity_pairs
from .neighbours import most_similar, similar_pairs
from .packing import pack
from .pii import personal_kinds, redact, texts_of
from .quality import text_statistics
from .scans import find_noise, repair_scans
from .split import split_oversized

Query = Callable[[SparkSession, str], DataFrame]


def _pii_texts(spark: SparkSession, folder: str) -> DataFrame:
    return texts_of(table(spark, folder, "chunks"), table(spark, folder, "quarantine"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: split_oversized(table(s, d, "chunks")).select("chunk_id").distinct(),
    "p1_pieces": lambda s, d: split_oversized(table(s, d, "chunks")),
    "p2_found": lambda s, d: similar_pairs(most_similar(table(s, d, "chunks"))),
    "p2_neighbours": lambda s, d: most_similar(table(s, d, "chunks")),
    "p4_found": lambda s, d: find_noise(table(s, d, "chunks"), table(s, d, "documents"), repairs=False).select("chunk_id", "noise").distinct(),
    "p4_repaired": lambda s, d: repair_scans(table(s, d, "chunks"), table(s, d, "documents")),
    "p5_found": lambda s, d: personal_kinds(_pii_texts(s, d)),
    "p5_redacted": lambda s, d: redact(_pii_texts(s, d)),
    "p6_found": lambda s, d: same_entity_pairs(link_names(table(s, d, "ledger"), table(s, d, "nicknames"))),
    "p6_entities": lambda s, d: link_names(table(s, d, "ledger"), table(s, d, "nicknames")),
    "p7_ids": lambda s, d: encode_documents(table(s, d, "documents")),
    "p7_decoded": lambda s, d: decode_documents(encode_documents(table(s, d, "documents"))),
    "p8_containers": lambda s, d: pack(encode_documents(table(s, d, "documents"), counts_only=True)),
    "p9_found": lambda s, d: text_statistics(table(s, d, "documents")).filter(F.col("form") != "prose").select("doc_id", "form").distinct(),
    "p9_statistics": lambda s, d: text_statistics(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "p1_found": r"""
        SELECT DISTINCT chunk_id FROM chunks
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{Z}\x{0B}\x{85}\x{1C}-\x{1F}\p{L}\p{N}]')) > 480""",
    "p2_found": """
        WITH usable AS (
            SELECT DISTINCT chunk_id, lower(trim(domain)) AS domain, vector::DOUBLE[] AS v FROM chunks
            WHERE domain IS NOT NULL AND chunk_id IS NOT NULL AND len(vector) = 64
              AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS c
            FROM usable a JOIN usable b ON a.domain = b.domain AND a.chunk_id <> b.chunk_id),
        ranked AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM pairs)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM ranked WHERE r <= 10 AND c >= 0.90""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
