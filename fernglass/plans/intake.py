"""Queries of intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as I
from ..operators.search import dense_topk
from ..functions import text as T
from ..sources.tables import table
from .texts import ORACLES as ORACLES_OF_TEXTS
from .texts import SPACE, WIDE, _scanned

#: The rules in the order in which findings are stated.
RULES = ("card_number", *(r for r, _ in (*T.IDENTIFIERS, *T.SECRETS, *T.VOCABULARIES)))

_KEY = "0123456789abcdef0123456789abcdef"


def _docs(s, d):
    return table(s, d, "documents")


def _pages(s, d):
    """Chunks as pages of their documents."""
    return table(s, d, "chunks").select("doc_id", F.col("chunk_index").alias("page"), "text").distinct()


def _plan(s, d):
    pages = _pages(s, d)
    return I.page_plan(pages, pages.filter("(doc_id + page) % 3 = 0"), pages.filter("page = 1"), 1)


QUERIES = {
    "quarantine_split": lambda s, d: I.split_sensitive(_scanned(s, d).withColumn("tier", F.when(F.col("doc_id") % 3 == 0, "vault").otherwise("open")))[1].select("doc_id", "rules", "reason"),
    "page_plan": _plan,
    "sealed_round_trip": lambda s, d: _docs(s, d).filter("text is not null").select("doc_id", F.sha2(I.opened(I.sealed(F.col("text").cast("binary"), F.lit(_KEY).cast("binary")), F.lit(_KEY).cast("binary"), F.sha2("text", 256)), 256).alias("hash")),
    "request_hashes": lambda s, d: table(s, d, "orders").select("o_orderkey", I.request_hash(F.lit("query_ledger"), F.create_map(F.lit("start"), F.col("o_orderstatus"), F.lit("category"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))).alias("hash")),
    "hashed_vector_topk": lambda s, d: dense_topk(*(
        I.hashed_vectors(_docs(s, d).filter(f"doc_id % {m} = 0").select(F.col("doc_id").alias("item_id"), "text")).withColumnRenamed("item_id", name) for m, name in ((20, "query_id"), (1, "item_id"))
    ), k=3),
    "quarantine_names": lambda s, d: _docs(s, d).filter("uri is not null").select("doc_id", I.quarantine_path(F.regexp_extract("uri", "([^/]*)$", 1), F.col("uri"), F.col("doc_id") % 2 == 0).alias("name")),
}
ORACLES = {
    "quarantine_split": f"""
        WITH found AS ({ORACLES_OF_TEXTS["sensitivity_scan"]}), rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {n})" for n, r in enumerate(RULES))}) r(rule, place))
        SELECT doc_id, string_agg(rule, ',' ORDER BY place) AS rules, string_agg(rule || ': ' || detail, '; ' ORDER BY place) AS reason FROM found JOIN rules USING (rule) WHERE doc_id % 3 <> 0 GROUP BY 1""",
    "page_plan": r"""
        WITH p AS (SELECT DISTINCT doc_id, chunk_index AS page, text FROM chunks),
        b AS (SELECT doc_id, page, regexp_replace(coalesce(text, ''), '^__S__+|__S__+$', '', 'g') AS t FROM p),
        f AS (SELECT doc_id, page, (doc_id + page) % 3 = 0 AS cached, page = 1 AS asked, length(t) < 100 AND NOT regexp_matches(lower(t), 'intentionally__W__+(?:left__W__+)?blank') AS bare FROM b),
        w AS (SELECT *, count(*) FILTER (NOT asked AND NOT cached) OVER (PARTITION BY doc_id) > 1 AS many FROM f WHERE asked OR bare)
        SELECT doc_id, page, CASE WHEN cached THEN 'cached' WHEN NOT asked AND many THEN 'deferred' ELSE 'read' END AS action FROM w""".replace("__S__", SPACE).replace("__W__", WIDE),
    "sealed_round_trip": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
    "request_hashes": """
        SELECT o_orderkey, sha256('query_ledger' || chr(0) || CASE WHEN o_orderkey % 2 = 0 THEN '{"category":"' || o_orderpriority || '",' ELSE '{' END || '"start":"' || o_orderstatus || '"}') AS hash FROM orders""",
    "quarantine_names": r"""
        WITH n AS (SELECT doc_id, uri, regexp_extract(uri, '([^/]*)$', 1) AS f FROM documents WHERE uri IS NOT NULL)
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(f, '\.[^.]*$', '') || '.' || substr(md5(uri), 1, 6) || regexp_extract(f, '\.[^.]*$') ELSE f END AS name FROM n""",
}
