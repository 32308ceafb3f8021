"""Queries of access, bookkeeping and reports of the service around the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import access as A
from ..operators import ledger as L
from ..operators import maintain as M
from ..operators import report as R
from ..sources.tables import table
from ..streaming.sync import followed_by, sessions, windowed_counts
from .texts import ORACLES as ORACLES_OF_TEXTS

_KEY = b"a key of the tests, no secret at all"
_NOW = 1_780_000_000
_TOKENS = {"worker": "w" * 32, "reader": "r" * 40}
#: The tiers' domains as DuckDB lists.
_OPEN, _VAULT = ("('" + "', '".join(R.domains_in(t)) + "')" for t in ("open", "vault"))


def _docs(s, d):
    return table(s, d, "documents")


def _requests(s, d):
    """A request for each document, whose token is wrong in one of six ways but for each seventh."""
    k = F.col("doc_id") % 7
    claims = F.to_json(
        F.struct(
            F.concat(F.lit("u"), F.col("doc_id")).alias("sub"), F.when(k == 4, "other@x.org").otherwise(" Me@X.org").alias("email"), F.lit("Name").alias("name"), F.when(k == 6, "guest").otherwise("user").alias("role"),
            F.when(k == 3, "else").otherwise("chat").alias("iss"), (F.lit(_NOW) + F.when(k == 2, -1).otherwise(60)).alias("exp"),
        )
    )
    token = A.signed_token(claims, _KEY)
    wrong = F.concat(F.substring_index(token, ".", 2), F.lit("."), A.base64url(F.unhex(F.sha2("uri", 256))))
    return _docs(s, d).select("doc_id", F.lit("find").alias("tool"), F.coalesce(F.sha2("uri", 256), F.lit("")).alias("query_hash"), F.when(F.col("doc_id") % 11 == 0, "cli").otherwise("http").alias("transport"), F.when(k == 1, wrong).when(k == 5, "").otherwise(token).alias("assertion"))


def _gated(s, d):
    requests = _requests(s, d)
    grants = requests.filter("doc_id % 3 = 0").select(F.concat(F.lit("u"), F.col("doc_id")).alias("subject"), "query_hash", (F.lit(_NOW) - F.when(F.col("doc_id") % 2 == 0, 10).otherwise(A.GRANT_SECONDS + 1)).alias("approved_at"))
    return A.gated(requests, grants, unlocked=True, key=_KEY, issuer="chat", emails=["me@x.org"], roles=["user", "admin"], now=_NOW).select("doc_id", "principal", "decision", "reason")


def _log(s, d):
    """The documents' log with ids, as an append of what isn't in it yet."""
    rows = table(s, d, "doc_log").distinct()
    empty = rows.limit(0).withColumn("id", F.lit(0).cast("long"))
    return M.append_log(empty, rows, ["run_id", "doc_id", "recorded_at", "content_hash", "outcome"], {"outcome": ("indexed", "skipped", "empty", "failed")})


def _events(s, d, kind=None):
    rows = table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.filter(F.col("event_type") == kind) if kind else rows


def _kinds(s, d):
    """Two kinds of events that there are."""
    first = table(s, d, "events").agg(F.min("event_type"), F.max("event_type")).first()
    return first[0] or "", first[1] or ""


_REFUSALS = "CASE doc_id % 7 WHEN 1 THEN 'not verified' WHEN 2 THEN 'expired' WHEN 3 THEN 'wrong issuer' WHEN 4 THEN 'e-mail not permitted' WHEN 5 THEN 'no identity' WHEN 6 THEN 'role not permitted' END"
_DISTINCT_CHUNKS = "c AS (SELECT DISTINCT chunk_id, doc_id, chunk_index, text, source_id FROM chunks)"

QUERIES = {
    "identity_gate": lambda s, d: A.with_identity(_requests(s, d), _KEY, "chat", ["me@x.org"], ["user", "admin"], _NOW).select("doc_id", "subject", "principal", "refusal"),
    "three_gates": _gated,
    "audit_of_gates": lambda s, d: A.audit_entries(_gated(s, d).withColumns({"transport": F.lit("http"), "tool": F.lit("find"), "query_hash": F.lit("-")}), "2026-01-01").groupBy("decision", "reason").agg(F.count("*").alias("n")),
    "client_gate": lambda s, d: _docs(s, d).select("doc_id", A.client_of(F.when(F.col("doc_id") % 3 == 0, f"Bearer {_TOKENS['worker']}").when(F.col("doc_id") % 3 == 1, f"  bearer   {_TOKENS['reader']} ").otherwise(F.concat(F.lit("Bearer "), F.col("uri"))), _TOKENS).alias("client")),
    "token_claims": lambda s, d: _requests(s, d).select("doc_id", F.get_json_object(A.claims_of(F.col("assertion")), "$.sub").alias("sub"), A.is_scoped(F.col("assertion")).alias("scoped")),
    "tenant_names": lambda s, d: table(s, d, "sources").select("source_id", A.valid_tenant(F.regexp_replace("source_id", ":", "_"), ["inbox_notes"]).alias("valid")),
    "tenant_list": lambda s, d: A.tenant_list(table(s, d, "sources").select(F.col("source_id").alias("tenant"), (F.lit(1_700_000_000_000_000_000) + F.length("source_id").cast("long") * 1_000_000_000).alias("generation"), F.lit("2024").alias("created_at")), table(s, d, "chunks").select("chunk_id", F.col("source_id").alias("tenant")).distinct()),
    "vector_codec": lambda s, d: M.unpacked_vectors(M.packed_vectors(table(s, d, "embeddings"), "embedding"), "embedding").select("vec_id", "embedding"),
    "extra_json": lambda s, d: M.with_extra(_docs(s, d).select("doc_id", "lang", "tier", "chunk_count"), ["doc_id"]).select("doc_id", M.extra_field(F.col("extra"), "lang").alias("lang"), M.extra_field(F.col("extra"), "chunk_count", "bigint").alias("chunk_count")),
    "flagged_pages": lambda s, d: R.flagged_pages(_docs(s, d).withColumn("flagged_pages", F.col("chunk_count") % 4)),
    "vault_inventory": lambda s, d: R.inventory(_docs(s, d)),
    "sources_ordered": lambda s, d: R.sources_in_order(table(s, d, "sources")),
    "index_status": lambda s, d: R.index_status(_docs(s, d), table(s, d, "chunks").select("chunk_id", "domain").distinct()),
    "append_log_ids": lambda s, d: _log(s, d).select("id", "run_id", "doc_id", "outcome"),
    "audit_tail": lambda s, d: A.audit_tail(_log(s, d), 50).select("id", "run_id", "doc_id", "outcome"),
    "evaluation_history": lambda s, d: R.evaluation_history(_docs(s, d).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("questions_hash"), F.round(F.col("n_chars") / 7, 3).alias("mrr"))).select("id", "mrr", "change"),
    "sources_due": lambda s, d: R.due_sources(
        table(s, d, "sources").select("source_id", F.when(F.length("source_id") % 3 == 0, "15 minutes").when(F.length("source_id") % 3 == 1, "2 hours").alias("cadence"), F.when(F.length("source_id") % 5 > 0, F.timestamp_seconds(F.lit(_NOW) - F.length("source_id") * 300)).alias("last_started")),
        F.timestamp_seconds(F.lit(_NOW)),
    ).select("source_id"),
    "domain_check": lambda s, d: R.with_domain_check(_docs(s, d).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.array("domain", F.lit("notes"))).alias("domains")), "open").select("doc_id", F.array_join("searched", ",").alias("searched"), "refusal"),
    "review_schedule": lambda s, d: M.schedule_reviews(_docs(s, d).select("doc_id", F.substring("indexed_at", 1, 10).alias("review_after")), _docs(s, d).filter("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "2027-01-01").alias("review_after"))),
    "quarantine_resolve": lambda s, d: M.resolve_quarantine(table(s, d, "quarantine").distinct(), table(s, d, "quarantine").filter("id % 2 = 0").select("id", F.lit("kept").alias("resolution")).distinct(), "2026-06-01").groupBy("resolution", "resolved_at").agg(F.count("*").alias("n")),
    "source_bookkeeping": lambda s, d: M.finish_sources(M.start_sources(table(s, d, "sources"), table(s, d, "sources").filter("length(source_id) % 2 = 0"), "r1", "t0"), table(s, d, "sources").filter("length(source_id) % 4 = 0").select("source_id", F.lit("ok").alias("last_status"), F.lit(7).cast("long").alias("docs_seen")), "t1").select("source_id", "last_run_id", "last_status", "docs_seen", "last_started_at", "last_finished_at"),
    "reread_receipts": lambda s, d: M.reread_candidates(_docs(s, d), _docs(s, d).filter("doc_id % 2 = 0").select("doc_id"), ["receipts", "financial"], (".txt", ".pdf")).select("source_id", "domain", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids")),
    "readings_by_status": lambda s, d: R.count_by(table(s, d, "chunks").select("doc_id", "chunk_index").distinct().withColumn("status", F.when(F.col("chunk_index") % 3 == 0, "ok").when(F.col("chunk_index") % 3 == 1, "rejected").otherwise("unreachable")), "status"),
    "reading_cache": lambda s, d: M.reading_cache(table(s, d, "chunks").select("doc_id", F.col("chunk_index").alias("page"), F.lit("old").alias("file_hash")).distinct(), table(s, d, "chunks").filter("chunk_index % 2 = 0").select("doc_id", F.col("chunk_index").alias("page"), F.lit("new").alias("file_hash")).distinct()),
    "visible_chunks": lambda s, d: Engine(s, d).visible("open", stale=True).select("chunk_id", "uri", "lifecycle", F.substring("text", 1, 6).alias("head")),
    "vault_context": lambda s, d: Engine(s, d).context(table(s, d, "chunks").filter("doc_id % 20 = 0 and chunk_index = 1").select(F.col("doc_id").alias("query_id"), "doc_id", "chunk_index").distinct(), 1, 3, "vault").select("doc_id", "hit_index", "chunk_index"),
    "hit_projection": lambda s, d: Engine(s, d).projected(Engine(s, d).visible("vault").withColumn("score", F.lit(0.12345))).select("doc_id", "chunk_index", "citation", "score", "lifecycle"),
    "ledger_cube": lambda s, d: L.cube(table(s, d, "ledger").dropDuplicates(), ["category", "payment_method"], 5),
    "ledger_corrected": lambda s, d: L.correct(
        table(s, d, "ledger").dropDuplicates(["id"]).select("id", "amount_cents", "txn_date", "merchant", "category", "needs_review", "review_notes"),
        table(s, d, "ledger").filter("id % 5 = 0").select("id").distinct().select("id", F.lit("$12.50").alias("total"), F.lit("03/04/2025").alias("date"), F.lit(None).cast("string").alias("merchant"), F.lit("other").alias("category")),
        F.lit("2026-12-31").cast("date"), "now",
    ).filter("id % 5 = 0").select("id", "amount_cents", "txn_date", "category", "needs_review"),
    "sliding_windows": lambda s, d: windowed_counts(_events(s, d), "2 hours", slide="1 hour"),
    "session_windows": lambda s, d: sessions(_events(s, d), "30 minutes"),
    "events_followed_by": lambda s, d: followed_by(_events(s, d, _kinds(s, d)[0]), _events(s, d, _kinds(s, d)[1]), "1 hour"),
    "approximate_counts": lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("orders"), F.approx_percentile("l_quantity", F.lit(0.5)).alias("median_quantity")),
}
ORACLES = {
    "identity_gate": f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'u' || doc_id END AS subject, CASE WHEN doc_id % 7 = 0 THEN 'me@x.org (Name, user)' END AS principal, {_REFUSALS} AS refusal FROM documents",
    "three_gates": f"""
        WITH r AS (SELECT doc_id, doc_id % 11 = 0 AS cli, {_REFUSALS} AS refusal, doc_id % 6 = 0 AS granted FROM documents)
        SELECT doc_id, CASE WHEN cli THEN 'cli:local' WHEN refusal IS NULL THEN 'me@x.org (Name, user)' END AS principal, CASE WHEN cli THEN 'allowed' WHEN refusal IS NOT NULL THEN 'denied' WHEN granted THEN 'allowed' ELSE 'pending' END AS decision,
               CASE WHEN cli THEN NULL WHEN refusal IS NOT NULL THEN 'identity: ' || refusal WHEN NOT granted THEN 'awaiting approval' END AS reason FROM r""",
    "audit_of_gates": f"""
        WITH r AS (SELECT doc_id, doc_id % 11 = 0 AS cli, {_REFUSALS} AS refusal, doc_id % 6 = 0 AS granted FROM documents)
        SELECT CASE WHEN cli THEN 'allowed' WHEN refusal IS NOT NULL THEN 'denied' WHEN granted THEN 'allowed' ELSE 'pending' END AS decision,
               CASE WHEN cli THEN NULL WHEN refusal IS NOT NULL THEN 'identity: ' || refusal WHEN NOT granted THEN 'awaiting approval' END AS reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "client_gate": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'worker' WHEN 1 THEN 'reader' END AS client FROM documents",
    "token_claims": "SELECT doc_id, CASE WHEN doc_id % 7 <> 5 THEN 'u' || doc_id END AS sub, false AS scoped FROM documents WHERE uri IS NOT NULL OR doc_id % 7 <> 1 UNION ALL SELECT doc_id, NULL, false FROM documents WHERE uri IS NULL AND doc_id % 7 = 1",
    "tenant_names": "SELECT source_id, regexp_full_match(replace(source_id, ':', '_'), '[a-z][a-z0-9_-]{1,47}') AND NOT contains(replace(source_id, ':', '_'), '__') AND replace(source_id, ':', '_') <> 'inbox_notes' AS valid FROM sources",
    "tenant_list": "WITH n AS (SELECT source_id, count(DISTINCT chunk_id) AS points FROM chunks GROUP BY 1) SELECT s.source_id AS tenant, '2024' AS created_at, strftime(make_timestamp((1700000000 + length(s.source_id)) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS valid_since, points FROM sources s LEFT JOIN n ON s.source_id = n.source_id",
    "vector_codec": "SELECT vec_id, embedding FROM embeddings",
    "extra_json": "SELECT doc_id, lang, chunk_count FROM documents",
    "flagged_pages": "SELECT uri, domain, chunk_count % 4 AS flagged_pages FROM documents WHERE chunk_count % 4 > 0 AND coalesce(lifecycle, '') <> 'retracted'",
    "vault_inventory": "SELECT doc_id, uri, domain, lifecycle, chunk_count, status, indexed_at FROM documents WHERE tier = 'vault' AND lifecycle = 'active'",
    "sources_ordered": "SELECT * FROM sources ORDER BY source_id",
    "index_status": "SELECT 'status' AS part, status AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lifecycle', lifecycle, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'chunks', domain, count(*) FROM (SELECT DISTINCT chunk_id, domain FROM chunks) GROUP BY 2",
    "append_log_ids": "SELECT row_number() OVER (ORDER BY run_id NULLS FIRST, doc_id NULLS FIRST, recorded_at NULLS FIRST, content_hash NULLS FIRST, outcome NULLS FIRST) AS id, run_id, doc_id, outcome FROM (SELECT DISTINCT * FROM doc_log)",
    "audit_tail": "SELECT row_number() OVER (ORDER BY run_id NULLS FIRST, doc_id NULLS FIRST, recorded_at NULLS FIRST, content_hash NULLS FIRST, outcome NULLS FIRST) AS id, run_id, doc_id, outcome FROM (SELECT DISTINCT * FROM doc_log) ORDER BY id DESC LIMIT 50",
    "evaluation_history": "SELECT doc_id AS id, round(n_chars / 7, 3) AS mrr, round(round(n_chars / 7, 3) - lag(round(n_chars / 7, 3)) OVER (PARTITION BY doc_id % 5 ORDER BY doc_id), 6) AS change FROM documents",
    "sources_due": "SELECT source_id FROM sources WHERE length(source_id) % 5 = 0 OR length(source_id) * 300 >= CASE length(source_id) % 3 WHEN 0 THEN 900 WHEN 1 THEN 7200 ELSE 0 END",
    "domain_check": f"""
        WITH r AS (SELECT doc_id, domain, doc_id % 3 > 0 AS asked, domain IN {_OPEN} AS known FROM documents)
        SELECT doc_id, CASE WHEN NOT asked THEN 'infra,manuals,notes,sdk-docs' WHEN known THEN array_to_string(list_sort(list_distinct([domain, 'notes'])), ',') END AS searched,
               CASE WHEN asked AND NOT known THEN 'no domain of the open tier: ' || domain END AS refusal FROM r""",
    "review_schedule": "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '2027-01-01' WHEN doc_id % 4 = 0 THEN NULL ELSE substr(indexed_at, 1, 10) END AS review_after FROM documents",
    "quarantine_resolve": "SELECT CASE WHEN resolved_at IS NULL AND id % 2 = 0 THEN 'kept' ELSE resolution END AS resolution, CASE WHEN resolved_at IS NULL AND id % 2 = 0 THEN '2026-06-01' ELSE resolved_at END AS resolved_at, count(*) AS n FROM (SELECT DISTINCT * FROM quarantine) GROUP BY 1, 2",
    "source_bookkeeping": """
        SELECT source_id, CASE WHEN length(source_id) % 2 = 0 THEN 'r1' ELSE last_run_id END AS last_run_id, CASE WHEN length(source_id) % 4 = 0 THEN 'ok' WHEN length(source_id) % 2 = 0 THEN 'running' ELSE last_status END AS last_status,
               CASE WHEN length(source_id) % 4 = 0 THEN 7 ELSE docs_seen END AS docs_seen, CASE WHEN length(source_id) % 2 = 0 THEN 't0' END AS last_started_at, CASE WHEN length(source_id) % 4 = 0 THEN 't1' END AS last_finished_at FROM sources""",
    "reread_receipts": r"SELECT source_id, domain, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM documents WHERE domain IN ('receipts', 'financial') AND lifecycle = 'active' AND regexp_matches(lower(uri), '\.(?:txt|pdf)$') AND doc_id % 2 = 0 GROUP BY 1, 2",
    "readings_by_status": "SELECT CASE chunk_index % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'rejected' ELSE 'unreachable' END AS status, count(*) AS n FROM (SELECT DISTINCT doc_id, chunk_index FROM chunks) GROUP BY 1",
    "reading_cache": "SELECT DISTINCT doc_id, chunk_index AS page, CASE WHEN chunk_index % 2 = 0 THEN 'new' ELSE 'old' END AS file_hash FROM chunks",
    "visible_chunks": f"""
        WITH {_DISTINCT_CHUNKS}
        SELECT chunk_id, uri, lifecycle, substr(CASE WHEN lifecycle = 'stale' THEN '[STALE' ELSE '' END || c.text, 1, 6) AS head FROM c JOIN documents d ON c.doc_id = d.doc_id WHERE tier = 'open' AND domain IN {_OPEN} AND lifecycle IN ('active', 'stale')""",
    "vault_context": """
        WITH c AS (SELECT DISTINCT doc_id, chunk_index FROM chunks), a AS (SELECT doc_id FROM documents WHERE lifecycle = 'active')
        SELECT c.doc_id, 1 AS hit_index, n.chunk_index FROM c JOIN c n ON n.doc_id = c.doc_id AND n.chunk_index BETWEEN 0 AND 4 WHERE c.chunk_index = 1 AND c.doc_id % 20 = 0 AND c.doc_id IN (SELECT doc_id FROM a)""",
    "hit_projection": f"""
        WITH cited AS ({ORACLES_OF_TEXTS["citation_format"]}), {_DISTINCT_CHUNKS}
        SELECT c.doc_id, c.chunk_index, citation, CAST(0.123 AS DOUBLE) AS score, CASE WHEN lifecycle <> 'active' THEN lifecycle END AS lifecycle FROM c JOIN cited USING (chunk_id) JOIN documents d ON c.doc_id = d.doc_id WHERE tier = 'vault' AND domain IN {_VAULT} AND lifecycle = 'active'""",
    "ledger_cube": """
        WITH r AS (SELECT DISTINCT * FROM ledger)
        SELECT category, payment_method, CAST(grouping(category, payment_method) AS BIGINT) AS level, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM r GROUP BY CUBE (category, payment_method) HAVING count(*) >= 5""",
    "ledger_corrected": "SELECT DISTINCT id, 1250 AS amount_cents, '2025-03-04' AS txn_date, 'other' AS category, 0 AS needs_review FROM ledger WHERE id % 5 = 0",
    "sliding_windows": """
        WITH h AS (SELECT *, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h FROM events), w AS (SELECT *, h AS start FROM h UNION ALL SELECT *, h - INTERVAL 1 HOUR FROM h)
        SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
    "session_windows": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
    "events_followed_by": """
        WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events)
        SELECT x.user_id, x.ts AS at, y.ts AS "then" FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts >= x.ts AND y.ts <= x.ts + INTERVAL 1 HOUR, k WHERE x.event_type = k.a AND y.event_type = k.b""",
}
