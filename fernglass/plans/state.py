"""Queries of snapshot maintenance and of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintain as M
from ..operators import report as R
from ..operators.incremental import instant
from ..sources.tables import table
from .texts import ORACLES as ORACLES_OF_TEXTS

TODAY = "2026-04-01"
RUN = "20260311T150300Z-dc0177ec"


def _docs(s, d):
    return table(s, d, "documents")


def _a_name(s, d):
    """A file name that some document has."""
    return _docs(s, d).agg(F.min(F.regexp_replace("uri", "^.*/", ""))).first()[0] or ""


def _chunks(s, d):
    """Chunks with their late and repeated rows made one: the latest by instant of indexing."""
    rows = table(s, d, "chunks").drop("vector")
    return R.latest_rows(rows, ["chunk_id"], [F.desc_nulls_last(instant(F.col("indexed_at"))), F.desc_nulls_last("last_seen_run"), F.desc_nulls_last("domain"), F.desc_nulls_last("token_count")])


def _backup_runs(s, d):
    """Events as attempts of backups: one per event, the type as the kind and the user as the target."""
    e = table(s, d, "events")
    status = F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 97 == 0, "rollback").otherwise("ok")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 50).alias("target"), status.alias("status"), F.col("ts").cast("timestamp").alias("run_at"), F.when(F.col("event_id") % 5 == 0, 1.5).alias("max_age_days"))


_DUCK_ATTEMPTS = """
    WITH a AS (SELECT event_id AS id, event_type AS kind, user_id % 50 AS target, ts AS run_at, CASE WHEN event_id % 5 = 0 THEN 1.5 END AS max_age_days,
                      CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 97 = 0 THEN 'rollback' ELSE 'ok' END AS status FROM events)"""
_DUCK_CHUNKS = """
    WITH c AS (SELECT * FROM (SELECT * EXCLUDE (vector), row_number() OVER (PARTITION BY chunk_id ORDER BY
        try_cast(CASE WHEN regexp_matches(indexed_at, '([Zz]|[+-][0-9]{2}:?[0-9]{2})\\s*$') THEN indexed_at ELSE indexed_at || '+00:00' END AS TIMESTAMPTZ) DESC NULLS LAST,
        last_seen_run DESC NULLS LAST, domain DESC NULLS LAST, token_count DESC NULLS LAST) AS _r FROM chunks) WHERE _r = 1)"""
_LATEST_PER_SOURCE = "run_id = (SELECT max(last_seen_run) FROM documents)"

QUERIES = {
    "count_by_status": lambda s, d: R.count_by(_docs(s, d), "status"),
    "count_by_lifecycle": lambda s, d: R.count_by(_docs(s, d).filter("tier = 'open'"), "lifecycle"),
    "chunks_by_domain_zero_filled": lambda s, d: R.chunks_by_domain(_chunks(s, d), "open"),
    "not_active_count": lambda s, d: _docs(s, d).agg(F.count_if(F.col("lifecycle") != "active").alias("n")),
    "tiers_by_source": lambda s, d: table(s, d, "sources").select("source_id", R.tier_of(F.col("domain")).alias("tier")),
    "document_list_match": lambda s, d: R.matching_documents(_docs(s, d), match="PUMP"),
    "path_end_match": lambda s, d: R.by_path_end(_docs(s, d), _a_name(s, d)).select("doc_id", "uri"),
    "due_for_review": lambda s, d: M.flip_due(_docs(s, d).withColumn("review_after", F.substring("indexed_at", 1, 10)), TODAY).groupBy("lifecycle").agg(F.count("*").alias("n"), F.count("review_after").alias("dated")),
    "open_quarantine": lambda s, d: R.open_quarantine(table(s, d, "quarantine")).select("id", F.array_join("rules", ",").alias("rules")),
    "latest_per_group": lambda s, d: R.latest_rows(_backup_runs(s, d), ["kind", "target"], [F.desc("id")]).select("id", "kind", "target", "status"),
    "freshness_levels": lambda s, d: R.freshness(_backup_runs(s, d), F.lit("2026-06-01 00:00:00").cast("timestamp"), {"purchase": 3.0}).select("kind", "target", "level", F.round("age_days", 4).alias("age_days")),
    "last_runs": lambda s, d: table(s, d, "runs").select("run_id", "started_at").distinct().orderBy(F.desc(instant(F.col("started_at"))), F.desc("run_id"), "started_at").limit(10),
    "runs_over_open_sources": lambda s, d: R.runs_over(table(s, d, "runs").select("run_id", "started_at", "sources_run").distinct(), table(s, d, "sources").filter(F.col("domain").isin(*R.domains_in("open")))).select("run_id", F.array_join("open_sources", ",").alias("open_sources")),
    "source_counts": lambda s, d: R.recorded_sources(table(s, d, "sources").withColumn("enabled", F.col("source_id") != "inbox:notes"), table(s, d, "sources"), _chunks(s, d).groupBy("source_id").agg(F.count("*").alias("n"))).select("source_id", "domain", "configured", "chunks"),
    "model_rows": lambda s, d: R.model_rows(_chunks(s, d).join(_docs(s, d).select("doc_id", "uri", "lifecycle"), "doc_id").withColumn("score", F.col("chunk_index") / 7)).select("doc_id", "chunk_index", "citation", "score", "lifecycle"),
    "eval_rank_compare": lambda s, d: R.rank_changes(*(_docs(s, d).select(F.lit("h").alias("questions_hash"), F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") % m + 1).cast("long").alias("rank")) for m in (7, 5))),
    "run_outcomes": lambda s, d: M.run_counters(table(s, d, "doc_log").distinct().select(F.col("run_id").alias("source_id"), "outcome"), ["indexed", "skipped", "empty", "failed"]).withColumnRenamed("source_id", "run_id"),
    "tombstone_anti_join": lambda s, d: M.drop_documents(_chunks(s, d), _docs(s, d).filter("lifecycle <> 'active'")).groupBy("source_id").agg(F.count("*").alias("n")),
    "chunk_diff": lambda s, d: M.changed_chunks(_chunks(s, d).select("chunk_id", "doc_id", "chunk_index", F.when(F.col("doc_id") % 3 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")).alias("content_hash")), _chunks(s, d)).select("chunk_id"),
    "document_diff": lambda s, d: M.changed_documents(_docs(s, d).select("doc_id", "content_hash"), _docs(s, d)).select("doc_id"),
    "upsert_snapshot": lambda s, d: M.upsert(_docs(s, d).select("doc_id", "title", "status"), _docs(s, d).filter("doc_id % 5 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 10_000_000).otherwise(0)).alias("doc_id"), F.lit("new").alias("title"), "status"), ["doc_id"]),
    "merge_columns": lambda s, d: M.merge_columns(_docs(s, d).select("doc_id", "title", "lifecycle"), _docs(s, d).filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("title")), "doc_id"),
    "tail_delete": lambda s, d: M.drop_tails(_chunks(s, d), _docs(s, d).select("doc_id", F.floor(F.col("chunk_count") / 2).alias("chunk_count"))).groupBy("doc_id").agg(F.count("*").alias("n")),
    "sweep_counts": lambda s, d: M.sweep_counts(_docs(s, d), RUN),
    "missing_run": lambda s, d: M.missing_from_run(_docs(s, d), "inbox:manuals", RUN).select("doc_id"),
    "run_marker_touch": lambda s, d: M.touch(_docs(s, d).select("doc_id", "last_seen_run"), table(s, d, "doc_log").filter("outcome = 'skipped'"), "RUN-X").groupBy("last_seen_run").agg(F.count("*").alias("n")),
    "lifecycle_stamp": lambda s, d: M.stamp(_docs(s, d).select("doc_id", "lifecycle", "status_detail"), _docs(s, d).filter("doc_id % 4 = 0").select("doc_id", F.lit("stale").alias("lifecycle"), F.lit(None).cast("string").alias("status_detail")), ["lifecycle", "status_detail"], ["status_detail"]),
    "reembed_marking": lambda s, d: M.mark_for_reembedding(_docs(s, d)).agg(F.count_if(F.col("content_hash") == "").alias("blanked")),
    "retracted_state": lambda s, d: M.retract(_docs(s, d), _chunks(s, d), table(s, d, "ledger"), _docs(s, d).filter("doc_id % 9 = 0"), "wrong", TODAY)[1].groupBy("doc_id").agg(F.count("*").alias("n")),
    "wholesale_replace": lambda s, d: M.replace_document_rows(_chunks(s, d).select("doc_id", "chunk_index"), _chunks(s, d).filter("doc_id % 6 = 0 and chunk_index = 0").select("doc_id", "chunk_index")).groupBy("doc_id").agg(F.count("*").alias("n")),
    "field_differences": lambda s, d: M.field_differences(_docs(s, d).select(F.col("doc_id").cast("string").alias("field"), F.col("content_hash").alias("value")), _docs(s, d).select(F.col("doc_id").cast("string").alias("field"), F.sha2("text", 256).alias("value"))).select("field"),
    "manifest_check": lambda s, d: M.verify_manifest(_docs(s, d).select(F.col("uri").alias("path"), F.col("content_hash").alias("sha256")).filter("sha256 is not null"), _docs(s, d).select(F.col("uri").alias("path"), F.sha2("text", 256).alias("sha256")).filter("sha256 is not null")),
    "retention": lambda s, d: M.beyond_newest(_docs(s, d).select("source_id", F.col("uri").alias("name")), 5, ["source_id"]),
}
ORACLES = {
    "count_by_status": "SELECT status, count(*) AS n FROM documents GROUP BY 1",
    "count_by_lifecycle": "SELECT lifecycle, count(*) AS n FROM documents WHERE tier = 'open' GROUP BY 1",
    "chunks_by_domain_zero_filled": _DUCK_CHUNKS + " SELECT v.domain, count(c.chunk_id) AS n FROM (VALUES ('infra'), ('manuals'), ('notes'), ('sdk-docs')) v(domain) LEFT JOIN c ON c.domain = v.domain GROUP BY 1",
    "model_rows": """
        WITH c AS (SELECT DISTINCT chunk_id, doc_id, chunk_index FROM chunks), cited AS (""" + ORACLES_OF_TEXTS["citation_format"] + """)
        SELECT c.doc_id, chunk_index, citation, round(chunk_index / 7, 3) AS score, CASE WHEN lifecycle <> 'active' THEN lifecycle END AS lifecycle FROM c JOIN cited USING (chunk_id) JOIN documents d ON c.doc_id = d.doc_id""",
    "not_active_count": "SELECT count(*) FILTER (lifecycle <> 'active') AS n FROM documents",
    "tiers_by_source": "SELECT source_id, CASE WHEN domain IN ('manuals', 'sdk-docs', 'notes', 'infra') THEN 'open' ELSE 'vault' END AS tier FROM sources",
    "document_list_match": "SELECT doc_id, domain, uri, title, status, lifecycle, chunk_count FROM documents WHERE tier = 'open' AND domain IN ('infra', 'manuals', 'notes', 'sdk-docs') AND contains(lower(uri), 'pump') AND lifecycle = 'active'",
    "path_end_match": "WITH n AS (SELECT min(regexp_replace(uri, '^.*/', '')) AS name FROM documents) SELECT doc_id, uri FROM documents, n WHERE uri = name OR ends_with(lower(uri), '/' || lower(name))",
    "due_for_review": f"""
        WITH r AS (SELECT lifecycle, substr(indexed_at, 1, 10) AS review_after, coalesce(lifecycle = 'active' AND substr(indexed_at, 1, 10) <= '{TODAY}', false) AS due FROM documents)
        SELECT CASE WHEN due THEN 'stale' ELSE lifecycle END AS lifecycle, count(*) AS n, count(CASE WHEN NOT due THEN review_after END) AS dated FROM r GROUP BY 1""",
    "open_quarantine": """
        SELECT DISTINCT id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(rules, ''), '[,;|]'), lambda r: trim(r)), lambda r: r <> ''), ',') AS rules
        FROM quarantine WHERE resolved_at IS NULL AND domain IN ('infra', 'manuals', 'notes', 'sdk-docs')""",
    "latest_per_group": _DUCK_ATTEMPTS + " SELECT id, kind, target, status FROM a QUALIFY row_number() OVER (PARTITION BY kind, target ORDER BY id DESC) = 1",
    "freshness_levels": _DUCK_ATTEMPTS
    + """, l AS (SELECT *, max(CASE WHEN status = 'ok' THEN run_at END) OVER (PARTITION BY kind, target) AS good FROM a QUALIFY row_number() OVER (PARTITION BY kind, target ORDER BY id DESC) = 1),
        g AS (SELECT *, (epoch_us(TIMESTAMP '2026-06-01 00:00:00') - epoch_us(good)) / 86400000000.0 AS age, coalesce(max_age_days, CASE WHEN kind = 'purchase' THEN 3.0 END, 2.0) AS lim FROM l)
        SELECT kind, target, CASE WHEN status = 'rollback' THEN 'bad' WHEN age IS NULL OR age > lim OR status IN ('failed', 'partial') THEN 'warn' ELSE 'ok' END AS level, round(CAST(age AS DOUBLE), 4) AS age_days FROM g""",
    "last_runs": "SELECT run_id, started_at FROM (SELECT DISTINCT run_id, started_at FROM runs) ORDER BY CAST(started_at AS TIMESTAMPTZ) DESC NULLS LAST, run_id DESC, started_at LIMIT 10",
    "runs_over_open_sources": """
        WITH r AS (SELECT DISTINCT run_id, started_at, sources_run FROM runs),
        ids AS (SELECT list(source_id) AS ids FROM sources WHERE domain IN ('infra', 'manuals', 'notes', 'sdk-docs')),
        x AS (SELECT run_id, started_at, list_sort(list_distinct(list_intersect(string_split(coalesce(sources_run, ''), ','), ids))) AS o FROM r, ids)
        SELECT run_id, array_to_string(o, ',') AS open_sources FROM x WHERE len(o) > 0 ORDER BY started_at DESC, run_id LIMIT 10""",
    "source_counts": _DUCK_CHUNKS + ", n AS (SELECT source_id, count(*) AS n FROM c GROUP BY 1) SELECT s.source_id, domain, true AS configured, coalesce(n.n, 0) AS chunks FROM sources s LEFT JOIN n ON s.source_id = n.source_id WHERE s.source_id <> 'inbox:notes'",
    "eval_rank_compare": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars % 7 + 1 AS BIGINT) AS rank, CAST(n_chars % 5 + 1 AS BIGINT) AS previous_rank, CAST(n_chars % 5 AS BIGINT) - CAST(n_chars % 7 AS BIGINT) AS change FROM documents",
    "run_outcomes": "SELECT run_id, count(*) AS total, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'empty') AS empty, count(*) FILTER (outcome = 'failed') AS failed FROM (SELECT DISTINCT * FROM doc_log) GROUP BY 1",
    "tombstone_anti_join": _DUCK_CHUNKS + " SELECT source_id, count(*) AS n FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lifecycle <> 'active') GROUP BY 1",
    "chunk_diff": _DUCK_CHUNKS + " SELECT chunk_id FROM c WHERE content_hash IS NULL OR (doc_id % 3 = 0 AND upper(content_hash) <> content_hash)",
    "document_diff": "SELECT doc_id FROM documents WHERE NOT coalesce(status = 'indexed' AND content_hash IS NOT NULL, false)",
    "upsert_snapshot": """
        SELECT doc_id, title, status FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0
        UNION ALL SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 10000000 ELSE 0 END, 'new', status FROM documents WHERE doc_id % 5 = 0""",
    "merge_columns": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE title END AS title, lifecycle FROM documents",
    "tail_delete": _DUCK_CHUNKS + " SELECT c.doc_id, count(*) AS n FROM c JOIN documents d ON c.doc_id = d.doc_id WHERE d.chunk_count IS NULL OR c.chunk_index < floor(d.chunk_count / 2.0) GROUP BY 1",
    "sweep_counts": f"SELECT source_id, count(*) AS total, count(*) FILTER (last_seen_run IS DISTINCT FROM '{RUN}') AS stale, count(*) FILTER (last_seen_run IS DISTINCT FROM '{RUN}') > count(*) * 0.5 AS refused FROM documents GROUP BY 1",
    "missing_run": f"SELECT doc_id FROM documents WHERE source_id = 'inbox:manuals' AND last_seen_run IS DISTINCT FROM '{RUN}' AND coalesce(lifecycle, '') <> 'retracted'",
    "run_marker_touch": "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM doc_log WHERE outcome = 'skipped') THEN 'RUN-X' ELSE last_seen_run END AS last_seen_run, count(*) AS n FROM documents GROUP BY 1",
    "lifecycle_stamp": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE lifecycle END AS lifecycle, status_detail FROM documents",
    "reembed_marking": "SELECT count(*) FILTER (content_hash = '' OR (tier = 'open' AND coalesce(lifecycle, '') <> 'retracted')) AS blanked FROM documents",
    "retracted_state": _DUCK_CHUNKS + " SELECT doc_id, count(*) AS n FROM c WHERE doc_id % 9 <> 0 GROUP BY 1",
    "wholesale_replace": _DUCK_CHUNKS + " SELECT doc_id, count(*) AS n FROM c WHERE chunk_index = 0 OR doc_id NOT IN (SELECT doc_id FROM c WHERE doc_id % 6 = 0 AND chunk_index = 0) GROUP BY 1",
    "field_differences": "SELECT CAST(doc_id AS VARCHAR) AS field FROM documents WHERE content_hash IS DISTINCT FROM sha256(text)",
    "manifest_check": """
        SELECT uri AS path, CASE WHEN text IS NULL THEN 'missing' WHEN content_hash IS NULL THEN 'unexpected' ELSE 'changed' END AS problem
        FROM documents WHERE content_hash IS DISTINCT FROM sha256(text)""",
    "retention": "SELECT source_id, uri AS name FROM documents QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY uri DESC) > 5",
}
