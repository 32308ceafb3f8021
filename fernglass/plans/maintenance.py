"""Queries of incremental maintenance."""

from __future__ import annotations

from ..operators.incremental import committed_versions, pending_documents, succeeded_runs
from ..sources.tables import table

#: An ISO 8601 text as an instant in DuckDB; texts without an offset are UTC.
_DUCK_INSTANT = "try_cast(CASE WHEN regexp_matches({0}, '([Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})\\s*$') THEN {0} ELSE {0} || '+00:00' END AS TIMESTAMPTZ)"

_SUCCEEDED = f"""
    WITH finished AS (
        SELECT run_id, {_DUCK_INSTANT.format("finished_at")} AS finished, coalesce(lower(trim(status)) = 'ok', false) AS ok
        FROM runs WHERE run_id IS NOT NULL AND finished_at IS NOT NULL),
    last AS (SELECT run_id, max(finished) AS finished FROM finished WHERE finished IS NOT NULL GROUP BY run_id),
    succeeded AS (
        SELECT f.run_id, f.finished FROM finished f JOIN last l ON f.run_id = l.run_id AND f.finished = l.finished
        GROUP BY f.run_id, f.finished HAVING bool_and(f.ok))"""
_COMMITTED = (
    _SUCCEEDED
    + """,
    records AS (
        SELECT d.doc_id, nullif(lower(trim(d.content_hash)), '') AS committed_hash,
               row_number() OVER (PARTITION BY d.doc_id ORDER BY s.finished DESC, d.recorded_at DESC NULLS LAST, d.run_id DESC,
                                  nullif(lower(trim(d.content_hash)), '') DESC NULLS LAST) AS r
        FROM doc_log d JOIN succeeded s ON d.run_id = s.run_id
        WHERE d.doc_id IS NOT NULL AND coalesce(lower(trim(d.outcome)), '') <> 'failed'),
    committed AS (SELECT doc_id, committed_hash FROM records WHERE r = 1)"""
)

QUERIES = {
    "p3_found": lambda s, d: pending_documents(table(s, d, "documents"), table(s, d, "doc_log"), table(s, d, "runs")),
    "p3_succeeded_runs": lambda s, d: succeeded_runs(table(s, d, "runs")).select("run_id"),
    "p3_committed": lambda s, d: committed_versions(table(s, d, "doc_log"), table(s, d, "runs")),
}
ORACLES = {
    "p3_found": _COMMITTED
    + """
    SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN committed c ON d.doc_id = c.doc_id
    WHERE coalesce(lower(trim(d.lifecycle)), 'active') <> 'retracted'
      AND (d.content_hash IS NULL OR trim(d.content_hash) = '' OR c.committed_hash IS NULL OR lower(trim(d.content_hash)) <> c.committed_hash)""",
    "p3_succeeded_runs": _SUCCEEDED + " SELECT run_id FROM succeeded",
    "p3_committed": _COMMITTED + " SELECT doc_id, committed_hash FROM committed",
}
