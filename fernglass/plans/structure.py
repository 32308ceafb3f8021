"""Queries of structure operators, sources, readings and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.receipts import READING, receipt_text, schema_faults, validate_readings
from ..operators import structure as S
from ..sources.files import transcript_blocks, transcript_facts
from ..sources.tables import table
from .texts import SPACE
from ..streaming.sync import approvals_batch, windowed_counts


def _docs(s, d):
    return table(s, d, "documents")


def _lines(s, d):
    """Transcript records made of documents: one turn each, titles and bookkeeping between."""
    turns = _docs(s, d).filter("text is not null").select(F.col("source_id").alias("path"), F.col("doc_id").alias("line"), F.col("text"), "title", "mtime")
    said = F.to_json(F.struct(F.when(F.col("line") % 7 == 0, "system").otherwise("user").alias("type"), F.col("line").cast("string").alias("uuid"), F.struct(F.when(F.col("line") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("text").alias("content")).alias("message"), F.concat(F.lit("t"), F.lpad(F.col("line").cast("string"), 9, "0")).alias("timestamp")))
    named = F.to_json(F.struct(F.lit("ai-title").alias("type"), F.col("title").alias("aiTitle")))
    return turns.select("path", (F.col("line") * 2).alias("line"), said.alias("value")).unionByName(turns.filter("title is not null").select("path", (F.col("line") * 2 + 1).alias("line"), named.alias("value")))


def _readings(s, d):
    """All ledger rows as printed readings; what a row lacks isn't printed."""
    rows = table(s, d, "ledger").dropDuplicates()
    printed = F.concat(F.lit("$"), F.format_number(F.col("amount_cents") / 100, 2))
    reading = F.struct(F.col("merchant"), F.col("txn_date").alias("date"), F.lit("usd").alias("currency"), printed.alias("total"), F.col("payment_method"), F.col("category"))
    return rows.select("id", F.to_json(reading).alias("reading"), F.lit("2026-01-01").alias("fallback_date"))


def _formed(id_):
    """Readings of which four in five are ill formed."""
    head = F.concat(F.lit('{"merchant":"Shop ') , id_.cast("string"), F.lit('","date":null,"line_items":'))
    return F.when(id_ % 5 == 0, F.concat(head, F.lit('[],"total":"$1","category":"other"}'))).when(id_ % 5 == 1, F.concat(head, F.lit('[],"total":12.5,"category":"other"}'))).when(id_ % 5 == 2, F.concat(head, F.lit('{"a":1},"total":null,"category":"no such"}'))).when(id_ % 5 == 3, F.lit("[1, 2]")).otherwise(F.concat(F.lit("broken "), head))


def _pages(s, d):
    return _docs(s, d).select((F.col("doc_id") % 50).alias("doc_id"), (F.col("n_chars") % 40 + 1).cast("long").alias("page")).filter("page is not null")


def _contents(s, d):
    """Pages of leader lines made of sources' documents: titles with their place, beside pages of plain lines."""
    lines = _docs(s, d).filter("title is not null").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title"))).alias("t"))
    made = F.transform("t", lambda x, i: F.concat(x["title"], F.when(F.length("source_id") % 2 == 0, F.lit(" ..... ")).otherwise(F.lit(" ")), (i + 1).cast("string")))
    return lines.select("source_id", F.array_join(made, "\n").alias("text"), F.lit(100_000).alias("page_count"))


_LEDGER = "WITH r AS (SELECT DISTINCT * FROM ledger)"

QUERIES = {
    "chunk_text": lambda s, d: S.chunk_documents(_docs(s, d).filter(S.strategy_of(F.col("extractor")) == "text")),
    "chunk_markdown": lambda s, d: S.chunk_documents(_docs(s, d).filter(S.strategy_of(F.col("extractor")) == "markdown")),
    "chunk_blocks": lambda s, d: S.chunk_documents(_docs(s, d).filter(S.strategy_of(F.col("extractor")) == "blocks")),
    "chunk_totals": lambda s, d: S.chunk_documents(_docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("token_count").alias("most"), F.max("chunk_index").alias("last")).filter("most <= 480 and last = n - 1").select("doc_id"),
    "markdown_sections": lambda s, d: S.markdown_sections(_docs(s, d)),
    "pipe_tables": lambda s, d: S.pipe_tables(_docs(s, d)),
    "contents_page": lambda s, d: S.contents_pages(_contents(s, d)).select("source_id"),
    "page_spec": lambda s, d: S.page_islands(_pages(s, d)),
    "unsupported_numbers": lambda s, d: S.unsupported_numbers(table(s, d, "chunks").select("chunk_id", F.col("text").alias("markdown"), F.col("locator").alias("layer")).filter("markdown is not null and layer is not null").distinct()).select("chunk_id", F.array_join("missing", " ").alias("missing")),
    "similar_names": lambda s, d: S.similar_names(_docs(s, d)),
    "transcript_turns": lambda s, d: transcript_blocks(_lines(s, d)).select("path", "line", "kind", F.length("text").alias("n_chars")),
    "transcript_facts": lambda s, d: transcript_facts(_lines(s, d)).select("path", "title", "first_ts", "last_ts"),
    "receipt_validate": lambda s, d: validate_readings(_readings(s, d), F.lit("2026-12-31").cast("date")).select("id", "txn_date", "amount_cents", "currency", "needs_review"),
    "reading_faults": lambda s, d: table(s, d, "ledger").select("id").distinct().select("id", F.array_join(schema_faults(_formed(F.col("id"))), "; ").alias("faults")),
    "receipt_text": lambda s, d: _readings(s, d).select("id", receipt_text(F.from_json("reading", READING)).alias("text")),
    "event_windows": lambda s, d: windowed_counts(table(s, d, "events")),
    "approvals": lambda s, d: approvals_batch(table(s, d, "events").select((F.col("user_id")).cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("event_id") % 3 == 0, "request").when(F.col("event_id") % 3 == 1, "approve").otherwise("redeem").alias("action"))),
}
ORACLES = {
    "chunk_totals": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')",
    "page_spec": """
        WITH p AS (SELECT DISTINCT doc_id % 50 AS doc_id, n_chars % 40 + 1 AS page FROM documents WHERE n_chars IS NOT NULL),
        r AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p),
        i AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM r GROUP BY doc_id, g)
        SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS BIGINT)::VARCHAR ELSE CAST(a AS BIGINT)::VARCHAR || '-' || CAST(b AS BIGINT)::VARCHAR END, ',' ORDER BY a) AS spec FROM i GROUP BY 1""",
    "unsupported_numbers": """
        WITH c AS (SELECT DISTINCT chunk_id, text, locator FROM chunks WHERE text IS NOT NULL AND locator IS NOT NULL),
        n AS (SELECT chunk_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*') AS m, regexp_extract_all(locator, '[0-9]+(?:[.,][0-9]+)*') AS h FROM c),
        f AS (SELECT chunk_id, m, list_concat(h, list_transform(h, lambda x: regexp_replace(x, '[^0-9]', '', 'g'))) AS h FROM n)
        SELECT chunk_id, array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: list_position(m, m[i]) = i AND NOT list_contains(h, m[i]) AND NOT list_contains(h, regexp_replace(m[i], '[^0-9]', '', 'g'))), lambda i: m[i]), ' ') AS missing FROM f""",
    "transcript_turns": r"""
        SELECT source_id AS path, doc_id * 2 AS line, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS kind,
               CAST(length(CASE WHEN doc_id % 2 = 0 THEN 'user: ' ELSE 'assistant: ' END || regexp_replace(text, '^__S__+|__S__+$', '', 'g')) AS INT) AS n_chars
        FROM documents WHERE regexp_replace(text, '^__S__+|__S__+$', '', 'g') <> '' AND doc_id % 7 <> 0""".replace("__S__", SPACE),
    "transcript_facts": "SELECT source_id AS path, arg_max(title, doc_id) FILTER (title <> '') AS title, min('t' || lpad(doc_id::VARCHAR, 9, '0')) AS first_ts, max('t' || lpad(doc_id::VARCHAR, 9, '0')) AS last_ts FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "receipt_validate": _LEDGER + """ SELECT id, coalesce(txn_date, '2026-01-01') AS txn_date, coalesce(amount_cents, 0) AS amount_cents, 'USD' AS currency,
        CASE WHEN txn_date IS NULL OR amount_cents IS NULL OR amount_cents < 0 THEN 1 ELSE 0 END AS needs_review FROM r""",
    "contents_page": "SELECT source_id FROM documents WHERE title IS NOT NULL GROUP BY 1 HAVING length(source_id) % 2 = 0 AND count(*) >= 5",
    "receipt_text": """
        WITH r AS (SELECT DISTINCT * FROM ledger)
        SELECT id, concat_ws(chr(10), CASE WHEN coalesce(merchant, '') <> '' THEN merchant ELSE 'Unknown merchant' END, 'Date: ' || nullif(txn_date, ''),
               'Total: ' || format('${:,.2f}', amount_cents / 100.0), 'Paid with: ' || nullif(payment_method, ''), 'Category: ' || nullif(category, '')) AS text FROM r""",
    "reading_faults": "SELECT DISTINCT id, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'total: no text' WHEN 2 THEN 'line_items: no list; category: unknown' ELSE 'no object' END AS faults FROM ledger",
    "event_windows": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
