"""Queries of the scalar functions on texts and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.receipts import cents, printed_date
from ..sources.tables import table



def sql_pattern(pattern: str) -> str:
    """A pattern of the functions as DuckDB reads it, which has no flag for Unicode classes: digits and word borders are of ASCII in it."""
    return pattern.replace("(?Ui)", "(?i)").replace("(?U)", "")


_TEXT_RULES = {rule: sql_pattern(pattern) for rule, pattern in (*T.IDENTIFIERS, *T.SECRETS)}
#: White space of any kind, as a class in DuckDB.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WIDE = SPACE.replace(r"\x{1C}-\x{20}", r"\x{20}")
#: Texts that hold what the rules look for, made of orders: as many kinds as rules, some of them wrong on purpose.
_PLANTED = (
    "'paid with 4000 0000 ' || substr(lpad(k, 8, '0'), 1, 4) || ' ' || substr(lpad(k, 8, '0'), 5, 4)", "'SSN 123-45-' || substr(lpad(k, 8, '0'), 5, 4) || ' on file'", "'to DE' || substr(lpad(k, 8, '0'), 7, 2) || 'ABCD' || lpad(k, 12, '0')",
    "'Routing number: ' || lpad(k, 9, '0')", "'acct no. ' || lpad(k, 8, '0')", "'sk-ant-' || md5(k)", "'key sk-' || md5(k)", "'ghp_' || md5(k) || ' once'", "'AKIA' || upper(substr(md5(k), 1, 16))", "'Bearer ' || md5(k)",
    "'-----BEGIN RSA PRIVATE KEY----- ' || md5(k)", "'Password = ' || md5(k)", "'your account balance and statement for ' || k", "'total due on invoice ' || k", "'minimum payment within the credit limit ' || k", "'order ' || k || ' of 2024-01-01'",
)
_CASES = "CASE o_orderkey % 16 " + " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(_PLANTED)) + " END"
_SCANNED = f"scanned AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 10000000 + o_orderkey AS doc_id, {_CASES} AS text FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) o)"
_CARDS = r"""
    runs AS (SELECT doc_id, regexp_extract_all(text, '__CARD__') AS c FROM scanned),
    each_run AS (SELECT doc_id, generate_subscripts(c, 1) AS place, regexp_replace(unnest(c), '[ -]', '', 'g') AS digits FROM runs),
    summed AS (SELECT doc_id, place, digits, list_transform(range(1, length(digits) + 1), lambda i: CAST(substr(reverse(digits), CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) AS n FROM each_run WHERE length(digits) BETWEEN 13 AND 19),
    valid AS (SELECT doc_id, arg_min(digits, place) AS digits FROM summed WHERE list_sum(list_transform(n, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0 GROUP BY 1)""".replace("__CARD__", sql_pattern(T.CARD))
_VEIL = "CASE WHEN length(h) <= 8 THEN repeat('*', length(h)) ELSE substr(h, 1, 4) || '...' || right(h, 2) || ' (' || length(h) || ' chars)' END"


def _redacted_sql() -> str:
    sql = "text"
    for label, pattern, kept in T.REDACTIONS:
        sql = f"regexp_replace({sql}, '{sql_pattern(pattern)}', '{kept.replace('$', chr(92))}[REDACTED:{label}]', 'g')"
    return sql


_LOCATOR = "from_json(locator, '{\"page\":\"BIGINT\",\"pages\":[\"BIGINT\"],\"lines\":[\"BIGINT\"],\"anchor\":\"VARCHAR\"}')"


def _scanned(spark, folder):
    """Documents, and texts made of orders in which every rule finds something."""
    planted = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k")).select((F.col("o_orderkey") + 10_000_000).alias("doc_id"), F.expr(_CASES).alias("text"))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", "text").unionByName(planted)


def _scan(spark, folder):
    return _scanned(spark, folder).select("doc_id", F.explode(T.findings(F.col("text"))).alias("f")).select("doc_id", "f.rule", "f.detail")


QUERIES = {
    "doc_id_hash": lambda s, d: table(s, d, "documents").select("doc_id", T.document_key(F.col("source_id"), F.col("uri")).alias("key")),
    "point_ids": lambda s, d: table(s, d, "chunks").select("chunk_id", T.uuid5(F.concat_ws("|", "source_id", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).alias("point_id")).distinct(),
    "content_hash_dupes": lambda s, d: table(s, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1"),
    "luhn_cards": lambda s, d: _scanned(s, d).select("doc_id", T.card_digits(F.col("text")).alias("digits")).filter("digits is not null"),
    "sensitivity_scan": _scan,
    "redact_text": lambda s, d: _scanned(s, d).select("doc_id", F.sha2(T.without_secrets(F.col("text")), 256).alias("hash")),
    "stale_banners": lambda s, d: table(s, d, "documents").filter("lifecycle = 'stale'").select("doc_id", T.stale_banner(F.col("status_detail"), F.substring("indexed_at", 1, 10)).alias("banner")),
    "citation_format": lambda s, d: table(s, d, "chunks").join(table(s, d, "documents").select("doc_id", "uri"), "doc_id").select("chunk_id", T.citation(F.col("uri"), F.from_json("locator", T.LOCATOR)).alias("citation")).distinct(),
    "snippets": lambda s, d: table(s, d, "chunks").filter("text is not null").select("chunk_id", T.snippet(F.col("text")).alias("snippet")).distinct(),
    "squashed_titles": lambda s, d: table(s, d, "documents").filter("title is not null").select("doc_id", T.squashed(F.col("title")).alias("squashed")),
    "normalised_stems": lambda s, d: table(s, d, "documents").filter("uri is not null").select("doc_id", T.normalised_stem(F.col("uri")).alias("stem"), T.dated(F.col("uri")).alias("dated")),
    "parse_amount": lambda s, d: table(s, d, "orders").select("o_orderkey", cents(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("us"), cents(F.concat(F.lit("("), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), F.lit(")"))).alias("eu")),
    "parse_date": lambda s, d: table(s, d, "orders").select(
        "o_orderkey", printed_date(F.date_format("o_orderdate", "MM/dd/yyyy 12:30 'PM'"), F.lit("1997-06-30").cast("date"))["iso"].alias("us"), printed_date(F.date_format("o_orderdate", "d MMM yyyy"), F.lit("2030-01-01").cast("date"))["note"].alias("note")
    ),
    "month_buckets": lambda s, d: table(s, d, "ledger").groupBy(T.month_of(F.col("txn_date")).alias("month")).agg(F.count("*").alias("n")),
    "project_paths": lambda s, d: table(s, d, "sources").select("source_id", T.project_path(F.concat(F.lit("-"), F.regexp_replace("source_id", ":", "-"))).alias("path")),
    "lacking_text": lambda s, d: table(s, d, "chunks").filter("text is not null").select("chunk_id", T.lacks_text(F.col("text"), 100).alias("lacks")).distinct(),
}
ORACLES = {
    "doc_id_hash": "SELECT doc_id, substr(sha256(source_id || chr(0) || uri), 1, 32) AS key FROM documents",
    "content_hash_dupes": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "point_ids": f"""
        WITH n AS (SELECT DISTINCT chunk_id, sha1(unhex('{T.POINT_NAMESPACE.replace("-", "")}') || encode(source_id || '|' || doc_id || '|' || chunk_index)) AS h FROM chunks)
        SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM n""",
    "luhn_cards": f"WITH {_SCANNED}, {_CARDS} SELECT doc_id, digits FROM valid",
    "sensitivity_scan": f"WITH {_SCANNED}, {_CARDS}, hits AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, trim(regexp_extract(text, '{pattern}')) AS h FROM scanned WHERE regexp_matches(text, '{pattern}')" for rule, pattern in _TEXT_RULES.items())
    + f") SELECT doc_id, rule, {_VEIL} AS detail FROM hits UNION ALL SELECT doc_id, 'card_number', 'Luhn-valid, ' || length(digits) || ' digits' FROM valid UNION ALL "
    + " UNION ALL ".join(f"SELECT doc_id, '{rule}', 'co-occurring terms: {', '.join(terms)}' FROM scanned WHERE " + " AND ".join(f"contains(lower(text), '{t}')" for t in terms) for rule, terms in T.VOCABULARIES),
    "redact_text": f"WITH {_SCANNED} SELECT doc_id, sha256({_redacted_sql()}) AS hash FROM scanned",
    "stale_banners": "SELECT doc_id, '[STALE' || CASE WHEN coalesce(indexed_at, '') <> '' THEN ' since ' || substr(indexed_at, 1, 10) ELSE '' END || ': ' || coalesce(nullif(status_detail, ''), 'marked out of date') || ']' AS banner FROM documents WHERE lifecycle = 'stale'",
    "citation_format": f"""
        WITH c AS (SELECT DISTINCT chunk_id, uri, {_LOCATOR} AS l FROM chunks JOIN documents USING (doc_id))
        SELECT DISTINCT chunk_id, CASE WHEN coalesce(uri, '') = '' THEN ''
            WHEN l.page IS NOT NULL AND len(l.pages) > 1 THEN uri || ', pages ' || l.pages[1] || '-' || l.pages[-1]
            WHEN l.page IS NOT NULL THEN uri || ', page ' || l.page
            WHEN len(l.lines) > 0 AND l.lines[1] = l.lines[-1] THEN uri || ', line ' || l.lines[1]
            WHEN len(l.lines) > 0 THEN uri || ', lines ' || l.lines[1] || '-' || l.lines[-1]
            WHEN coalesce(l.anchor, '') <> '' THEN uri || '#' || l.anchor ELSE uri END AS citation FROM c""",
    "snippets": f"""
        WITH f AS (SELECT DISTINCT chunk_id, trim(regexp_replace(text, '{WIDE}+', ' ', 'g'), ' ') AS t FROM chunks WHERE text IS NOT NULL)
        SELECT DISTINCT chunk_id, CASE WHEN length(t) > 260 THEN substr(t, 1, 260) || '...' ELSE t END AS snippet FROM f""",
    "squashed_titles": r"""SELECT doc_id, regexp_replace(lower(translate(title, '‘’“”', chr(39) || chr(39) || '""')), '\s+', '', 'g') AS squashed FROM documents WHERE title IS NOT NULL""",
    "normalised_stems": r"""
        SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(uri), '^.*/', ''), '(.)\.[^.]*$', '\1'),
               '(?i)(?:[._\-\s(]|^)(?:v|ver|rev|r|draft|final|copy)?\s*[0-9]{0,3}\)?$', ''), '[^a-z0-9]+', ' ', 'g')) AS stem,
               regexp_matches(uri, '[0-9]{4}[-_]?[0-9]{2}(?:[-_]?[0-9]{2})?') AS dated FROM documents WHERE uri IS NOT NULL""",
    "parse_amount": "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS us, -CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS eu FROM orders",
    "parse_date": """
        SELECT o_orderkey, NULL::VARCHAR AS us, 'date ''' || strftime(o_orderdate, '%-d %b %Y') || ''' read as ' || strftime(o_orderdate, '%Y-%m-%d') || ', which cannot be right' AS note
        FROM orders WHERE o_orderdate < '2000-01-01'
        UNION ALL SELECT o_orderkey, CASE WHEN o_orderdate < '1997-07-01' THEN strftime(o_orderdate, '%Y-%m-%d') END, NULL FROM orders WHERE o_orderdate >= '2000-01-01'""",
    "month_buckets": "SELECT substr(txn_date, 1, 7) AS month, count(*) AS n FROM ledger GROUP BY 1",
    "project_paths": "SELECT source_id, '/' || replace(replace(source_id, ':', '-'), '-', '/') AS path FROM sources",
    "lacking_text": f"""
        WITH f AS (SELECT DISTINCT chunk_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM chunks WHERE text IS NOT NULL)
        SELECT DISTINCT chunk_id, length(t) < 100 AND NOT regexp_matches(lower(t), 'intentionally{WIDE}+(?:left{WIDE}+)?blank') AS lacks FROM f""",
}
