"""Ledger queries: over the ledger table, and over orders as a large ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import masked_payment, merchant_key
from ..operators import ledger as L
from ..sources.tables import table


def orders_as_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the columns of a ledger; cents by exact decimal arithmetic."""
    o = table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice").cast("decimal(18,4)") * 100, 0).cast("long")
    return o.select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("txn_date"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("merchant"), cents.alias("amount_cents"),
        F.col("o_orderpriority").alias("category"), F.lit("card").alias("payment_method"), F.lit("USD").alias("currency"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("needs_review"),
    )


_ORDERS = """
    WITH ledger_o AS (
        SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS txn_date, 'Customer ' || o_custkey AS merchant,
               CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) * 100, 0) AS BIGINT) AS amount_cents, o_orderpriority AS category,
               CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS needs_review
        FROM orders)"""


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger table without exact repeats."""
    return table(spark, folder, "ledger").dropDuplicates()


_LEDGER = "WITH rows AS (SELECT DISTINCT * FROM ledger)"

QUERIES = {
    "ledger_by_month": lambda s, d: L.grouped(L.select_rows(orders_as_ledger(s, d), start="1995-01-01"), "month"),
    "ledger_by_category": lambda s, d: L.grouped(orders_as_ledger(s, d), "category"),
    "ledger_by_merchant": lambda s, d: L.grouped(_ledger(s, d), "merchant"),
    "ledger_rows_topn": lambda s, d: L.latest_rows(orders_as_ledger(s, d), 100).select("id", "txn_date", "merchant", "amount_cents"),
    "ledger_totals": lambda s, d: L.totals(L.select_rows(orders_as_ledger(s, d), start="1994-01-01", end="1996-12-31", category="1-URGENT")),
    "ledger_merchant_like": lambda s, d: L.totals(L.select_rows(_ledger(s, d), merchant="MARKET")),
    "ledger_grouping_sets": lambda s, d: L.grouped_with_total(_ledger(s, d), "category"),
    "ledger_duplicates": lambda s, d: L.repeated_receipts(_ledger(s, d), table(s, d, "documents")),
    "ledger_for_review": lambda s, d: L.for_review(_ledger(s, d), table(s, d, "documents")),
    "ledger_month_change": lambda s, d: L.running_total(_ledger(s, d)),
    "merchant_keys": lambda s, d: _ledger(s, d).groupBy(merchant_key(F.col("merchant")).alias("merchant_key")).agg(F.count("*").alias("n")),
    "masked_payments": lambda s, d: table(s, d, "orders").select("o_orderkey", masked_payment(F.concat(F.lit("card 4111 "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).alias("payment")),
    "ledger_replace": lambda s, d: L.replace_rows(_ledger(s, d), _ledger(s, d).filter("doc_id % 7 = 0").withColumn("category", F.lit("corrected"))).groupBy("category").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total_cents")),
    "ledger_large_item_orders": lambda s, d: orders_as_ledger(s, d).join(
        table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.round((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)"), 2)).alias("items_sum"), F.count("*").alias("n_items")), "id"
    ).groupBy("category").agg(F.sum("n_items").alias("n_items"), F.sum("amount_cents").alias("total_cents")),
}
ORACLES = {
    "ledger_by_month": _ORDERS + "SELECT substr(txn_date, 1, 7) AS bucket, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM ledger_o WHERE txn_date >= '1995-01-01' GROUP BY 1",
    "ledger_by_category": _ORDERS + "SELECT category AS bucket, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM ledger_o GROUP BY 1",
    "ledger_by_merchant": _LEDGER + " SELECT merchant AS bucket, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM rows GROUP BY 1",
    "ledger_rows_topn": _ORDERS + "SELECT id, txn_date, merchant, amount_cents FROM ledger_o ORDER BY txn_date DESC, id LIMIT 100",
    "ledger_totals": _ORDERS
    + "SELECT count(*) AS count, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents, count(*) FILTER (needs_review = 1) AS needs_review_count FROM ledger_o WHERE txn_date >= '1994-01-01' AND txn_date <= '1996-12-31' AND category = '1-URGENT'",
    "ledger_merchant_like": _LEDGER + " SELECT count(*) AS count, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents, count(*) FILTER (needs_review = 1) AS needs_review_count FROM rows WHERE contains(lower(merchant), 'market')",
    "ledger_grouping_sets": _LEDGER + " SELECT category AS bucket, CAST(grouping(category) AS INT) AS is_total, count(*) AS n, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents FROM rows GROUP BY ROLLUP (category)",
    "ledger_duplicates": _LEDGER
    + r""", keyed AS (
        SELECT *, coalesce(list_filter(regexp_extract_all(lower(coalesce(merchant, '')), '[a-z0-9]+'), lambda w: NOT regexp_full_match(w, '[0-9]+'))[1], '') AS k
        FROM rows WHERE amount_cents <> 0 AND doc_id IS NOT NULL AND txn_date IS NOT NULL)
    SELECT a.id, string_agg(DISTINCT d.uri, ', ' ORDER BY d.uri) AS duplicate_of
    FROM keyed a JOIN keyed b ON a.txn_date = b.txn_date AND a.amount_cents = b.amount_cents AND a.doc_id <> b.doc_id AND b.id < a.id
         AND (a.k = '' OR b.k = '' OR a.k = b.k)
    JOIN documents d ON b.doc_id = d.doc_id WHERE d.uri IS NOT NULL GROUP BY a.id""",
    "ledger_for_review": _LEDGER + " SELECT r.id, r.doc_id, txn_date, merchant, amount_cents, review_notes, uri FROM rows r JOIN documents d ON r.doc_id = d.doc_id WHERE needs_review = 1",
    "ledger_month_change": _LEDGER
    + ", m AS (SELECT substr(txn_date, 1, 7) AS month, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM rows GROUP BY 1) SELECT month, total_cents, total_cents - lag(total_cents) OVER (ORDER BY month NULLS FIRST) AS change_cents FROM m",
    "merchant_keys": _LEDGER + " SELECT coalesce(list_filter(regexp_extract_all(lower(coalesce(merchant, '')), '[a-z0-9]+'), lambda w: NOT regexp_full_match(w, '[0-9]+'))[1], '') AS merchant_key, count(*) AS n FROM rows GROUP BY 1",
    "masked_payments": "SELECT o_orderkey, 'card …' || right(lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 4) AS payment FROM orders",
    "ledger_replace": """
        WITH rows AS (SELECT DISTINCT * FROM ledger),
        fresh AS (SELECT DISTINCT doc_id, txn_date, amount_cents, merchant FROM rows WHERE doc_id % 7 = 0),
        merged AS (SELECT category, amount_cents FROM rows WHERE doc_id % 7 <> 0 OR doc_id IS NULL UNION ALL SELECT 'corrected', amount_cents FROM fresh)
        SELECT category, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM merged GROUP BY 1""",
    "ledger_large_item_orders": _ORDERS
    + ", items AS (SELECT l_orderkey AS id, count(*) AS n_items FROM lineitem GROUP BY 1) SELECT category, CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM ledger_o JOIN items USING (id) GROUP BY 1",
}
