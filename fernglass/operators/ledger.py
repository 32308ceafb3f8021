"""Exact aggregation over ledger rows in integer cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.receipts import cents, printed_date
from ..functions.text import merchant_key, month_of

GROUPS = {"month": lambda: month_of(F.col("txn_date")), "merchant": lambda: F.col("merchant"), "category": lambda: F.col("category")}
FILTERS = ("merchant", "category", "payment_method", "currency")


def select_rows(ledger: DataFrame, start: str | None = None, end: str | None = None, **filters: str | None) -> DataFrame:
    """Rows in [start, end] that match; a merchant matches as part of the name in any case, other columns whole. Unknown filters raise."""
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"unsupported filter(s): {', '.join(sorted(unknown))}; allowed: {', '.join(FILTERS)}")
    if start:
        ledger = ledger.filter(F.col("txn_date") >= start)
    if end:
        ledger = ledger.filter(F.col("txn_date") <= end)
    for column, value in filters.items():
        if value is not None:
            ledger = ledger.filter(F.lower("merchant").contains(value.lower()) if column == "merchant" else F.col(column) == value)
    return ledger


def grouped(ledger: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """``bucket, n, total_cents`` by month, merchant or category, buckets in order with null first; unknown groups raise."""
    if by not in GROUPS:
        raise ValueError(f"unsupported group {by!r}; allowed: {', '.join(sorted(GROUPS))}")
    out = ledger.groupBy(GROUPS[by]().alias("bucket")).agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total_cents")).orderBy(F.asc_nulls_first("bucket"))
    return out.limit(limit) if limit else out


def latest_rows(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """The newest rows by date, ties by id: a top-k without a full sort."""
    return ledger.orderBy(F.desc_nulls_last("txn_date"), "id").limit(limit)


def totals(ledger: DataFrame) -> DataFrame:
    """``count, total_cents, needs_review_count`` over all rows; sums of nothing are 0."""
    return ledger.agg(F.count("*").alias("count"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total_cents"), F.count_if(F.col("needs_review") == 1).alias("needs_review_count"))


def grouped_with_total(ledger: DataFrame, by: str) -> DataFrame:
    """``bucket, is_total, n, total_cents``: the groups and the grand total in one pass by grouping sets."""
    rows = ledger.withColumn("bucket", GROUPS[by]())
    return rows.rollup("bucket").agg(F.grouping("bucket").cast("int").alias("is_total"), F.count("*").alias("n"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total_cents"))


def repeated_receipts(ledger: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, duplicate_of``: rows with the date, the amount and loosely the merchant of an earlier row of another document, and the paths of those.

    An amount of 0 matches nothing. An unreadable merchant matches any. Rows are collapsed to one per document, date, amount and
    merchant key before they meet, and keys are joined on equality with the unreadable ones beside, so that a hot date and amount does
    not pair all its rows."""
    keyed = ledger.filter("amount_cents <> 0 and doc_id is not null and txn_date is not null").withColumn("_key", merchant_key(F.col("merchant")))
    group = ["txn_date", "amount_cents"]
    per_doc = keyed.groupBy(*group, "_key", "doc_id").agg(F.min("id").alias("_first"))
    named = per_doc.join(documents.select("doc_id", "uri").filter("uri is not null").distinct(), "doc_id")
    other = named.select(*group, F.col("_key").alias("_other_key"), F.col("doc_id").alias("_other"), F.col("_first").alias("_other_first"), "uri")
    rows = keyed.select("id", "doc_id", *group, "_key")
    equal = rows.filter("_key <> ''").withColumn("_other_key", F.explode(F.array("_key", F.lit("")))).join(other, [*group, "_other_key"])
    blank = rows.filter("_key = ''").join(other, [*group]).select(*equal.columns)
    pairs = equal.unionByName(blank).filter("doc_id <> _other and _other_first < id")
    return pairs.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("uri")), ", ").alias("duplicate_of"))


def for_review(ledger: DataFrame, documents: DataFrame) -> DataFrame:
    """Flagged rows with their document's path, by date and id."""
    rows = ledger.filter(F.col("needs_review") == 1).join(documents.select("doc_id", "uri"), "doc_id")
    return rows.select("id", "doc_id", "txn_date", "merchant", "amount_cents", "review_notes", "uri").orderBy("txn_date", "id")


def replace_rows(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with all rows of the documents in ``rows`` replaced; repeated rows of a receipt are written once."""
    kept = ledger.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(rows.dropDuplicates(["doc_id", "txn_date", "amount_cents", "merchant"]), allowMissingColumns=True)


def correct(ledger: DataFrame, changes: DataFrame, today: Column, now: str) -> DataFrame:
    """The ledger after corrections ``id, total, date, merchant, category`` (null keeps): parsed by the rules of readings, the flag cleared and the
    change put before the notes. A total or date that cannot be read raises when the rows are computed."""
    parsed = changes.select(
        "id",
        F.when(F.col("total").isNotNull(), F.coalesce(cents(F.col("total")), F.raise_error(F.concat(F.lit("total not understood: "), "total")).cast("long"))).alias("_cents"),
        F.when(F.col("date").isNotNull(), F.coalesce(printed_date(F.col("date"), today, F.lit(True))["iso"], F.raise_error(F.concat(F.lit("date not understood: "), "date")).cast("string"))).alias("_date"),
        F.col("merchant").alias("_merchant"),
        F.col("category").alias("_category"),
    )
    rows = ledger.join(parsed.withColumn("_hit", F.lit(True)), "id", "left")
    said = F.concat_ws("; ", F.lit(f"corrected {now}"), F.when(F.coalesce("review_notes", F.lit("")) != "", F.col("review_notes")))
    return rows.withColumns(
        {
            "amount_cents": F.coalesce("_cents", "amount_cents"),
            "txn_date": F.coalesce("_date", "txn_date"),
            "merchant": F.coalesce("_merchant", "merchant"),
            "category": F.coalesce("_category", "category"),
            "needs_review": F.when(F.col("_hit"), 0).otherwise(F.col("needs_review")),
            "review_notes": F.when(F.col("_hit"), said).otherwise(F.col("review_notes")),
        }
    ).select(*ledger.columns)


def running_total(ledger: DataFrame) -> DataFrame:
    """``month, total_cents, change_cents``: each month beside the month before, of which there are as many as months in a century or two, whatever the rows."""
    months = ledger.groupBy(month_of(F.col("txn_date")).alias("month")).agg(F.sum("amount_cents").alias("total_cents"))
    return months.withColumn("change_cents", F.col("total_cents") - F.lag("total_cents").over(Window.orderBy("month")))


def cube(ledger: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """The columns of ``by``, ``level``, ``n`` and ``total_cents`` of every combination of them, those of at least ``least`` rows, in one pass."""
    return ledger.cube(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("amount_cents").alias("total_cents")).filter(F.col("n") >= least)
