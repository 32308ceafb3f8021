import json

import pytest
from pyspark.sql import functions as F

from fernglass.functions.receipts import READING, cents, printed_date, receipt_text, validate_readings
from fernglass.operators import ledger as L


@pytest.mark.parametrize(
    "printed, expected",
    [("$1,234.56", 123456), ("1.234,56", 123456), ("12,49", 1249), ("-3.00", -300), ("3.00-", -300), ("(3.00)", -300), ("1,234", 123400), ("7", 700), ("0.005", 1), ("EUR 5.50", 550), ("1,234,567", 123456700), ("", None), ("free", None), ("1.2.3", None), ("--5", None), (None, None)],
)
def test_amounts(spark, printed, expected):
    assert spark.createDataFrame([(printed,)], "p string").select(cents(F.col("p"))).first()[0] == expected


@pytest.mark.parametrize(
    "printed, iso, noted",
    [
        ("2026-03-04", "2026-03-04", False), ("2026/3/4", "2026-03-04", False), ("3/4/2026", "2026-03-04", True), ("3/4/26", "2026-03-04", True), ("4/4/26", "2026-04-04", False), ("13.02.2026", "2026-02-13", False),
        ("4 Mar 2026", "2026-03-04", False), ("March 4, 2026", "2026-03-04", False), ("Mar 4 2026 10:22 PM", "2026-03-04", False), ("2030-01-01", None, True), ("1999-12-31", None, True), ("soon", None, True), ("", None, True), (None, None, True), ("31.02.2026", None, True), ("1/2/85", None, True),
    ],
)
def test_dates(spark, printed, iso, noted):
    got = spark.createDataFrame([(printed,)], "p string").select(printed_date(F.col("p"), F.lit("2026-06-01").cast("date"))).first()[0]
    assert (got["iso"], got["note"] is not None) == (iso, noted)


def test_month_first_is_not_ambiguous(spark):
    got = spark.range(1).select(printed_date(F.lit("3/4/2026"), F.lit("2026-06-01").cast("date"), F.lit(True))).first()[0]
    assert (got["iso"], got["note"]) == ("2026-03-04", None)


def reading(**extra):
    return json.dumps({"merchant": "Shop", "date": "2026-03-04", "currency": "usd", "line_items": [{"description": "a", "quantity": "1", "amount": "2.00"}, {"description": "b", "quantity": None, "amount": "3.00"}], "subtotal": "5.00", "tax": "0.50", "total": "5.50", "category": "Fuel", **extra})


def validate(spark, *texts):
    rows = spark.createDataFrame([(n, t, "2026-01-01", "keep") for n, t in enumerate(texts)], "id long, reading string, fallback_date string, currency_x string")
    return validate_readings(rows, F.lit("2026-06-01").cast("date")).orderBy("id").collect()


def test_readings(spark):
    good, bad_sum, no_total, refund, broken, none = validate(spark, reading(), reading(subtotal="6.00"), reading(total=None, subtotal=None), reading(total="-5.50", line_items=[]), "not json", None)
    assert (good["amount_cents"], good["needs_review"], good["category"], good["description"], good["currency"], good["currency_x"]) == (550, 0, "fuel", "2 line item(s)", "USD", "keep")
    assert bad_sum["needs_review"] == 1 and "line items sum to 5.00, subtotal says 6.00" in bad_sum["review_notes"]
    assert no_total["amount_cents"] == 0 and "no total read" in no_total["review_notes"]
    assert "negative total -5.50 (a refund?)" in refund["review_notes"]
    for row in (broken, none):
        assert row["amount_cents"] == 0 and row["needs_review"] == 1 and row["txn_date"] == "2026-01-01" and row["category"] == "other"


def test_receipt_text(spark):
    got = spark.createDataFrame([(reading(),)], "r string").select(receipt_text(F.from_json("r", READING))).first()[0]
    assert got.split("\n") == ["Shop", "Date: 2026-03-04", "- 1 x a: 2.00", "- b: 3.00", "Subtotal: 5.00", "Tax: 0.50", "Total: 5.50", "Category: Fuel"]


LEDGER = "id long, doc_id long, txn_date string, merchant string, amount_cents long, category string, payment_method string, currency string, needs_review int, review_notes string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, 1, "2026-01-02", "Shop #1", 500, "fuel", "card", "USD", 0, None), (2, 2, "2026-01-02", "SHOP 2", 500, "fuel", "card", "USD", 1, "x"), (3, 3, "2026-02-01", None, 700, None, None, "EUR", 0, None), (4, 4, "2026-02-01", "Other", 700, "dining", "cash", "USD", 0, None), (5, 5, "2026-02-01", "Other", 0, "dining", "cash", "USD", 0, None)],
        LEDGER,
    )


def test_ledger_groups_and_filters(rows):
    assert [tuple(r) for r in L.grouped(rows, "merchant").collect()] == [(None, 1, 700), ("Other", 2, 700), ("SHOP 2", 1, 500), ("Shop #1", 1, 500)]
    assert tuple(L.totals(L.select_rows(rows, merchant="shop")).first()) == (2, 1000, 1)
    assert tuple(L.totals(rows.limit(0)).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        L.select_rows(rows, color="red")
    with pytest.raises(ValueError):
        L.grouped(rows, "color")


def test_repeated_receipts(spark, rows):
    docs = spark.createDataFrame([(n, f"u{n}") for n in range(1, 6)], "doc_id long, uri string")
    assert sorted(tuple(r) for r in L.repeated_receipts(rows, docs).collect()) == [(2, "u1"), (4, "u3")]


def test_corrections(spark, rows):
    changes = spark.createDataFrame([(2, "9.99", None, "New", None)], "id long, total string, date string, merchant string, category string")
    got = {r["id"]: r for r in L.correct(rows, changes, F.lit("2026-06-01").cast("date"), "2026-06-01").collect()}
    assert (got[2]["amount_cents"], got[2]["merchant"], got[2]["category"], got[2]["needs_review"], got[2]["review_notes"]) == (999, "New", "fuel", 0, "corrected 2026-06-01; x")
    assert got[1]["amount_cents"] == 500
    bad = spark.createDataFrame([(2, "many", None, None, None)], "id long, total string, date string, merchant string, category string")
    with pytest.raises(Exception, match="total not understood"):
        L.correct(rows, bad, F.lit("2026-06-01").cast("date"), "x").collect()
