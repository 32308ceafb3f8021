"""Reading of printed amounts and dates, and validation of receipt readings into ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import masked_payment

#: Formats of printed dates in the order tried, and whether month and day could be mistaken for each other.
DATE_FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "y-M-d", False),
    (r"\d{4}/\d{1,2}/\d{1,2}", "y/M/d", False),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/y", True),
    (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy", True),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-y", True),
    (r"\d{1,2}-\d{1,2}-\d{2}", "M-d-yy", True),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.y", False),
    (r"\d{1,2}\.\d{1,2}\.\d{2}", "d.M.yy", False),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM y", False),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", "d MMMM y", False),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, y", False),
    (r"[A-Za-z]{4,9} \d{1,2}, \d{4}", "MMMM d, y", False),
    (r"[A-Za-z]{3} \d{1,2} \d{4}", "MMM d y", False),
    (r"[A-Za-z]{4,9} \d{1,2} \d{4}", "MMMM d y", False),
)
#: Categories of a receipt, the currency if none can be read, the earliest date, and the rounding allowed in cents.
CATEGORIES = ("groceries", "dining", "fuel", "household", "electronics", "health", "travel", "utilities", "other")
CURRENCY, EARLIEST, TOLERANCE = "USD", "2000-01-01", 1
READING = (
    "merchant string, date string, currency string, line_items array<struct<description:string,quantity:string,amount:string>>, subtotal string, tax string, "
    "tip string, discounts string, total string, payment_method string, category string"
)


def cents(printed: Column) -> Column:
    """A printed amount as integer cents, halves away from zero; null if it cannot be read.

    Parentheses and a minus on either side negate. With both signs the later one is the decimal sign; a lone comma is one before
    two digits and parts thousands otherwise."""
    text = F.trim(printed)
    bracketed = text.startswith("(") & text.endswith(")")
    bare = F.regexp_replace(text, r"[^0-9.,\-]", "")
    minus_after = bare.endswith("-")
    bare = F.regexp_replace(bare, "-$", "")
    minus_before = bare.startswith("-")
    bare = F.regexp_replace(bare, "^-", "")
    comma, dot = bare.contains(","), bare.contains(".")
    comma_last = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    plain = (
        F.when(comma & dot & comma_last, F.translate(F.replace(bare, F.lit("."), F.lit("")), ",", "."))
        .when(comma & dot, F.replace(bare, F.lit(","), F.lit("")))
        .when(comma & bare.rlike(r",[^,]{2}$"), F.concat(F.replace(F.regexp_replace(bare, r",[^,]*$", ""), F.lit(","), F.lit("")), F.lit("."), F.substring_index(bare, ",", -1)))
        .otherwise(F.replace(bare, F.lit(","), F.lit("")))
    )
    value = F.when(plain.rlike(r"^\d+(\.\d+)?$"), F.round(plain.try_cast("decimal(30,8)") * 100, 0).cast("long"))
    return F.when(bracketed | minus_after | minus_before, -value).otherwise(value)


def printed_date(printed: Column, today: Column, month_first: Column | None = None) -> Column:
    """A struct ``(iso, note)`` of a printed date: ``iso`` is null where it cannot be right, ``note`` says what needs a person."""
    month_first = F.lit(False) if month_first is None else F.coalesce(month_first, F.lit(False))
    shown = F.trim(F.regexp_replace(F.coalesce(printed, F.lit("")), r"\s+", " "))
    bare = F.trim(F.regexp_replace(shown, r"[ T]\d{1,2}:\d{2}(:\d{2})?\s*([AaPp][Mm])?$", ""))

    def read(text: Column) -> Column:
        """``(text, day, slash)`` by the first format that fits."""
        shaped = None
        for shape, form, slash in DATE_FORMATS:
            day = F.to_date(F.try_to_timestamp(F.initcap(text) if "MMM" in form else text, F.lit(form)))
            item = F.struct(text.alias("text"), day.alias("day"), F.lit(slash).alias("slash"))
            shaped = F.when(text.rlike(f"^{shape}$"), item) if shaped is None else shaped.when(text.rlike(f"^{shape}$"), item)
        return shaped.otherwise(F.struct(text.alias("text"), F.lit(None).cast("date").alias("day"), F.lit(False).alias("slash")))

    def judged(found: Column) -> Column:
        # two digits of a year from 69 on are of the last century
        short = found["text"].rlike(r"\D\d{2}$")
        day = F.when(short & (F.year(found["day"]) >= 2069), F.add_months(found["day"], -1200)).otherwise(found["day"])
        return F.struct(found["text"].alias("text"), day.alias("day"), found["slash"].alias("slash"))

    def said(found: Column) -> Column:
        day, iso = found["day"], F.date_format(found["day"], "yyyy-MM-dd")
        quoted = F.concat(F.lit("date '"), found["text"], F.lit("'"))
        fits = day.between(F.lit(EARLIEST).cast("date"), today)
        unsure = found["slash"] & ~month_first & (F.dayofmonth(day) <= 12) & (F.dayofmonth(day) != F.month(day))
        note = (
            F.when(F.coalesce(printed, F.lit("")) == "", "no date read")
            .when(day.isNull(), F.concat(quoted, F.lit(" not understood")))
            .when(~fits, F.concat(quoted, F.lit(" read as "), iso, F.lit(", which cannot be right")))
            .when(unsure, F.concat(quoted, F.lit(" is ambiguous; read as month/day ("), iso, F.lit(")")))
        )
        return F.struct(F.when(fits, iso).alias("iso"), note.alias("note"))

    return _with(_with(_with(bare, read), judged), said)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, which also keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _money(value: Column) -> Column:
    return F.when(value.isNull(), "?").otherwise(F.format_string("%.2f", value / 100))


def validate_readings(readings: DataFrame, today: Column, fallback: str = "fallback_date", reading: str = "reading") -> DataFrame:
    """A ledger row for each reading, every doubt noted; a reading that cannot be trusted is flagged, never lost.

    ``reading`` is a JSON text, parsed leniently (see ``READING``); ``fallback`` names the column with the file's date. All
    other columns pass. Text that is no object gives a row of zero cents with notes."""
    raw = F.from_json(reading, READING, {"mode": "PERMISSIVE"})
    df = readings.withColumn("_r", raw)
    total, subtotal = cents(F.col("_r.total")), cents(F.col("_r.subtotal"))
    code = F.upper(F.trim(F.coalesce("_r.currency", F.lit(""))))
    currency = F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(CURRENCY)
    df = df.withColumns({"_total": total, "_subtotal": subtotal, "_code": code, "currency": currency})
    df = df.withColumn("_date", printed_date(F.col("_r.date"), today, F.col("currency") == "USD"))
    df = df.withColumn("_items", F.transform(F.coalesce("_r.line_items", F.array().cast("array<struct<description:string,quantity:string,amount:string>>")), lambda i: F.struct(F.substring(F.coalesce(i["description"], F.lit("")), 1, 120).alias("description"), i["quantity"].alias("quantity"), cents(i["amount"]).alias("amount_cents"))))
    count = F.size("_items")
    df = df.withColumn("_sum", F.aggregate("_items", F.lit(0).cast("long"), lambda s, i: s + F.coalesce(i["amount_cents"], F.lit(0))))
    zero = lambda name: F.coalesce(cents(F.col(f"_r.{name}")), F.lit(0))
    base = F.coalesce("_subtotal", F.when(count > 0, F.col("_sum")))
    df = df.withColumn("_expected", base + zero("tax") + zero("tip") - F.abs(zero("discounts")))
    quoted = lambda c: F.when(c.isNull(), "None").otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    unread = F.transform(
        F.filter(F.coalesce("_r.line_items", F.array().cast("array<struct<description:string,quantity:string,amount:string>>")), lambda i: i["amount"].isNotNull() & cents(i["amount"]).isNull()),
        lambda i: F.concat(F.lit("line "), quoted(i["description"]), F.lit(": amount "), quoted(i["amount"]), F.lit(" not read")),
    )
    notes = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("_r").isNull(), "reading was not an object"),
                F.when(F.col("_total").isNull(), F.concat(F.lit("no total read ("), quoted(F.col("_r.total")), F.lit("); recorded as 0"))),
                F.when((F.col("_code") != "") & ~F.col("_code").rlike("^[A-Z]{3}$"), F.concat(F.lit("currency '"), F.col("_code"), F.lit(f"' not an ISO code; recorded as {CURRENCY}"))),
                F.col("_date.note"),
                F.when(F.col("_date.iso").isNull(), F.concat(F.lit("used the file's date, "), F.col(fallback))),
            )
        ),
        unread,
        F.array_compact(
            F.array(
                F.when((count > 0) & (F.abs(F.col("_sum") - F.col("_subtotal")) > TOLERANCE), F.concat(F.lit("line items sum to "), _money(F.col("_sum")), F.lit(", subtotal says "), _money(F.col("_subtotal")))),
                F.when(
                    F.abs(F.col("_expected") - F.col("_total")) > TOLERANCE,
                    F.concat(F.when(F.col("_subtotal").isNotNull(), "subtotal").otherwise("line items"), F.lit(" + tax + tip - discounts = "), _money(F.col("_expected")), F.lit(", total says "), _money(F.col("_total"))),
                ),
                F.when(F.col("_total") < 0, F.concat(F.lit("negative total "), _money(F.col("_total")), F.lit(" (a refund?)"))),
            )
        ),
    )
    category = F.lower(F.trim(F.coalesce("_r.category", F.lit(""))))
    merchant = F.substring(F.trim(F.coalesce("_r.merchant", F.lit(""))), 1, 120)
    df = df.withColumn("_notes", notes)
    return df.select(
        *readings.columns,
        F.coalesce("_date.iso", fallback).alias("txn_date"),
        F.when(merchant != "", merchant).alias("merchant"),
        F.coalesce("_total", F.lit(0)).alias("amount_cents"),
        "currency",
        F.when(category.isin(*CATEGORIES), category).otherwise("other").alias("category"),
        masked_payment(F.col("_r.payment_method")).alias("payment_method"),
        F.when(count > 0, F.concat(count.cast("string"), F.lit(" line item(s)"))).alias("description"),
        F.to_json("_items").alias("line_items"),
        F.when(F.size("_notes") > 0, 1).otherwise(0).alias("needs_review"),
        F.when(F.size("_notes") > 0, F.array_join("_notes", "; ")).alias("review_notes"),
    )


def receipt_text(reading: Column) -> Column:
    """A reading (a struct as ``READING``) as plain lines, amounts as printed."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    items = F.transform(
        F.coalesce(reading["line_items"], F.array().cast("array<struct<description:string,quantity:string,amount:string>>")),
        lambda i: F.concat(F.lit("- "), F.when(filled(i["quantity"]), F.concat(i["quantity"], F.lit(" x "))).otherwise(""), F.coalesce(i["description"], F.lit("")), F.lit(": "), F.when(filled(i["amount"]), i["amount"]).otherwise("?")),
    )
    sums = [F.when(filled(reading[n]), F.concat(F.lit(f"{n.capitalize()}: "), reading[n])) for n in ("subtotal", "tax", "tip", "discounts", "total")]
    head = [F.when(filled(reading["merchant"]), reading["merchant"]).otherwise("Unknown merchant"), F.when(filled(reading["date"]), F.concat(F.lit("Date: "), reading["date"]))]
    tail = [F.when(filled(reading["payment_method"]), F.concat(F.lit("Paid with: "), masked_payment(reading["payment_method"]))), F.when(filled(reading["category"]), F.concat(F.lit("Category: "), reading["category"]))]
    return F.array_join(F.concat(F.array_compact(F.array(*head)), items, F.array_compact(F.array(*sums, *tail))), "\n")


#: The fields of a reading that are texts or null.
READING_TEXTS = ("merchant", "date", "currency", "subtotal", "tax", "tip", "discounts", "total", "payment_method", "category")


def reading_schema() -> dict:
    """The JSON schema that a reading is asked to follow: texts or nulls as printed, a list of line items, a category of those there are."""
    text = {"type": ["string", "null"]}
    item = {"type": "object", "properties": {n: text for n in ("description", "quantity", "amount")}, "required": ["description", "amount"]}
    fields = {n: text for n in READING_TEXTS if n != "category"} | {"line_items": {"type": "array", "items": item}, "category": {"type": "string", "enum": list(CATEGORIES)}}
    return {"type": "object", "properties": fields, "required": ["merchant", "date", "total", "line_items", "category"]}


def schema_faults(reading: Column) -> Column:
    """Where a JSON text does not follow the schema, in the order of its fields; empty where it does. Text that is no object has that one fault."""
    whole = F.try_parse_json(reading)
    part = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(part(name)), F.lit("VOID"))
    found = [F.when(~kind(n).isin("STRING", "VOID"), f"{n}: no text") for n in READING_TEXTS]
    found.append(F.when(~kind("line_items").startswith("ARRAY") & (kind("line_items") != "VOID"), "line_items: no list"))
    category = F.lower(F.trim(F.try_variant_get(whole, "$.category", "string")))
    found.append(F.when((kind("category") == "STRING") & ~category.isin(*CATEGORIES), "category: unknown"))
    no_object = whole.isNull() | ~F.coalesce(F.schema_of_variant(whole), F.lit("")).startswith("OBJECT")
    return F.when(no_object, F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*found)))
