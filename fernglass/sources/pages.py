"""Documents that come as pages: texts of page layers with their readings and fonts, and receipts with what was read of them.

Pages are accepted as tables, as drawing and reading them needs programs beside the engine: ``doc_id, page, raw, reading`` with ``raw`` in stored
order and ``reading`` in reading order, text runs ``doc_id, page, number, top, size, text``, and readings ``doc_id, page, markdown, status``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.receipts import READING, receipt_text, validate_readings
from ..functions.text import lacks_text
from ..operators import structure as S
from ..operators.intake import PAGE_CHARS


def page_texts(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """``doc_id, page, text, headings, read``: the text of each page that is not a list of contents: its reading where there is one that is ok, its own layer else.

    The layer's words that run together are parted as in reading order. A page without text and without a reading has an empty text."""
    own = S.respace_pages(pages.select("doc_id", "page", F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("reading", F.lit("")).alias("reading")))
    counted = own.join(own.groupBy("doc_id").agg(F.count("*").alias("page_count")), "doc_id")
    kept = counted.join(S.contents_pages(counted).select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    good = S.heading_strip(readings.filter("status = 'ok'").select("doc_id", "page", F.col("markdown").alias("text"))).select("doc_id", "page", "plain", F.col("headings").alias("_headings"))
    both = kept.join(good, ["doc_id", "page"], "left")
    none = F.array().cast("array<struct<title:string,level:int>>")
    return both.select("doc_id", "page", F.coalesce("plain", "text").alias("text"), F.coalesce("_headings", none).alias("headings"), F.col("plain").isNotNull().alias("read"))


def page_blocks(pages: DataFrame, runs: DataFrame, readings: DataFrame) -> DataFrame:
    """``doc_id, page, section, text, heading_path, opens``: sections of pages in order, by the headings of a reading or else of the page's fonts, the path carried on."""
    texts = page_texts(pages, readings)
    fonts = S.font_headings(runs).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("number", F.col("heading").alias("title"), "level"))).alias("f"))
    fonts = fonts.select("doc_id", "page", F.transform("f", lambda h: F.struct(h["title"].alias("title"), h["level"].alias("level"))).alias("_fonts"))
    joined = texts.join(fonts, ["doc_id", "page"], "left")
    return S.document_sections(joined.select("doc_id", "page", "text", F.when(F.col("read"), F.col("headings")).otherwise(F.coalesce("_fonts", "headings")).alias("headings")))


def page_status(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """``doc_id, status, flagged_pages``: ok, empty, or ocr_required where no page has enough text; pages without text or reading are flagged."""
    bare = lacks_text(F.coalesce("raw", F.lit("")), PAGE_CHARS)
    read = readings.filter("status = 'ok'").select("doc_id", "page").distinct().withColumn("_read", F.lit(True))
    rows = pages.withColumn("_bare", bare).join(read, ["doc_id", "page"], "left").withColumn("_bare", F.col("_bare") & F.col("_read").isNull())
    counts = rows.groupBy("doc_id").agg(F.count_if("_bare").alias("flagged_pages"), F.count("*").alias("_n"), F.max(F.length(F.trim(F.coalesce("raw", F.lit(""))))).alias("_most"))
    status = F.when(F.col("flagged_pages") < F.col("_n"), "ok").when(F.col("_most") > 0, "ocr_required").otherwise("empty")
    return counts.select("doc_id", status.alias("status"), "flagged_pages")


def receipts(files: DataFrame, readings: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """``(documents, ledger rows)`` of receipt files ``doc_id, mtime`` and what was read of them, ``doc_id, reading`` as JSON text.

    A receipt's document is its reading as plain lines, or empty without one; its ledger row is checked, and every doubt noted."""
    dated = files.withColumn("fallback_date", F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd"))
    both = dated.join(readings.select("doc_id", "reading"), "doc_id", "left")
    text = F.when(F.col("reading").isNotNull(), receipt_text(F.from_json("reading", READING)))
    documents = both.select("doc_id", text.alias("text"), F.when(F.col("reading").isNull(), "empty").otherwise("ok").alias("status"), F.lit("receipt").alias("extractor"))
    return documents, validate_readings(both.filter("reading is not null").select("doc_id", "reading", "fallback_date"), today).drop("reading", "fallback_date")


def test_set(rows: DataFrame) -> DataFrame:
    """Questions ``id, question, uri, expect`` of a retrieval test; one without any of them raises when rows are computed, as a question passed over is a hit."""
    whole = F.lit(True)
    for name in ("id", "question", "uri", "expect"):
        whole = whole & (F.trim(F.coalesce(name, F.lit(""))) != "")
    fault = F.raise_error(F.concat(F.lit("question without id, question, uri or expect: "), F.coalesce("id", "question", F.lit("?")))).cast("string")
    return rows.select(F.when(whole, F.col("id")).otherwise(fault).alias("id"), "question", "uri", "expect")
