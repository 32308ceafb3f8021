"""Intake of documents: what must not be indexed, which pages need a reading, encrypted originals, stand-in vectors and bound requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_reason, findings, lacks_text
from .search import tokens

#: Characters below which a page has no text, and pages of a document that are read without being asked for.
PAGE_CHARS, AUTO_PAGES = 100, 30


def split_sensitive(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantined)`` documents; the latter with ``rules`` and a ``reason`` that shows no secret, and without their text.

    The scan sees every document of the open tier, also one that did not change, so that new rules reach old documents."""
    scanned = documents.withColumn("_found", F.when(F.col("tier") == "open", findings(F.coalesce("text", F.lit("")))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>")))
    clean = scanned.filter(F.size("_found") == 0).drop("_found")
    held = scanned.filter(F.size("_found") > 0)
    return clean, held.withColumns({"rules": F.array_join("_found.rule", ","), "reason": finding_reason(F.col("_found"))}).drop("_found", "text")


def quarantine_path(name: Column, origin: Column, taken: Column) -> Column:
    """A file's name in quarantine, with six digits of its origin's hash if the name is taken."""
    dot = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    stem = F.when(dot != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.when(taken, F.concat(stem, F.lit("."), F.substring(F.md5(origin), 1, 6), dot)).otherwise(name)


def page_plan(pages: DataFrame, cached: DataFrame, requested: DataFrame, auto_pages: int = AUTO_PAGES) -> DataFrame:
    """``doc_id, page, action`` of pages ``doc_id, page, text`` that have or need a reading: cached, read or deferred.

    Pages asked for are always read. Pages without text are read too, unless more than ``auto_pages`` of a document are not cached;
    then none of those are. Cached readings are always used."""
    rows = pages.select("doc_id", "page", lacks_text(F.coalesce("text", F.lit("")), PAGE_CHARS).alias("_bare"))
    rows = rows.join(cached.select("doc_id", "page").distinct().withColumn("_cached", F.lit(True)), ["doc_id", "page"], "left")
    rows = rows.join(requested.select("doc_id", "page").distinct().withColumn("_asked", F.lit(True)), ["doc_id", "page"], "left")
    rows = rows.filter("_asked or _bare").withColumn("_auto", F.col("_asked").isNull() & F.col("_cached").isNull())
    many = rows.groupBy("doc_id").agg((F.count_if("_auto") > auto_pages).alias("_many"))
    action = F.when(F.col("_cached"), "cached").when(F.col("_auto") & F.col("_many"), "deferred").otherwise("read")
    return rows.join(many, "doc_id").select("doc_id", "page", action.alias("action"))


def sealed(content: Column, key: Column) -> Column:
    """Bytes encrypted with a 16, 24 or 32 byte key by AES in Galois mode; the nonce stands before them."""
    return F.aes_encrypt(content, key, F.lit("GCM"))


def opened(blob: Column, key: Column, sha256: Column | None = None) -> Column:
    """The inverse of ``sealed``; a wrong key or other bytes raise, and so does a content whose hash is not ``sha256``."""
    content = F.aes_decrypt(blob, key, F.lit("GCM"))
    return content if sha256 is None else F.when(F.sha2(content, 256) == sha256, content).otherwise(F.raise_error(F.lit("content does not match its hash")).cast("binary"))


def hashed_vectors(texts: DataFrame, size: int = 64) -> DataFrame:
    """``item_id, vector``: a stand-in for a model's vectors, from words hashed into ``size`` cells with a sign, of length 1; texts without words have none."""
    words = texts.select("item_id", F.explode(tokens(F.col("text"))).alias("w")).withColumn("_h", F.xxhash64("w"))
    cells = words.groupBy("item_id", F.pmod("_h", F.lit(size)).cast("int").alias("cell")).agg(F.sum(F.when(F.shiftright("_h", 20) % 2 == 0, 1.0).otherwise(-1.0)).alias("v"))
    maps = cells.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("_m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n")).filter("_n > 0")
    return maps.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: (F.coalesce(F.try_element_at("_m", c), F.lit(0.0)) / F.col("_n")).cast("float")).alias("vector"))


def request_hash(tool: Column, arguments: Column) -> Column:
    """The hash that binds an approval to a tool and its arguments, a map: keys sorted, nulls dropped, so that order and omission make no difference."""
    kept = F.array_sort(F.map_entries(F.map_filter(arguments, lambda _, v: v.isNotNull())))
    return F.sha2(F.concat(tool, F.char(F.lit(0)), F.to_json(F.map_from_entries(kept))), 256)


def with_readings(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Rejected readings ``doc_id, page, status, detail`` with their document's path, by path and page."""
    return readings.filter(F.col("status") == "rejected").join(pages.select("doc_id", "uri").distinct(), "doc_id").select("uri", "page", "detail").orderBy("uri", "page")
