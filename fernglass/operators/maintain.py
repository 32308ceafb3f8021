"""Maintenance of snapshots: every operator maps tables to the next version of a table."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uuid5
from ..session import cut

TOMBSTONED = ("retracted",)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of rows with their keys; columns that only one side has are null on the other."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """As ``upsert``, but columns that ``new`` lacks keep their old values."""
    mine = [c for c in new.columns if c != key]
    renamed = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in mine))
    joined = old.join(renamed, key, "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in old.columns else F.col(f"_new_{c}")
    columns = [F.col(key), *(pick(c).alias(c) if c in mine else F.col(c) for c in old.columns if c != key), *(F.col(f"_new_{c}").alias(c) for c in mine if c not in old.columns)]
    return joined.select(*columns)


def point_keys(chunks: DataFrame) -> DataFrame:
    """The chunks with ``point_id``, a UUID of source, document and index, so that writing again overwrites."""
    return chunks.withColumn("point_id", uuid5(F.concat_ws("|", "source_id", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))))


def touch(rows: DataFrame, seen: DataFrame, run_id: str, key: str = "doc_id") -> DataFrame:
    """The rows of documents in ``seen`` marked with the run."""
    marked = rows.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    return marked.withColumn("last_seen_run", F.when(F.col("_seen"), F.lit(run_id)).otherwise(F.col("last_seen_run"))).select(*rows.columns)


def stamp(rows: DataFrame, changes: DataFrame, columns: list[str], keep: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Columns set from ``changes``; a null in a column of ``keep`` keeps the old value."""
    renamed = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_set_{c}") for c in columns))
    new = lambda c: F.coalesce(f"_set_{c}", c) if c in (keep or []) else F.col(f"_set_{c}")
    joined = rows.join(renamed, key, "left")
    return joined.select(*(F.when(F.col("_hit"), new(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def drop_tails(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks without those at or past their document's new ``chunk_count``; documents without a count keep all."""
    return chunks.join(counts.select("doc_id", F.col("chunk_count").alias("_n")), "doc_id", "left").filter("_n is null or chunk_index < _n").select(*chunks.columns)


def drop_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("doc_id"), "doc_id", "left_anti")


def changed_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` whose (document, index) is not stored or has another hash; only keys and hashes of the stored side move."""
    kept = stored.select("doc_id", "chunk_index", F.col("content_hash").alias("_stored")).distinct()
    same = kept.withColumnRenamed("_stored", "content_hash")
    return new.join(same, ["doc_id", "chunk_index", "content_hash"], "left_anti")


def changed_documents(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Incoming documents but those whose hash is the indexed one."""
    done = state.filter(F.col("status") == "indexed").select("doc_id", "content_hash")
    return incoming.join(done, ["doc_id", "content_hash"], "left_anti")


def missing_from_run(documents: DataFrame, source_id: str, run_id: str) -> DataFrame:
    """Documents of a source that a run did not see; tombstones are left out."""
    return documents.filter((F.col("source_id") == source_id) & ~F.col("last_seen_run").eqNullSafe(F.lit(run_id)) & ~F.coalesce(F.col("lifecycle").isin(*TOMBSTONED), F.lit(False)))


def sweep_counts(rows: DataFrame, run_id: Column | str) -> DataFrame:
    """``source_id, total, stale, refused``: what a sweep of each source would delete; more than half is refused."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    counts = rows.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(~F.col("last_seen_run").eqNullSafe(run)).alias("stale"))
    return counts.withColumn("refused", F.col("stale") > F.col("total") * 0.5)


@dataclass(frozen=True)
class Swept:
    kept: DataFrame
    deleted: int


class SweepRefusedError(RuntimeError):
    """A sweep would delete too much, or what it compares with is incomplete."""


def sweep(rows: DataFrame, source_id: str, run_id: str, *, complete: bool, force: bool = False) -> Swept:
    """Rows without those of the source that the run did not see. Refuses an incomplete listing, and to delete more than half unless forced."""
    if not complete:
        raise SweepRefusedError("the listing is not complete")
    counts = sweep_counts(rows.filter(F.col("source_id") == source_id), run_id).first()
    if counts is None or not counts["stale"]:
        return Swept(rows, 0)
    if counts["refused"] and not force:
        raise SweepRefusedError(f"{counts['stale']} of {counts['total']} rows would go")
    gone = (F.col("source_id") == source_id) & ~F.col("last_seen_run").eqNullSafe(F.lit(run_id))
    return Swept(rows.filter(~F.coalesce(gone, F.lit(False))), counts["stale"])


def replace_document_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the documents in ``new`` replaced."""
    return drop_documents(rows, new).unionByName(new, allowMissingColumns=True)


def retract(documents: DataFrame, chunks: DataFrame, ledger: DataFrame, doc_ids: DataFrame, reason: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and ledger rows of the documents dropped; their state rows stay as tombstones without chunks."""
    gone = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    state = documents.join(gone, "doc_id", "left")
    state = state.withColumns({"lifecycle": F.when(F.col("_gone"), "retracted").otherwise(F.col("lifecycle")), "chunk_count": F.when(F.col("_gone"), 0).otherwise(F.col("chunk_count")), "status_detail": F.when(F.col("_gone"), f"{reason} ({now})").otherwise(F.col("status_detail"))})
    return state.select(*documents.columns), drop_documents(chunks, doc_ids), drop_documents(ledger, doc_ids)


def mark_for_reembedding(documents: DataFrame, source_id: str | None = None) -> DataFrame:
    """Hashes of open documents without a tombstone blanked, so that the next run takes them."""
    hit = (F.col("tier") == "open") & ~F.coalesce(F.col("lifecycle").isin(*TOMBSTONED), F.lit(False))
    if source_id is not None:
        hit = hit & (F.col("source_id") == source_id)
    return documents.withColumn("content_hash", F.when(hit, "").otherwise(F.col("content_hash")))


def append_log(log: DataFrame, entries: DataFrame, order: list[str], allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The log with entries that get the next ids in ``order``; a value outside ``allowed`` raises when rows are computed.

    Entries are sorted in ranges; each range counts, and an entry's id is the top id, the entries of the ranges before and its place in its own,
    so that no task has more than a range of them."""
    for column, values in (allowed or {}).items():
        entries = entries.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")))
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(entries.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_count"))
    before = counts.select("_range", F.coalesce(F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).first()[0]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("id", F.col("_place") + F.col("_before") + F.lit(top)).drop("_range", "_place", "_before")
    return log.unionByName(numbered, allowMissingColumns=True)


def field_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``field, stored, current`` of fields that differ between two one-row tables or maps ``field, value``; fields on one side differ."""
    a, b = stored.select("field", F.col("value").alias("stored")), current.select("field", F.col("value").alias("current"))
    return a.join(b, "field", "full").filter(~F.col("stored").eqNullSafe(F.col("current")))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, problem`` of files ``path, sha256`` that a manifest has and the folder lacks, that differ, or that it does not name."""
    a, b = manifest.select("path", F.col("sha256").alias("_m")), files.select("path", F.col("sha256").alias("_f"))
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "unexpected").when(F.col("_m") != F.col("_f"), "changed")
    return a.join(b, "path", "full").withColumn("problem", problem).filter("problem is not null").select("path", "problem")


def beyond_newest(bundles: DataFrame, keep: int, group: list[str] | None = None) -> DataFrame:
    """Bundles past the ``keep`` newest by name of each group."""
    window = Window.partitionBy(*(group or [])).orderBy(F.desc("name"))
    return bundles.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") > keep).drop("_n")


def reading_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Page readings ``doc_id, page, file_hash, ...`` with new ones in place of those of their page."""
    return upsert(old, new, ["doc_id", "page"])


def valid_readings(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Readings that are of the file as it is now, in page order."""
    return cache.join(files.select("doc_id", "file_hash"), ["doc_id", "file_hash"], "left_semi").orderBy("doc_id", "page")


def flip_due(documents: DataFrame, today: str) -> DataFrame:
    """Active documents whose ``review_after`` has come become stale and lose the date."""
    due = (F.col("lifecycle") == "active") & (F.col("review_after") <= today)
    due = F.coalesce(due, F.lit(False))
    return documents.withColumns({"lifecycle": F.when(due, "stale").otherwise(F.col("lifecycle")), "review_after": F.when(~due, F.col("review_after"))})


def run_counters(outcomes: DataFrame, names: list[str]) -> DataFrame:
    """A row per source with a counter for each outcome, from rows ``source_id, outcome``."""
    return outcomes.groupBy("source_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == n).alias(n) for n in names))


def schedule_reviews(documents: DataFrame, dates: DataFrame) -> DataFrame:
    """Documents with the review dates of ``doc_id, review_after``; a null date clears."""
    return stamp(documents, dates, ["review_after"])


def resolve_quarantine(quarantine: DataFrame, resolved: DataFrame, at: str) -> DataFrame:
    """Quarantine rows of ``id, resolution`` marked as resolved; rows that are resolved keep when and how."""
    open_ = quarantine.filter("resolved_at is null").select("id").join(resolved.select("id", "resolution"), "id").select("id", "resolution", F.lit(at).alias("resolved_at")).distinct()
    return stamp(quarantine, open_, ["resolved_at", "resolution"], key="id")


def start_sources(sources: DataFrame, started: DataFrame, run_id: str, at: str) -> DataFrame:
    """Sources with those of ``source_id, domain, source_type`` marked as running; new ones are added."""
    fresh = started.select("source_id", "domain", "source_type", F.lit(run_id).alias("last_run_id"), F.lit(at).alias("last_started_at"), F.lit("running").alias("last_status"), F.lit(None).cast("string").alias("last_error"))
    return merge_columns(sources, fresh, "source_id")


def finish_sources(sources: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """Sources with the outcomes ``source_id, last_status, last_error, docs_seen``; what a source has besides stays."""
    return merge_columns(sources, outcomes.withColumn("last_finished_at", F.lit(at)), "source_id")


def fingerprint(settings: dict[str, object]) -> str:
    """The settings that a collection's vectors depend on, as sorted JSON text."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)


def collection_for(stored: str | None, settings: dict[str, object], *, recreate: bool = False) -> str:
    """What to do with a collection: create, keep or recreate; other settings than the stored ones raise unless it may be made anew."""
    if stored is None:
        return "create"
    if stored == fingerprint(settings):
        return "keep"
    if not recreate:
        raise ValueError(f"the collection was made with other settings: {stored}")
    return "recreate"


def migrated(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Rows with the columns ``name: (type, value)`` that they lack; columns that are there stay as they are."""
    return rows.withColumns({name: F.lit(value).cast(kind) for name, (kind, value) in columns.items() if name not in rows.columns})


def reread_candidates(documents: DataFrame, blobs: DataFrame, domains: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """``source_id, domain, doc_ids`` of active documents of the domains whose originals are kept and have one of the suffixes."""
    kept = documents.filter(F.col("domain").isin(*domains) & (F.col("lifecycle") == "active") & F.lower("uri").rlike("(?:" + "|".join(re.escape(x) for x in suffixes) + ")$"))
    return kept.join(blobs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("source_id", "domain").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def packed_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    """Rows with vectors as bytes, four for each number, the least first; null vectors stay null."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return rows.withColumn(column, pack(column))


def unpacked_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    """The inverse of ``packed_vectors``; bytes that are no whole numbers raise."""

    @F.pandas_udf("array<float>")
    def unpack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))

    return rows.withColumn(column, unpack(column))


def with_extra(rows: DataFrame, known: list[str]) -> DataFrame:
    """Rows with their columns beyond ``known`` in one JSON text ``extra``, without nulls; ``{}`` where there are none."""
    others = [c for c in rows.columns if c not in known]
    return rows.select(*known, F.to_json(F.struct(*others)).alias("extra") if others else F.lit("{}").alias("extra"))


def extra_field(extra: Column, name: str, kind: str = "string") -> Column:
    """A field of ``extra``, null where there is none or it is of another kind."""
    return F.try_variant_get(F.try_parse_json(extra), f"$.{name}", kind)
