"""Operational reports over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The domains and their tiers.
DOMAIN_TIERS = {"manuals": "open", "sdk-docs": "open", "notes": "open", "infra": "open", "receipts": "vault", "financial": "vault", "transcripts": "vault", "personal": "vault"}


def domains_in(tier: str) -> list[str]:
    return sorted(d for d, t in DOMAIN_TIERS.items() if t == tier)


def tier_of(domain: Column) -> Column:
    """The tier of a domain; an unknown one raises when rows are computed, as none may be guessed."""
    known = F.create_map(*(F.lit(x) for pair in DOMAIN_TIERS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, domain), F.raise_error(F.concat(F.lit("unknown domain "), F.coalesce(domain, F.lit("null")))).cast("string"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def chunks_by_domain(chunks: DataFrame, tier: str = "open") -> DataFrame:
    """``domain, n`` for every domain of the tier, zero where it has none."""
    spark = chunks.sparkSession
    dimension = spark.createDataFrame([(d,) for d in domains_in(tier)], "domain string")
    counts = chunks.groupBy("domain").agg(F.count("*").alias("n"))
    return dimension.join(counts, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))


def matching_documents(documents: DataFrame, match: str | None = None, domain: str | None = None, tier: str = "open", include_all: bool = False) -> DataFrame:
    """Documents of a tier whose path has ``match`` in any case, literally; active ones unless ``include_all``; by domain and path."""
    rows = documents.filter((F.col("tier") == tier) & F.col("domain").isin(*domains_in(tier)))
    if domain:
        rows = rows.filter(F.col("domain") == domain)
    if match:
        rows = rows.filter(F.lower("uri").contains(match.lower()))
    if not include_all:
        rows = rows.filter(F.col("lifecycle") == "active")
    return rows.select("doc_id", "domain", "uri", "title", "status", "lifecycle", "chunk_count").orderBy("domain", "uri", "doc_id")


def by_path_end(documents: DataFrame, path: str, domain: str | None = None) -> DataFrame:
    """Documents whose path is ``path`` or ends in it after a slash, whatever the case of the end."""
    rows = documents.filter((F.col("uri") == path) | F.lower("uri").endswith("/" + path.lower()))
    return (rows.filter(F.col("domain") == domain) if domain else rows).orderBy("uri")


def open_quarantine(quarantine: DataFrame, tier: str = "open") -> DataFrame:
    """Unresolved rows of the tier's domains with their rules as a list; reasons are not shown."""
    rules = F.filter(F.transform(F.split(F.coalesce("rules", F.lit("")), "[,;|]"), lambda r: F.trim(r)), lambda r: r != "")
    rows = quarantine.filter(F.col("resolved_at").isNull() & F.col("domain").isin(*domains_in(tier)))
    return rows.select("id", "domain", "origin_path", rules.alias("rules"), "detected_at").distinct()


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def freshness(runs: DataFrame, now: Column, limits: dict[str, float], default: float = 2.0) -> DataFrame:
    """The latest attempt of each ``kind, target`` of ``id, kind, target, status, run_at, max_age_days``, with the age of its last good one and a level."""
    window = Window.partitionBy("kind", "target")
    good = F.max(F.when(F.col("status") == "ok", F.col("run_at"))).over(window)
    rows = runs.withColumns({"last_ok_at": good, "_n": F.row_number().over(window.orderBy(F.desc("id")))}).filter("_n = 1").drop("_n")
    limit = F.coalesce("max_age_days", *(F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()), F.lit(default))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_ok_at"))) / 86_400_000_000
    level = F.when(F.col("status") == "rollback", "bad").when(age.isNull() | (age > limit) | F.col("status").isin("failed", "partial"), "warn").otherwise("ok")
    return rows.withColumns({"age_days": age, "limit_days": limit, "level": level})


def rank_changes(latest: DataFrame, previous: DataFrame) -> DataFrame:
    """``id, rank, previous_rank, change`` of an evaluation beside the one before; changes are stated only for equal question sets.

    Each side has a row ``questions_hash, id, rank`` per question."""
    cut = lambda df, r: df.select(F.col("questions_hash").alias(f"_{r}"), "id", F.col("rank").alias(r))
    both = cut(latest, "rank").join(cut(previous, "previous_rank"), "id", "left")
    same = F.col("_rank") == F.col("_previous_rank")
    return both.select("id", "rank", F.when(same, F.col("previous_rank")).alias("previous_rank"), F.when(same, F.col("previous_rank") - F.col("rank")).alias("change"))


def runs_over(runs: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """The newest runs with what they ran of ``sources``; runs that ran none of them are left out."""
    wanted = sources.agg(F.collect_set("source_id").alias("_ids"))  # sources are a dimension
    rows = runs.crossJoin(F.broadcast(wanted)).withColumn("open_sources", F.array_sort(F.array_intersect(F.split(F.coalesce("sources_run", F.lit("")), ","), "_ids")))
    return rows.filter(F.size("open_sources") > 0).orderBy(F.desc("started_at"), "run_id").limit(limit).select("run_id", "started_at", "open_sources")


def model_rows(hits: DataFrame) -> DataFrame:
    """Hits ``text, uri, locator, doc_id, chunk_index, score, lifecycle`` as what a model gets: text, citation and keys, lifecycle only if not active."""
    from ..functions.text import LOCATOR, citation

    return hits.select(F.col("text").alias("content"), citation(F.col("uri"), F.from_json("locator", LOCATOR)).alias("citation"), "doc_id", "chunk_index", F.bround("score", 3).alias("score"), F.when(F.col("lifecycle") != "active", F.col("lifecycle")).alias("lifecycle"))


def recorded_sources(configured: DataFrame, recorded: DataFrame, counts: DataFrame) -> DataFrame:
    """Configured sources and ones that only the state knows, with last run and chunk count; disabled ones are left out."""
    shut = configured.filter(~F.coalesce("enabled", F.lit(True))).select("source_id")
    c = configured.filter(F.coalesce("enabled", F.lit(True))).select("source_id", F.col("domain").alias("_c"), F.lit(True).alias("configured"))
    r = recorded.select("source_id", F.col("domain").alias("_r"), "last_run_id", "last_status").join(shut, "source_id", "left_anti")
    both = c.join(r, "source_id", "full").join(counts, "source_id", "left")
    return both.select("source_id", F.coalesce("_c", "_r").alias("domain"), F.coalesce("configured", F.lit(False)).alias("configured"), "last_run_id", "last_status", F.coalesce("n", F.lit(0)).alias("chunks"))


def flagged_pages(documents: DataFrame) -> DataFrame:
    """``uri, domain, flagged_pages`` of documents with pages to look at, most first; a retracted one is read no more, so there is nothing to look at."""
    rows = documents.filter((F.col("flagged_pages") > 0) & ~F.coalesce(F.col("lifecycle") == "retracted", F.lit(False)))
    return rows.select("uri", "domain", "flagged_pages").orderBy(F.desc("flagged_pages"), "uri")


def inventory(documents: DataFrame, tier: str = "vault", domain: str | None = None, include_all: bool = False) -> DataFrame:
    """Documents of the guarded tier by domain and path; active ones unless ``include_all``."""
    rows = documents.filter(F.col("tier") == tier)
    rows = rows.filter(F.col("domain") == domain) if domain else rows
    rows = rows if include_all else rows.filter("lifecycle = 'active'")
    return rows.select("doc_id", "uri", "domain", "lifecycle", "chunk_count", "status", "indexed_at").orderBy("domain", "uri", "doc_id")


def backup_rows(attempts: DataFrame) -> DataFrame:
    """What of backups may be shown: the columns on the list, whatever else there is; details can name places."""
    return attempts.select("kind", "target", "status", "run_at", "last_ok_at", "age_days", "level")


def sources_in_order(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source_id")


def index_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``part, name, n``: documents by status and by lifecycle and chunks by domain, in one table."""
    part = lambda rows, name, column: rows.groupBy(F.lit(name).alias("part"), F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return part(documents, "status", "status").unionByName(part(documents, "lifecycle", "lifecycle")).unionByName(part(chunks, "chunks", "domain"))


def evaluation_history(runs: DataFrame) -> DataFrame:
    """Evaluations ``id, questions_hash, mrr`` with ``change``, against the one before of the same questions."""
    before = F.lag("mrr").over(Window.partitionBy("questions_hash").orderBy("id"))
    return runs.withColumn("change", F.round(F.col("mrr") - before, 6))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Sources ``source_id, cadence, last_started`` whose cadence (``15 minutes``, ``2 hours``, ``1 day``) has passed since they last started, or that never did.

    No cadence, or one that can't be read, means at every run."""
    number, unit = F.regexp_extract("cadence", r"^\s*(\d+)\s*(minute|hour|day)s?\s*$", 1), F.regexp_extract("cadence", r"^\s*(\d+)\s*(minute|hour|day)s?\s*$", 2)
    seconds = number.try_cast("long") * F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86_400)
    passed = F.unix_seconds(now) - F.unix_seconds("last_started") >= F.coalesce(seconds, F.lit(0))
    return sources.filter(F.col("last_started").isNull() | passed)


def with_domain_check(requests: DataFrame, tier: str) -> DataFrame:
    """Requests ``domains`` (an array; null or empty asks for all of the tier) with ``searched`` and ``refusal``: unknown domains, and those of the other tier, refuse."""
    known = F.array(*map(F.lit, domains_in(tier)))
    asked = F.coalesce("domains", F.array().cast("array<string>"))
    wrong = F.array_sort(F.array_except(asked, known))
    rows = requests.withColumn("refusal", F.when(F.size(wrong) > 0, F.concat(F.lit(f"no domain of the {tier} tier: "), F.array_join(wrong, ", "))))
    return rows.withColumn("searched", F.when(F.col("refusal").isNull(), F.when(F.size(asked) == 0, known).otherwise(F.array_sort(F.array_distinct(asked)))))
