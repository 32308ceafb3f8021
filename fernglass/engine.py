"""The API: an engine over a folder of tables, whose methods return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stale_banner
from .operators import ledger, maintain, report, search
from .session import ship
from .sources.tables import table

VIEWS = ("overview", "documents", "lifecycle", "quarantine")


class Engine:
    """Retrieval, ledger and reports over ``documents``, ``chunks``, ``ledger``, ``runs``, ``sources`` and ``quarantine``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = ship(spark), folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _domains(self, domains: list[str] | None, tier: str) -> list[str]:
        known = report.domains_in(tier)
        wrong = sorted(set(domains or ()) - set(known))
        if wrong:
            raise ValueError(f"no domain of the {tier} tier: {', '.join(wrong)}; valid: {', '.join(known)}")
        return domains or known

    def visible(self, tier: str, domains: list[str] | None = None, *, source_id: str | None = None, superseded: bool = False, stale: bool = False) -> DataFrame:
        """Chunks that a search may find, with path, lifecycle and what stands before stale text; retracted ones never are."""
        seen = ["active", *["superseded"] * superseded, *["stale"] * stale]
        docs = self.table("documents").filter((F.col("tier") == tier) & F.col("domain").isin(*self._domains(domains, tier)) & F.col("lifecycle").isin(*seen))
        if source_id:
            docs = docs.filter(F.col("source_id") == source_id)
        chunks = self.table("chunks").select("chunk_id", "doc_id", "chunk_index", "text", "vector", "locator").dropDuplicates(["chunk_id"])
        joined = chunks.join(docs.select("doc_id", "uri", "domain", "lifecycle", "status_detail", "indexed_at"), "doc_id")
        banner = stale_banner(F.col("status_detail"), F.substring("indexed_at", 1, 10))
        return joined.withColumn("text", F.when(F.col("lifecycle") == "stale", F.concat(banner, F.lit("\n"), "text")).otherwise(F.col("text")))

    def search(self, queries: DataFrame, limit: int = 3, tier: str = "open", **scope) -> DataFrame:
        """Hybrid hits of ``query_id, text, vector``: both branches filtered before they are ranked, fused, cut by score, path and index."""
        found = self.visible(tier, **scope)
        items = found.withColumnRenamed("chunk_id", "item_id")
        depth = 40 if tier == "open" else limit
        near = search.dense_topk(queries.select("query_id", "vector"), items.select("item_id", "vector").filter("vector is not null"), depth)
        words = search.bm25(queries.select("query_id", "text"), items.select("item_id", "text").filter("text is not null"), depth, every_term=tier == "vault")
        if tier == "vault":
            hits = search.shown_scores(search.fuse(near, words, search.FUSE_VAULT, limit), near, words)
            return hits.join(items.drop("vector"), "item_id")
        wide = search.fuse(near, words, search.FUSE_OPEN, limit + 10).join(items.drop("vector"), "item_id").drop("rank")
        order = [F.col("uri"), F.coalesce("chunk_index", F.lit(0))]
        return search.rank_hits(wide, limit, order).join(items.drop("vector"), "item_id")

    def projected(self, hits: DataFrame) -> DataFrame:
        """What a model gets of hits: text, citation and keys, no vectors and no paths but those of the citation."""
        return report.model_rows(hits)

    def context(self, hits: DataFrame, before: int = 1, after: int = 1, tier: str = "open") -> DataFrame:
        """Chunks around hits; of the vault only active documents' ones, and without a cap on the width."""
        chunks = self.table("chunks").select("chunk_id", "doc_id", "chunk_index", "text").dropDuplicates(["chunk_id"])
        if tier == "vault":
            chunks = chunks.join(self.table("documents").filter("lifecycle = 'active'").select("doc_id"), "doc_id", "left_semi")
        return search.with_context(hits, chunks, before, after, 2 if tier == "open" else 1 << 20)

    def ledger(self, by: str | None = None, limit: int = 100, start: str | None = None, end: str | None = None, **filters) -> tuple[DataFrame, DataFrame]:
        """Rows or groups, and the totals over all that match, whatever the limit."""
        rows = ledger.select_rows(self.table("ledger").dropDuplicates(), start, end, **filters)
        return (ledger.grouped(rows, by, limit) if by else ledger.latest_rows(rows, limit)), ledger.totals(rows)

    def pending_review(self, today: str) -> DataFrame:
        return maintain.flip_due(self.table("documents"), today)

    def report(self, view: str, **filters) -> DataFrame:
        """A report of the open tier by name; unknown names raise."""
        docs = self.table("documents")
        if view == "overview":
            return report.count_by(docs.filter("tier = 'open'"), "status")
        if view == "documents":
            return report.matching_documents(docs, **filters)
        if view == "lifecycle":
            return docs.filter("tier = 'open' and lifecycle <> 'active'").select("doc_id", "uri", "lifecycle").orderBy("lifecycle", "uri")
        if view == "quarantine":
            return report.open_quarantine(self.table("quarantine"))
        raise ValueError(f"unknown view {view!r}; valid: {', '.join(VIEWS)}")
