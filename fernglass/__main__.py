"""python -m fernglass FOLDER COMMAND ...: the API from a terminal. Rows go to the terminal as JSON lines; a fault in the arguments ends with status 2."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import VIEWS, Engine
from .operators import report
from .operators.intake import hashed_vectors
from .operators.search import bm25
from .session import get_session


def _say(rows: DataFrame, limit: int) -> None:
    for row in rows.limit(limit).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fernglass", description=__doc__)
    out.add_argument("folder")
    out.add_argument("--rows", type=int, default=1000, help="rows to print at most")
    commands = out.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search", help="chunks that answer a question")
    find.add_argument("question")
    find.add_argument("--limit", type=int, default=3)
    find.add_argument("--tier", choices=("open", "vault"), default="open")
    find.add_argument("--domain", action="append")
    find.add_argument("--words", action="store_true", help="by words alone")
    ledger = commands.add_parser("ledger", help="rows or groups of the ledger, and totals")
    for name in ("by", "start", "end", "merchant", "category", "currency", "payment-method"):
        ledger.add_argument(f"--{name}")
    view = commands.add_parser("report", help="a report by name")
    view.add_argument("view", choices=VIEWS)
    listing = commands.add_parser("list", help="documents by domain and path")
    listing.add_argument("--match")
    listing.add_argument("--domain")
    listing.add_argument("--tier", choices=("open", "vault"), default="open")
    listing.add_argument("--all", action="store_true")
    commands.add_parser("pending", help="documents that the next run must process")
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(get_session(), a.folder)
    try:
        if a.command == "search":
            question = engine.spark.createDataFrame([(0, a.question)], "query_id long, text string")
            if a.words:
                items = engine.visible(a.tier, a.domain).select(F.col("chunk_id").alias("item_id"), "text", "uri", "chunk_index")
                hits = bm25(question, items.select("item_id", "text"), a.limit).join(items, "item_id")
            else:
                vectors = hashed_vectors(question.withColumnRenamed("query_id", "item_id")).withColumnRenamed("item_id", "query_id")
                hits = engine.search(question.join(vectors, "query_id", "left"), a.limit, a.tier, domains=a.domain)
            _say(hits.orderBy("rank").select("rank", "score", "uri", "chunk_index", "text"), a.rows)
        elif a.command == "ledger":
            rows, totals = engine.ledger(a.by, a.rows, a.start, a.end, merchant=a.merchant, category=a.category, currency=a.currency, payment_method=a.payment_method)
            _say(rows, a.rows)
            _say(totals, 1)
        elif a.command == "report":
            _say(engine.report(a.view), a.rows)
        elif a.command == "list":
            docs = engine.table("documents")
            _say(report.matching_documents(docs, a.match, a.domain, a.tier, a.all), a.rows)
        else:
            from .operators.incremental import pending_documents

            _say(pending_documents(engine.table("documents"), engine.table("doc_log"), engine.table("runs")).orderBy("doc_id"), a.rows)
    except ValueError as fault:
        print(fault, file=sys.stderr)
        return 2
    return 0



if __name__ == "__main__":
    raise SystemExit(main())
