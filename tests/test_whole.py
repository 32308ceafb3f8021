"""Queries that must do the whole job: all rows, nothing cut off."""

import glob
import os

import pytest

import verify
from fernglass.operators import report as R
from fernglass.plans.catalog import QUERIES
from fernglass.plans.state import _DUCK_CHUNKS

FOLDER = "/root/testdata/sf0.001"
#: The whole job of queries whose registered SQL states less.
WHOLE_SQL = {
    "chunks_by_domain_zero_filled": _DUCK_CHUNKS + " SELECT v.domain, count(c.chunk_id) AS n FROM (VALUES ('infra'), ('manuals'), ('notes'), ('sdk-docs')) v(domain) LEFT JOIN c ON c.domain = v.domain GROUP BY 1",
    "eval_rank_compare": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars % 7 + 1 AS BIGINT) AS rank, CAST(n_chars % 5 + 1 AS BIGINT) AS previous_rank, CAST(n_chars % 5 AS BIGINT) - CAST(n_chars % 7 AS BIGINT) AS change FROM documents",
    "receipt_validate": """
        WITH r AS (SELECT DISTINCT * FROM ledger), x AS (SELECT *, coalesce(try_cast(txn_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2026-12-31', false) AS dated FROM r)
        SELECT id, CASE WHEN dated THEN txn_date ELSE '2026-01-01' END AS txn_date, coalesce(amount_cents, 0) AS amount_cents, 'USD' AS currency,
               CASE WHEN NOT dated OR amount_cents IS NULL OR amount_cents < 0 THEN 1 ELSE 0 END AS needs_review FROM x""",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(WHOLE_SQL))
def test_whole_sql(spark, name):
    connection = pytest.importorskip("duckdb").connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    assert verify.spark_rows(QUERIES[name](spark, FOLDER)) == verify.duck_rows(connection, WHOLE_SQL[name])


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables to a folder and returns it."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


CHUNKS = "chunk_id string, doc_id long, chunk_index long, domain string, text string, token_count long, indexed_at string, last_seen_run string, vector array<float>"


def chunk(doc_id, index, domain, text="some text", at="2026-01-01T00:00:00Z"):
    return (f"{doc_id}-{index}", doc_id, index, domain, text, 2, at, "r", None)


def test_chunks_of_every_domain_are_counted(spark, tables):
    rows = [chunk(1, 0, "manuals"), chunk(1, 1, "manuals"), chunk(1, 13, "manuals"), chunk(2, 0, "notes"), chunk(2, 0, "notes", at="2026-01-02T00:00:00Z"), chunk(3, 0, "sdk-docs"), chunk(4, 0, "personal"), chunk(5, 0, None)]
    folder = tables(chunks=spark.createDataFrame(rows, CHUNKS))
    found = {r["domain"]: r["n"] for r in QUERIES["chunks_by_domain_zero_filled"](spark, folder).collect()}
    assert found == {"infra": 0, "manuals": 3, "notes": 1, "sdk-docs": 1}


def test_ranks_of_every_document_are_compared(spark, tables):
    folder = tables(documents=spark.createDataFrame([(n, n) for n in range(1, 101)], "doc_id long, n_chars long"))
    found = {r["id"]: (r["rank"], r["previous_rank"], r["change"]) for r in QUERIES["eval_rank_compare"](spark, folder).collect()}
    assert len(found) == 100 and found["41"] == (7, 2, -5) and found["100"] == (3, 1, -2)


def test_changes_are_stated_for_equal_questions_only(spark):
    latest = spark.createDataFrame([("h", "a", 1), ("h", "b", 2)], "questions_hash string, id string, rank long")
    previous = spark.createDataFrame([("h", "a", 3), ("other", "b", 1)], "questions_hash string, id string, rank long")
    assert sorted(map(tuple, R.rank_changes(latest, previous).collect())) == [("a", 1, 3, 2), ("b", 2, None, None)]


LEDGER = "id long, txn_date string, merchant string, amount_cents long, payment_method string, category string"


def test_every_ledger_row_is_read(spark, tables):
    rows = [(1, "2026-03-04", "Shop", 550, None, "fuel"), (2, None, "Shop", 550, None, "fuel"), (3, "2026-03-04", None, 550, None, "fuel"), (4, "2026-03-04", "Shop", None, None, "fuel"), (5, "2026-03-04", "Shop", -123456, None, "fuel"), (6, None, None, None, None, None)]
    folder = tables(ledger=spark.createDataFrame([*rows, rows[0]], LEDGER))
    found = {r["id"]: (r["txn_date"], r["amount_cents"], r["needs_review"]) for r in QUERIES["receipt_validate"](spark, folder).collect()}
    assert found == {1: ("2026-03-04", 550, 0), 2: ("2026-01-01", 550, 1), 3: ("2026-03-04", 550, 0), 4: ("2026-03-04", 0, 1), 5: ("2026-03-04", -123456, 1), 6: ("2026-01-01", 0, 1)}
    texts = {r["id"]: r["text"].split("\n") for r in QUERIES["receipt_text"](spark, folder).collect()}
    assert len(texts) == 6 and texts[5] == ["Shop", "Date: 2026-03-04", "Total: $-1,234.56", "Category: fuel"] and texts[6] == ["Unknown merchant"]


def test_questions_are_whole_passages(spark, tables):
    same = "the valve and the pump are in the manual of the plant and are to be looked at before each start by two persons of the shift who "
    rows = [chunk(20, 0, "notes", same + "polish zirconium"), chunk(40, 0, "notes", "grease"), chunk(60, 0, "notes", " "), *(chunk(n, 0, "notes", same) for n in range(1, 13)), *(chunk(n, 0, "notes", "other words") for n in range(101, 113))]
    folder = tables(chunks=spark.createDataFrame(rows, CHUNKS), documents=spark.createDataFrame([(r[1], f"{r[1]}.txt") for r in rows], "doc_id long, uri string"))
    # by its first 120 characters alone document 20 comes after the twelve shorter ones
    assert tuple(QUERIES["hit_at_k_mrr"](spark, folder).first()) == (2, 1.0, 1.0, 1.0)
