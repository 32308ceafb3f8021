import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fernglass.operators import intake as I
from fernglass.session import shared_folder
from fernglass.sources.tables import table_or_empty


def test_sensitive_documents_are_held(spark):
    docs = spark.createDataFrame([(1, "open", "password: hunter2hunter2"), (2, "vault", "password: hunter2hunter2"), (3, "open", "fine"), (4, "open", None)], "doc_id long, tier string, text string")
    clean, held = I.split_sensitive(docs)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4]
    row = held.first()
    assert (row["doc_id"], row["rules"]) == (1, "assigned_secret") and "hunter2hunter2" not in row["reason"] and "text" not in held.columns


def test_page_plans(spark):
    pages = spark.createDataFrame([(1, n, "") for n in range(4)] + [(2, 0, ""), (2, 1, "x" * 200), (2, 2, "intentionally blank")], "doc_id long, page long, text string")
    cached = spark.createDataFrame([(1, 0)], "doc_id long, page long")
    asked = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, page long")
    got = {(r["doc_id"], r["page"]): r["action"] for r in I.page_plan(pages, cached, asked, 1).collect()}
    assert got == {(1, 0): "cached", (1, 1): "deferred", (1, 2): "deferred", (1, 3): "read", (2, 0): "read", (2, 1): "read"}


def test_sealing(spark):
    key, rows = F.lit("0" * 32).cast("binary"), spark.createDataFrame([(b"content",)], "c binary")
    sealed = rows.select(I.sealed(F.col("c"), key).alias("b"))
    assert sealed.select(I.opened(F.col("b"), key, F.lit(hashlib.sha256(b"content").hexdigest()))).first()[0] == b"content"
    for wrong in (I.opened(F.col("b"), F.lit("1" * 32).cast("binary")), I.opened(F.col("b"), key, F.lit("x"))):
        with pytest.raises(Exception):
            sealed.select(wrong).collect()


def test_request_hashes(spark):
    want = hashlib.sha256(b"t\0" + json.dumps({"a": "1", "b": "2"}, separators=(",", ":")).encode()).hexdigest()
    rows = spark.createDataFrame([({"b": "2", "a": "1", "c": None},), ({"a": "1", "b": "2"},)], "m map<string,string>")
    assert {r[0] for r in rows.select(I.request_hash(F.lit("t"), F.col("m"))).collect()} == {want}


def test_stand_in_vectors(spark):
    got = {r["item_id"]: r["vector"] for r in I.hashed_vectors(spark.createDataFrame([(1, "a b"), (2, "b a A"), (3, "?"), (4, None)], "item_id long, text string"), 16).collect()}
    assert sorted(got) == [1, 2] and all(len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())


def test_names_in_quarantine(spark):
    rows = spark.createDataFrame([("a.tar.gz", "s/a.tar.gz", True), ("b", "s/b", True), ("c.md", "s/c.md", False)], "n string, o string, t boolean")
    assert [r[0] for r in rows.select(I.quarantine_path(F.col("n"), F.col("o"), F.col("t"))).collect()] == [f"a.tar.{hashlib.md5(b's/a.tar.gz').hexdigest()[:6]}.gz", f"b.{hashlib.md5(b's/b').hexdigest()[:6]}", "c.md"]


def test_missing_tables_are_empty(spark, tmp_path):
    schema = spark.createDataFrame([], "a long, b string").schema
    assert table_or_empty(spark, str(tmp_path), "none", schema).count() == 0
    spark.createDataFrame([(1,)], "a long").write.parquet(str(tmp_path / "some.parquet"))
    assert [tuple(r) for r in table_or_empty(spark, str(tmp_path), "some", schema).collect()] == [(1, None)]
    assert shared_folder(spark)
