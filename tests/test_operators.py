import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernglass.operators import maintain as M
from fernglass.operators import report as R
from fernglass.operators import search as S

STATE = "doc_id long, source_id string, domain string, tier string, uri string, title string, content_hash string, chunk_count long, status string, status_detail string, last_seen_run string, lifecycle string, indexed_at string"


def doc(n, **more):
    base = dict(doc_id=n, source_id="s", domain="notes", tier="open", uri=f"a/{n}.md", title=f"T{n}", content_hash=f"h{n}", chunk_count=3, status="indexed", status_detail=None, last_seen_run="r1", lifecycle="active", indexed_at="2026-01-01T00:00:00Z")
    return tuple({**base, **more}.values())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([doc(1), doc(2, last_seen_run=None), doc(3, lifecycle="retracted", last_seen_run="r0"), doc(4, source_id="t", status="empty"), doc(5, domain="personal", tier="vault", last_seen_run="r0")], STATE)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, t string, keep string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "doc_id long, t string")
    assert sorted(map(tuple, M.upsert(old, new, ["doc_id"]).collect())) == [(1, "a", "x"), (2, "B", None), (3, "C", None)]
    assert sorted(map(tuple, M.merge_columns(old, new, "doc_id").collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None)]
    assert M.upsert(old, new.limit(0), ["doc_id"]).count() == 2


def test_a_partly_changed_document_keeps_its_other_chunks(spark):
    stored = spark.createDataFrame([(1, n, f"h{n}", "r1") for n in range(4)], "doc_id long, chunk_index long, content_hash string, last_seen_run string")
    new = spark.createDataFrame([(1, 0, "h0", "r2"), (1, 1, "new", "r2"), (1, 2, "h2", "r2")], stored.schema)
    changed = M.changed_chunks(new, stored)
    assert [(r["chunk_index"], r["content_hash"]) for r in changed.collect()] == [(1, "new")]
    after = M.touch(M.upsert(stored, changed, ["doc_id", "chunk_index"]), new, "r2")
    after = M.drop_tails(after, spark.createDataFrame([(1, 3)], "doc_id long, chunk_count long"))
    assert sorted((r["chunk_index"], r["content_hash"], r["last_seen_run"]) for r in after.collect()) == [(0, "h0", "r2"), (1, "new", "r2"), (2, "h2", "r2")]


def test_sweep_guards(spark):
    rows = spark.createDataFrame([(1, "s", "r2"), (2, "s", "r1"), (3, "s", None), (4, "s", "r2"), (5, "t", "r1")], "doc_id long, source_id string, last_seen_run string")
    assert ids(M.sweep(rows, "s", "r2", complete=True).kept) == [1, 4, 5]  # exactly half may go
    with pytest.raises(M.SweepRefusedError):
        M.sweep(rows, "s", "r2", complete=False)
    with pytest.raises(M.SweepRefusedError):
        M.sweep(rows, "s", "r3", complete=True)
    assert M.sweep(rows, "s", "r3", complete=True, force=True).deleted == 4
    assert M.sweep(rows, "none", "r3", complete=True).deleted == 0


def test_state_changes(spark, docs):
    assert ids(M.missing_from_run(docs, "s", "r1")) == [2, 5]
    assert ids(M.mark_for_reembedding(docs).filter("content_hash = ''")) == [1, 2, 4]
    stamped = M.stamp(docs, spark.createDataFrame([(1, "stale", None)], "doc_id long, lifecycle string, status_detail string"), ["lifecycle", "status_detail"], ["status_detail"])
    assert {r["doc_id"]: r["lifecycle"] for r in stamped.collect()}[1] == "stale" and stamped.columns == docs.columns
    due = docs.withColumn("review_after", F.when(F.col("doc_id") < 3, "2026-01-01"))
    assert sorted((r["doc_id"], r["lifecycle"], r["review_after"]) for r in M.flip_due(due, "2026-01-01").collect())[:3] == [(1, "stale", None), (2, "stale", None), (3, "retracted", None)]
    chunks = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, chunk_index long")
    state, kept, _ = M.retract(docs, chunks, chunks, docs.filter("doc_id = 1").select("doc_id"), "wrong", "now")
    assert ids(kept) == [2] and {r["doc_id"]: (r["lifecycle"], r["chunk_count"]) for r in state.collect()}[1] == ("retracted", 0)


def test_logs_get_ids_and_refuse_values(spark):
    log = spark.createDataFrame([(7, "ok")], "id long, status string")
    more = spark.createDataFrame([("bad",), ("ok",)], "status string")
    assert sorted((r["id"], r["status"]) for r in M.append_log(log, more.filter("status = 'ok'"), ["status"], {"status": ("ok",)}).collect()) == [(7, "ok"), (8, "ok")]
    with pytest.raises(Exception, match="unknown status"):
        M.append_log(log, more, ["status"], {"status": ("ok",)}).collect()


def test_manifest_and_retention(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, sha256 string")
    assert sorted(map(tuple, M.verify_manifest(a, b).collect())) == [("w", "unexpected"), ("y", "changed"), ("z", "missing")]
    assert [r["name"] for r in M.beyond_newest(spark.createDataFrame([("b1",), ("b3",), ("b2",)], "name string"), 2).collect()] == ["b1"]


def test_reports(spark, docs):
    assert {r["domain"]: r["n"] for r in R.chunks_by_domain(docs).collect()} == {"infra": 0, "manuals": 0, "notes": 4, "sdk-docs": 0}
    assert [r["doc_id"] for r in R.matching_documents(docs, "A/1").collect()] == [1]
    assert [r["doc_id"] for r in R.matching_documents(docs, "a%1").collect()] == []
    assert [r["doc_id"] for r in R.by_path_end(docs, "2.MD").collect()] == [2]
    with pytest.raises(Exception, match="unknown domain"):
        spark.range(1).select(R.tier_of(F.lit("nowhere"))).collect()
    quarantine = spark.createDataFrame([(1, "notes", "p", "a, b;;c", "why", "t", None), (2, "personal", "p", "a", "why", "t", None), (3, "notes", "p", None, "why", "t", "done")], "id long, domain string, origin_path string, rules string, reason string, detected_at string, resolved_at string")
    rows = R.open_quarantine(quarantine).collect()
    assert [(r["id"], r["rules"]) for r in rows] == [(1, ["a", "b", "c"])] and "reason" not in R.open_quarantine(quarantine).columns


def test_bm25_against_a_loop(spark):
    texts = {"a": "pump valve pump", "b": "valve hose", "c": "", "d": "pump, HOSE; pump valve valve valve", "e": None}
    items = spark.createDataFrame(list(texts.items()), "item_id string, text string").filter("text is not null")
    asked = spark.createDataFrame([(1, "pump hose"), (2, "?!"), (3, "valve valve"), (4, None)], "query_id long, text string")
    cut = {k: __import__("re").findall("[a-z0-9]+", t.lower()) for k, t in texts.items() if t is not None}
    average = sum(map(len, cut.values())) / len(cut)

    def score(q, k):
        total = 0.0
        for term in set(q):
            df, tf = sum(term in t for t in cut.values()), Counter(cut[k])[term]
            if tf:
                total += math.log((len(cut) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(cut[k]) / average))
        return round(total, 6)

    want = {(1, k): score(["pump", "hose"], k) for k in "abd"} | {(3, k): score(["valve"], k) for k in "abd"}
    assert {(r["query_id"], r["item_id"]): r["score"] for r in S.bm25(asked, items, 5).collect()} == want
    assert {(r["query_id"], r["item_id"]) for r in S.bm25(asked, items, 5, every_term=True).collect()} == {(1, "d"), (3, "a"), (3, "b"), (3, "d")}


def test_dense_ties_and_odd_vectors(spark):
    items = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0])], "item_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [3.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["item_id"], r["score"], r["rank"]) for r in S.dense_topk(asked, items, 3).orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.0, 3)]
    assert S.dense_topk(asked, items.limit(0), 3).count() == 0


def test_fusion(spark):
    hits = lambda *r: spark.createDataFrame([(1, i, s, n) for n, (i, s) in enumerate(r, 1)], "query_id long, item_id string, score double, rank long")
    fused = S.fuse(hits(("a", 0.9), ("b", 0.8)), hits(("b", 5.0), ("c", 4.0)), 2, 3).orderBy("rank").collect()
    assert [(r["item_id"], r["score"]) for r in fused] == [("b", round(1 / 3 + 1 / 2, 9)), ("a", 0.5), ("c", round(1 / 3, 9))]
    shown = S.shown_scores(S.fuse(hits(("a", 0.9)), hits(("c", 4.0)), 60, 3), hits(("a", 0.9)), hits(("c", 4.0)))
    assert {r["item_id"]: r["score"] for r in shown.collect()} == {"a": 0.9, "c": 4.0}


def test_context_and_answers(spark):
    chunks = spark.createDataFrame([(1, n, f"t{n}") for n in range(5)], "doc_id long, chunk_index long, text string")
    hits = spark.createDataFrame([(9, 1, 0), (9, 1, 4)], "query_id long, doc_id long, chunk_index long")
    assert sorted(r["chunk_index"] for r in S.with_context(hits, chunks, 1, 9).collect()) == [0, 1, 2, 3, 4]
    found = spark.createDataFrame([(1, 1, "u", "Other"), (1, 2, "u", "the “Answer”\nhere"), (2, 1, "v", "x")], "query_id long, rank long, uri string, text string")
    known = spark.createDataFrame([(1, "u", 'the "answer" here'), (2, "u", "x"), (3, "u", "x")], "query_id long, uri string, expect string")
    ranks = S.answer_ranks(found, known)
    assert {r["query_id"]: r["answer_rank"] for r in ranks.collect()} == {1: 2, 2: None, 3: None}
    assert tuple(S.score_answers(ranks).first()) == (3, 0.0, round(1 / 3, 6), round(0.5 / 3, 6))
