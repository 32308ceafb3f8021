"""Access, bundles, pages, extractors, the API and the command line, on small tables."""

import base64
import hashlib
import hmac
import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglass import __main__ as cli
from fernglass.engine import Engine
from fernglass.operators import access as A
from fernglass.operators import bundles as B
from fernglass.operators import maintain as M
from fernglass.operators import search as S
from fernglass.sources import files as X
from fernglass.sources import pages as P

KEY = b"k" * 80  # longer than a block, so that it is digested first


def token(claims, key=KEY, alg="HS256"):
    cut = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=")
    body = cut(json.dumps({"alg": alg}).encode()) + b"." + cut(json.dumps(claims).encode())
    return (body + b"." + cut(hmac.new(key, body, hashlib.sha256).digest())).decode()


def test_signatures_are_those_of_the_library(spark):
    rows = spark.createDataFrame([("message",), ("",), ("é🙂" * 50,), (None,)], "m string")
    for key in (b"short", KEY, b"x" * 64):
        got = [r[0] for r in rows.select(F.hex(A.hmac_sha256(F.col("m"), key))).collect()]
        assert got == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest().upper() for m in ("message", "", "é🙂" * 50)] + [None]


def test_identities(spark):
    good = {"sub": "u", "iss": "chat", "exp": 200, "email": "Me@X.org ", "role": "user", "name": "N"}
    cases = [
        (token(good), None), (token({**good, "exp": 100}), "expired"), (token({**good, "iss": "x"}), "wrong issuer"), (token({k: v for k, v in good.items() if k != "exp"}), "claims missing"), (token({**good, "sub": ""}), "claims missing"),
        (token(good, b"other"), "not verified"), (token(good, alg="none"), "not verified"), ("a.b", "not verified"), ("a.!.c", "not verified"), ("", "no identity"), (None, "no identity"), (token({**good, "email": "z@x.org"}), "e-mail not permitted"), (token({**good, "role": "guest"}), "role not permitted"),
    ]
    frame = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, assertion string")
    rows = A.with_identity(frame, KEY, "chat", ["me@x.org"], ["user"], 150).orderBy("n").collect()
    assert [r["refusal"] for r in rows] == [w for _, w in cases] and rows[0]["principal"] == "me@x.org (N, user)" and rows[1]["principal"] is None
    assert A.with_identity(frame.filter("n = 0"), KEY, "chat", [], ["user"], 150).first()["refusal"] == "e-mail not permitted"  # an empty list admits nobody
    assert A.with_identity(frame.limit(0), KEY, "chat", ["a"], ["b"], 1).count() == 0


def test_gates(spark):
    who = token({"sub": "u", "iss": "chat", "exp": 9e9, "email": "a@b", "role": "r"})
    requests = spark.createDataFrame([("t", "h1", "http", who, 1), ("t", "h2", "http", who, 1), ("t", "h3", "cli", None, 1), ("t", "h1", "http", None, 1)], "tool string, query_hash string, transport string, assertion string, decisions int")
    grants = spark.createDataFrame([("u", "h1", 900.0), ("u", "h2", 1.0), ("u", "h1", 950.0)], "subject string, query_hash string, approved_at double")
    run = lambda unlocked: sorted(((r["query_hash"], r["transport"], r["decision"], r["reason"]) for r in A.gated(requests, grants, unlocked=unlocked, key=KEY, issuer="chat", emails=["a@b"], roles=["r"], now=1000.0).collect()), key=str)
    assert run(True) == sorted([("h1", "http", "allowed", None), ("h2", "http", "pending", "awaiting approval"), ("h3", "cli", "allowed", None), ("h1", "http", "denied", "identity: no identity")], key=str)
    assert {r[2:] for r in run(False)} == {("denied", "sealed")}


def test_what_cannot_be_stored_is_in_the_journal(spark, caplog):
    entries = spark.createDataFrame([("t", "denied", "sealed"), ("t", "denied", "sealed"), ("u", "allowed", None)], "tool string, decision string, reason string")
    kept = []
    assert A.recorded(entries, kept.append, logging.getLogger("audit")) and len(kept) == 1 and not caplog.records

    def fails(_):
        raise OSError("sealed")

    assert not A.recorded(entries, fails, logging.getLogger("audit"))
    assert [r.getMessage() for r in caplog.records] == ["not stored (OSError): t denied sealed, 2 times", "not stored (OSError): u allowed None, 1 times"]


def test_clients_and_tenants(spark):
    tokens = A.client_tokens(f" a:{'x' * 32}, b_1:{'y' * 40},")
    assert tokens == {"a": "x" * 32, "b_1": "y" * 40}
    for wrong in ("a", ":x", f"A:{'x' * 32}", "a:short", f"a:{'x' * 32},a:{'z' * 32}", f"a:{'x' * 32},b:{'x' * 32}"):
        with pytest.raises(A.AccessError):
            A.client_tokens(wrong)
    heads = [f"Bearer {'x' * 32}", f"bearer  {'y' * 40} ", "Bearer no", "Basic " + "x" * 32, "", None]
    frame = spark.createDataFrame([(n, h) for n, h in enumerate(heads)], "n int, h string")
    assert [r[0] for r in frame.orderBy("n").select(A.client_of(F.col("h"), tokens)).collect()] == ["a", "b_1", None, None, None, None]
    registry = spark.createDataFrame([("one", 5, "t")], "tenant string, generation long, created_at string")
    two = A.tenants_with(registry, "two", 10, "u", ["base"])
    for wrong in ("one", "base", "Two", "a__b", "x"):
        with pytest.raises(A.AccessError):
            A.tenants_with(registry, wrong, 10, "u", ["base"])
    assert {r["tenant"]: r["generation"] for r in A.revoked(two, "one", 3).collect()} == {"one": 6, "two": 10}
    made = A.tenant_token("one", 6, b"key", 100, 2)
    frame = spark.createDataFrame([(made,), ("plain",)], "t string")
    assert [(r[0], r[1]) for r in frame.select(F.get_json_object(A.claims_of(F.col("t")), "$.exp"), A.is_scoped(F.col("t"))).collect()] == [(str(100 + 172_800), True), (None, False)]
    with pytest.raises(A.AccessError):
        A.tenant_token("one", 6, b"key", 100, 731)


def test_keys_are_held_for_a_while():
    holder = A.KeyHolder(ttl=0.0)
    assert holder.key() is None
    holder.unlock(b"secret")
    assert holder.key() is None  # its time is over
    holder = A.KeyHolder()
    holder.unlock(b"secret")
    assert holder.key() == b"secret"
    holder.lock()
    key, salt, verifier = A.derive_key("words")
    assert holder.key() is None and A.derive_key("words", salt) == (key, salt, verifier) and A.derive_key("other", salt)[2] != verifier


def test_bundles(spark, tmp_path):
    tables = {"a": spark.range(10).withColumn("m", F.create_map(F.lit("k"), "id")), "b": spark.createDataFrame([(1, None)], "x int, y string"), "c": spark.range(0)}
    for name in ("2026-01", "2026-02", "2026-03"):
        B.write_bundle(tables, str(tmp_path), name)
    assert B.bundle_problems(spark, str(tmp_path), "2026-01") == [] and B.restored(spark, str(tmp_path), "2026-01")["a"].count() == 10
    spark.range(10, 20).withColumn("m", F.create_map(F.lit("k"), "id")).write.mode("overwrite").parquet(str(tmp_path / "2026-01" / "a"))
    spark.range(1).write.parquet(str(tmp_path / "2026-01" / "z"))
    assert B.bundle_problems(spark, str(tmp_path), "2026-01") == ["z: unexpected", "a: changed"]
    with pytest.raises(B.BundleError):
        B.restored(spark, str(tmp_path), "2026-01")
    spark.range(1).write.parquet(str(tmp_path / "2026-00" / "half"))
    assert B.prune_bundles(spark, str(tmp_path), 2) == ["2026-01"] and B.bundle_problems(spark, str(tmp_path), "2026-00") == ["no manifest"]
    with pytest.raises(ValueError):
        B.prune_bundles(spark, str(tmp_path), 0)


def test_vectors_extra_and_settings(spark):
    rows = spark.createDataFrame([(1, [0.5, -2.0]), (2, None), (3, [])], "id int, vector array<float>")
    packed = M.packed_vectors(rows)
    assert [None if r["vector"] is None else len(r["vector"]) for r in packed.orderBy("id").collect()] == [8, None, 0]
    assert [r["vector"] for r in M.unpacked_vectors(packed).orderBy("id").collect()] == [[0.5, -2.0], None, []]
    extra = M.with_extra(spark.createDataFrame([(1, "x", None, 7)], "id int, a string, b string, extra int"), ["id"])
    assert extra.columns == ["id", "extra"] and [tuple(r) for r in extra.select(M.extra_field(F.col("extra"), "a"), M.extra_field(F.col("extra"), "b"), M.extra_field(F.col("extra"), "extra", "int"), M.extra_field(F.col("extra"), "a", "int")).collect()] == [("x", None, 7, None)]
    mark = M.fingerprint({"model": "m", "dimension": 64})
    assert M.collection_for(None, {}) == "create" and M.collection_for(mark, {"dimension": 64, "model": "m"}) == "keep" and M.collection_for(mark, {}, recreate=True) == "recreate"
    with pytest.raises(ValueError):
        M.collection_for(mark, {})
    assert M.migrated(rows, {"tier": ("string", "open"), "id": ("string", "z")}).first()["tier"] == "open"


def test_dense_hits_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(S, "BLOCK", 7)
    items = [(n, rng.normal(size=8).tolist() if n % 9 else None, n % 3) for n in range(300)] + [(300, [float("nan")] * 8, 0), (301, [0.0] * 8, 0), (302, [1.0] * 5, 0)]
    queries = [(n, rng.normal(size=8).tolist(), n % 3) for n in range(20)] + [(20, None, 0), (21, [1.0] * 5, 0)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, vector array<double>, label int")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)

    def best(q, same):
        scored = sorted((-round(float(unit(v) @ unit(q[1])), 6), i) for i, v, label in items if v and len(v) == len(q[1]) and not np.isnan(v).any() and (not same or label == q[2]))
        return [(q[0], i, r + 1) for r, (_, i) in enumerate(scored[:5])]

    for partition in ([], ["label"]):
        got = sorted((r["query_id"], r["item_id"], r["rank"]) for r in S.dense_topk(frame(queries, "query_id"), frame(items, "item_id"), 5, partition).collect())
        assert got == sorted(x for q in queries if q[1] for x in best(q, bool(partition)))
    assert S.dense_topk(frame(queries, "query_id").limit(0), frame(items, "item_id")).count() == 0 and S.dense_topk(frame(queries, "query_id"), frame(items, "item_id").limit(0)).count() == 0


def knowledge(spark, folder):
    docs = [(1, "manuals", "open", "active", "a/pump.md", None, "2026-01-02T00:00:00Z", "s"), (2, "manuals", "open", "stale", "a/old.md", "too old", "2026-01-02T00:00:00Z", "s"), (3, "notes", "open", "superseded", "n.md", None, None, "s"), (4, "manuals", "open", "retracted", "gone.md", None, None, "s"), (5, "receipts", "vault", "active", "r.pdf", None, None, "t")]
    spark.createDataFrame(docs, "doc_id long, domain string, tier string, lifecycle string, uri string, status_detail string, indexed_at string, source_id string").withColumns({"title": F.col("uri"), "status": F.lit("indexed"), "chunk_count": F.lit(2).cast("long"), "review_after": F.lit("2026-01-01"), "content_hash": F.lit("h")}).write.parquet(f"{folder}/documents.parquet")
    texts = ["prime the pump before the start", "the seal of the pump runs dry", "old pump rules", "other words", "gone pump", "pump invoice total"]
    chunks = [(f"c{n}", d, k, t, [float(n == j) for j in range(6)], '{"lines":[1,2]}', "x") for n, (d, k, t) in enumerate(zip([1, 1, 2, 3, 4, 5], [0, 1, 0, 0, 0, 0], texts))]
    spark.createDataFrame(chunks + chunks[:1], "chunk_id string, doc_id long, chunk_index long, text string, vector array<float>, locator string, domain string").write.parquet(f"{folder}/chunks.parquet")
    ledger = [(1, 5, "2026-01-03", "Shop", 100, "other", None, "USD", 0), (2, 5, "2026-02-03", "Other", 50, "other", None, "USD", 1)]
    spark.createDataFrame(ledger, "id long, doc_id long, txn_date string, merchant string, amount_cents long, category string, payment_method string, currency string, needs_review int").write.parquet(f"{folder}/ledger.parquet")
    spark.createDataFrame([], "run_id string, doc_id long, content_hash string, outcome string, recorded_at timestamp").write.parquet(f"{folder}/doc_log.parquet")
    spark.createDataFrame([], "run_id string, finished_at string, status string").write.parquet(f"{folder}/runs.parquet")
    return folder


def test_engine(spark, tmp_path, capsys, monkeypatch):
    engine = Engine(spark, knowledge(spark, str(tmp_path)))
    ids = lambda rows: sorted(r["chunk_id"] for r in rows.collect())
    assert ids(engine.visible("open")) == ["c0", "c1"] and ids(engine.visible("open", stale=True)) == ["c0", "c1", "c2"] and ids(engine.visible("open", superseded=True)) == ["c0", "c1", "c3"] and ids(engine.visible("vault")) == ["c5"]
    assert engine.visible("open", stale=True).filter("chunk_id = 'c2'").first()["text"] == "[STALE since 2026-01-02: too old]\nold pump rules"
    for wrong in (["receipts"], ["nowhere"]):
        with pytest.raises(ValueError):
            engine.visible("open", wrong)
    question = spark.createDataFrame([(1, "seal of the pump", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "query_id long, text string, vector array<float>")
    hits = engine.search(question, 3)
    assert [(r["item_id"], r["rank"]) for r in hits.orderBy("rank").collect()] == [("c0", 1), ("c1", 2)]  # equal sums go by the rank among vectors
    assert [r["item_id"] for r in engine.search(question, 3, "vault").collect()] == ["c5"]
    around = engine.context(hits.filter("item_id = 'c0'").select("query_id", "doc_id", "chunk_index"), 1, 1)
    assert sorted(r["chunk_index"] for r in around.collect()) == [0, 1]
    assert engine.pending_review("2026-06-01").filter("lifecycle = 'stale'").count() == 3
    assert {r["status"]: r["n"] for r in engine.report("overview").collect()} == {"indexed": 4} and [r["doc_id"] for r in engine.report("lifecycle").collect()] == [4, 2, 3]
    with pytest.raises(ValueError):
        engine.report("nothing")
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    say = lambda *argv: (cli.main([str(tmp_path), *argv]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert say("list", "--match", "PUMP") == (0, [{"doc_id": 1, "domain": "manuals", "uri": "a/pump.md", "title": "a/pump.md", "status": "indexed", "lifecycle": "active", "chunk_count": 2}])
    assert say("ledger", "--by", "month")[1][-1] == {"count": 2, "total_cents": 150, "needs_review_count": 1}
    assert say("search", "seal", "--words")[1][0]["uri"] == "a/pump.md" and say("search", "pump", "--domain", "receipts")[0] == 2
    assert [r["doc_id"] for r in say("pending")[1]] == [1, 2, 3, 5]


def test_pages_and_receipts(spark):
    layer = [(1, 1, "Pumpsand seals " + "text " * 30, "Pumps and seals " + "text " * 30), (1, 2, "\n".join(f"Chapter {n} ..... {n}" for n in range(1, 3)) + "\n" + "\n".join(f"Part {n} ..... {n % 3 + 1}" for n in range(0)), ""), (1, 3, "", None), (2, 1, "", None), (3, 1, "short", "short")]
    pages = spark.createDataFrame(layer, "doc_id long, page long, raw string, reading string")
    readings = spark.createDataFrame([(1, 3, "# Read head\nbody of it", "ok"), (2, 1, "x", "rejected")], "doc_id long, page long, markdown string, status string")
    runs = spark.createDataFrame([], "doc_id long, page long, number long, top long, size long, text string")
    assert {r["doc_id"]: (r["status"], r["flagged_pages"]) for r in P.page_status(pages, readings).collect()} == {1: ("ok", 1), 2: ("empty", 1), 3: ("ocr_required", 1)}
    blocks = {(r["doc_id"], r["page"]): (r["text"][:15], r["heading_path"]) for r in P.page_blocks(pages, runs, readings).collect()}
    assert blocks[1, 1] == ("Pumps and seals", []) and blocks[1, 3] == ("Read head\nbody ", ["Read head"]) and blocks[3, 1][0] == "short"
    files = spark.createDataFrame([(1, 1.76e9), (2, 1.76e9)], "doc_id long, mtime double")
    read = spark.createDataFrame([(1, '{"merchant":"Shop","total":"$1.00","date":"2026-01-02"}')], "doc_id long, reading string")
    documents, ledger = P.receipts(files, read, F.lit("2026-12-31").cast("date"))
    assert {r["doc_id"]: (r["status"], r["text"]) for r in documents.collect()} == {1: ("ok", "Shop\nDate: 2026-01-02\nTotal: $1.00"), 2: ("empty", None)}
    assert [(r["doc_id"], r["amount_cents"], r["txn_date"]) for r in ledger.collect()] == [(1, 100, "2026-01-02")]
    good = spark.createDataFrame([("q", "what", "a.md", "text")], "id string, question string, uri string, expect string")
    assert P.test_set(good).count() == 1
    with pytest.raises(Exception):
        P.test_set(good.withColumn("expect", F.lit(" "))).collect()


def test_extractors_by_suffix(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    turn = lambda role, text: json.dumps({"type": role, "message": {"role": role, "content": text}})
    (tmp_path / "notes" / "t.jsonl").write_text("\n".join([turn("user", "hello"), json.dumps({"type": "ai-title", "aiTitle": "A talk"}), turn("assistant", "hi")]))
    (tmp_path / "notes" / "a b.md").write_text("# T\nx")
    (tmp_path / "notes" / "x.bin").write_bytes(b"123")
    (tmp_path / "notes" / "skip.md").write_text("no")
    files, _ = X.scan_files(spark, X.Source("s", "local", "notes", str(tmp_path / "notes"), exclude=("skip*",)))
    got = {r["rel_uri"]: (r["title"], r["text"], r["extractor"]) for r in X.extract(files).collect()}
    assert got == {"t.jsonl": ("A talk", "user: hello\n\nassistant: hi", "cc-transcript"), "a b.md": ("T", "# T\nx", "markdown")}
