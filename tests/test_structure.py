import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.functions import structure as S
from fernglass.operators import structure as O
from fernglass.sources import files as X
from fernglass.streaming import sync

PROSE = "The pump must be primed before it is started, or the seal runs dry. "


def size(text):
    return len(S.word_tokens(text))


def test_prose_is_cut_under_the_maximum():
    found = S.chunk_text(PROSE * 200)
    assert len(found) > 3 and all(p.tokens <= S.HARD_MAX and p.tokens == size(p.text) for p in found)
    assert all(p.text.endswith(".") for p in found) and S.chunk_text("  \n ") == [] and len(S.chunk_text(PROSE)) == 1


@given(st.text(alphabet="ab .\n|-", max_size=3000), st.integers(10, 60))
@settings(max_examples=60, deadline=None)
def test_pieces_cover_the_text(text, target):
    found = S.pieces(text, target, 4, target + 8, repeat_heads=False)
    covered = set()
    for a, z, body in found:
        assert body == text[a:z].strip() and size(body) <= target + 8
        covered |= set(range(a, z))
    assert all(k in covered or text[k].isspace() for k in range(len(text)))


def test_table_heads_are_repeated():
    table = "| Bolt | Size | Torque |\n|---|---|---|\n" + "".join(f"| part {n} | M{n} | {n * 3} Nm |\n" for n in range(52))
    found = S.pieces(table)
    assert len(found) > 1 and all(body.startswith("| Bolt | Size | Torque |\n|---|---|---|") for _, _, body in found)
    assert list(S.tables("a | b and then\nprose - not a table")) == [] and list(S.tables("|a|\nplain\n")) == [] and len(list(S.tables("|a|\n|--|\n"))) == 1


def test_markdown_sections_and_lines():
    text = "intro\n\n# A\n\n### C\n\nbody c\n\n## B\n\nbody b\n# Empty\n"
    assert [(p, b) for p, b, _ in S.sections(text)] == [((), "intro"), (("A", "C"), "body c"), (("A", "B"), "body b")]
    found = S.chunk_markdown(text)
    assert [(p.text, p.heading_path, p.lines) for p in found][1:] == [("A > C\n\nbody c", ("A", "C"), (7, 7)), ("A > B\n\nbody b", ("A", "B"), (11, 11))]


def test_blocks_are_packed_and_pages_gathered():
    found = S.chunk_blocks([S.Block("one. " * 20, page=11), S.Block("two. " * 20, page=12), S.Block(" "), S.Block(PROSE * 60, page=13)])
    assert found[0].pages == (11, 12) and all(p.tokens <= S.HARD_MAX for p in found) and found[-1].pages == (13,)
    titled = S.chunk_blocks([S.Block("Chapter", path=("Chapter",), opens=True), S.Block("Section\nbody " * 30, path=("Chapter", "Section"), opens=True), S.Block("Other " * 60, path=("Chapter", "Other"), opens=True)], root="Manual")
    assert [p.text.split("\n")[0] for p in titled] == ["Manual", "Manual > Chapter"] and "Section" in titled[0].text


def test_respacing_and_contents(spark):
    assert S.respaced("INJURYORDEATH. a\nMORE", "INJURY OR DEATH. OR") == "INJURY OR DEATH. a\nMORE"
    good = "\n".join(f"Part {n} ..... {n}" for n in range(1, 8))
    pages = [good, good.replace(".....", ". . . . ."), "\n".join(f"x {n}" for n in range(9)), good + "\nprose" * 9, good.replace("7", "99"), "\n".join(f"P ..... {9 - n}" for n in range(7)), "", None]
    rows = spark.createDataFrame([(n, t, 20) for n, t in enumerate(pages)], "id long, text string, page_count long")
    want = [n for n, t in enumerate(pages) if t and S.is_contents(t, 20)]
    assert sorted(r["id"] for r in O.contents_pages(rows).collect()) == want == [0, 1]


def test_headings_by_font():
    runs = [(p, 10, 20, f"Chapter {p}") for p in range(1, 13)] + [(p, 50, 16, w) for p in range(1, 13) for w in ("1.1.", "Section one")] + [(p, 90, 10, "body text " * 30) for p in range(1, 13)] + [(1, 5, 30, "Cover")]
    found = S.font_headings(sorted(runs))
    assert found[3] == [("Chapter 3", 1), ("1.1. Section one", 2)] and ("Cover", 1) not in found[1] and S.font_headings([]) == {}
    assert S.page_sections("rest\nBig\n  title\nbody\nBig", [("Big", 1), ("title", 1)], [(1, "Old"), (2, "Sub")]) == ([("rest", ("Old", "Sub"), False), ("Big\n  title\nbody\nBig", ("Big title",), True)], [(1, "Big title")])


def test_page_specs():
    assert S.page_numbers("3, 5-7") == ({3, 5, 6, 7}, False) and S.page_numbers("ALL") == (set(), True) and S.page_spec({7, 3, 5, 6}) == "3,5-7" and S.page_spec([], True) == "all"
    for wrong in ("", "0", "7-5", "x", "1-x", ","):
        with pytest.raises(ValueError):
            S.page_numbers(wrong)


@given(st.sets(st.integers(1, 60), min_size=1))
def test_page_specs_round_trip(pages):
    assert S.page_numbers(S.page_spec(pages)) == (pages, False)


def test_numbers_and_heading_lines(spark):
    assert S.unsupported_numbers("1,500 and 7 and 7 and 12.5", "1 500 or 125") == ["1,500", "7"]
    rows = spark.createDataFrame([("1,500 and 7 and 7 and 12.5", "1 500 or 125"), (None, "1"), ("", "")], "markdown string, layer string")
    assert [r["missing"] for r in O.unsupported_numbers(rows).collect()] == [["1,500", "7"], None, []]
    assert S.heading_lines("# A #\ntext\n## \n### B") == ("A\ntext\n## \nB", [("A", 1), ("B", 3)])


def test_similar_names(spark):
    rows = [("a/pump-manual-v1.pdf", "active"), ("a/pump-manual-v2.pdf", "active"), ("a/pump-manuals.pdf", "active"), ("b/pump-manual.pdf", "active"), ("a/statement-2026-03.pdf", "active"), ("a/statement-2026-04.pdf", "active"), ("a/hose.pdf", "active"), ("a/pump-manual-v3.pdf", "stale")]
    docs = spark.createDataFrame([("s", u, c) for u, c in rows], "source_id string, uri string, lifecycle string")
    assert sorted(map(tuple, O.similar_names(docs).collect())) == [("a/pump-manual-v1.pdf", "a/pump-manual-v2.pdf"), ("a/pump-manual-v1.pdf", "a/pump-manuals.pdf")]


def test_similar_names_against_all_pairs(spark):
    from difflib import SequenceMatcher
    from itertools import combinations
    from random import Random

    rng = Random(3)
    stems = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(3, 14))).strip() for _ in range(120)})
    docs = spark.createDataFrame([("s", f"x/{t.replace(' ', '-')}q.txt", "active") for t in stems if t], "source_id string, uri string, lifecycle string")
    from pyspark.sql import functions as F

    from fernglass.functions.text import normalised_stem

    names = [tuple(r) for r in docs.select("uri", normalised_stem(F.col("uri"))).distinct().collect()]
    first = {}
    for uri, stem in sorted(names):
        first.setdefault(stem, uri)
    want = {tuple(sorted((first[a[1]], b[0] if a[1] == b[1] else first[b[1]]))) for a, b in combinations(sorted(names), 2) if a[1] and b[1] and SequenceMatcher(None, *sorted((a[1], b[1]))).ratio() >= 0.85}
    assert {tuple(r) for r in O.similar_names(docs).collect()} == want


def test_manifest():
    good = {"id": "a", "type": "local", "domain": "notes", "path": "/x", "include": ["*.md"]}
    assert X.read_manifest([good])[0].tier == "open"
    for change in ({"type": "ftp"}, {"type": "git"}, {"domain": "x"}, {"path": ""}, {"id": ""}):
        with pytest.raises(X.SourceError):
            X.read_manifest([{**good, **change}])
    with pytest.raises(X.SourceError):
        X.read_manifest([good, good])


def test_files(spark, tmp_path):
    (tmp_path / "notes" / "sub").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for name, content in (("a.md", b"# Title #\nbody"), ("sub/b.txt", b"plain"), ("c.tmp", b"x"), (".hidden.md", b"x"), ("d.md", b"  \n"), ("e.txt", b"a\0b")):
        (tmp_path / "notes" / name).write_bytes(content)
    source = X.inbox_sources(str(tmp_path))[0]
    assert (source.id, source.domain) == ("inbox:notes", "notes")
    files, complete = X.scan_files(spark, source)
    got = {r["rel_uri"]: (r["title"], r["text"], r["status"], r["extractor"]) for r in X.extract_texts(files).collect()}
    assert complete and got == {"a.md": ("Title", "# Title #\nbody", "ok", "markdown"), "sub/b.txt": ("b", "plain", "ok", "text"), "d.md": ("d", None, "empty", "markdown"), "e.txt": ("e", None, "empty", "text")}
    gone, complete = X.scan_files(spark, X.Source("x", "local", "notes", str(tmp_path / "none")))
    assert not complete and gone.count() == 0


def test_transcripts(spark):
    records = [
        {"type": "user", "sessionId": "s1", "timestamp": "t1", "message": {"role": "user", "content": " hello "}},
        {"type": "system", "message": {"role": "system", "content": "noise"}},
        {"type": "ai-title", "aiTitle": "First"},
        {"type": "assistant", "timestamp": "t2", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_result", "is_error": True, "content": "boom"}, {"type": "tool_result", "content": "fine"}]}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "side"}},
        {"type": "ai-title", "aiTitle": "Last"},
    ]
    lines = [("p", n, json.dumps(r)) for n, r in enumerate(records)] + [("p", 90, '{"type": "user", "mess'), ("p", 91, "[]"), ("p", 92, None)]
    frame = spark.createDataFrame(lines, "path string, line long, value string")
    got = [(r["kind"], r["text"]) for r in X.transcript_blocks(frame).orderBy("line", "part").collect()]
    assert got == [("user", "user: hello"), ("assistant", "assistant: hi"), ("tool_use", "[Bash] ls"), ("tool_error", "error: boom")]
    assert any(r["kind"] == "thinking" for r in X.transcript_blocks(frame, thinking=True).collect())
    facts = X.transcript_facts(frame).first()
    assert (facts["title"], facts["session_id"], facts["first_ts"], facts["last_ts"]) == ("Last", "s1", "t1", "t2")


def test_approvals_by_table_and_stream_agree(spark, tmp_path):
    events = [("a", 0.0, "redeem"), ("a", 1.0, "request"), ("a", 2.0, "redeem"), ("a", 3.0, "approve"), ("a", 10.0, "redeem"), ("a", 11.0, "redeem"), ("b", 0.0, "request"), ("b", 121.0, "approve"), ("c", 0.0, "request"), ("c", 1.0, "approve"), ("c", 302.0, "redeem"), ("d", 0.0, "request"), ("d", 1.0, "request")]
    frame = spark.createDataFrame([(k, 1e9 + at, action) for k, at, action in events], "key string, at double, action string")
    want = sorted((r["key"], r["at"], r["decision"]) for r in sync.approvals_batch(frame).collect())
    assert [d for k, _, d in want if k == "a"] == ["refused", "pending", "refused", "approved", "allowed", "refused"]
    assert [d for k, _, d in want if k in "bcd"] == ["pending", "refused", "pending", "approved", "refused", "pending", "pending"]
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = sync.approvals(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["key"], r["at"], r["decision"]) for r in spark.table("decisions").collect()) == want


def test_sync_takes_each_file_once(spark, tmp_path):
    from fernglass.operators.incremental import VersionedTarget

    folder, target = str(tmp_path / "in"), VersionedTarget(spark, str(tmp_path / "out"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string").coalesce(1)
    take = lambda schema: sync.sync_folder(spark, folder, schema, target, lambda d: d, str(tmp_path / "cp"))
    first = rows((1, "a"), (2, "b"))
    first.write.parquet(folder)
    take(first.schema)
    rows((2, "B"), (3, "c")).write.mode("append").parquet(folder)
    take(first.schema)
    take(first.schema)
    assert sorted(map(tuple, target.read().collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_font_headings_and_heading_strip_over_frames(spark):
    from random import Random

    from pyspark.sql import functions as F

    rng = Random(4)
    runs = []
    for doc in range(6):
        pages = 4 if doc % 2 else 14
        for page in range(1, pages + 1):
            for k in range(8):
                size = rng.choice([10, 10, 10, 12, 14, 18, 24])
                runs.append((doc, page, k, 10 * (k // 2), size, rng.choice(["Heading text", "body " * 9, "12", " ", "A Title", "of it"])))
    frame = spark.createDataFrame(runs, "doc_id long, page long, number long, top long, size long, text string")
    got = {}
    for r in O.font_headings(frame).orderBy("doc_id", "page", "number").collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["page"], []).append((r["heading"], r["level"]))
    want = {d: found for d in range(6) if (found := S.font_headings([r[1:2] + r[3:] for r in runs if r[0] == d]))}
    assert got == want and want
    texts = ["# A #\ntext\n## \n### B", "", None, "no heads\n#tag", "####### seven"]
    rows = O.heading_strip(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [(r["plain"], [tuple(h) for h in r["headings"] or ()]) for r in rows if r["text"] is not None] == [S.heading_lines(t) if t else ("", []) for t in texts if t is not None]
    specs = ["3,5-7", " all ", "1, 1 ,2-2", "5-"]
    pages = [r[0] for r in spark.createDataFrame([(x,) for x in specs], "s string").select(O.page_set(F.col("s"))).collect()]
    assert pages == [None if S.page_numbers(x)[1] else sorted(S.page_numbers(x)[0]) for x in specs]
    for bad in ("0", "7-3", "x", ",", ""):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "s string").select(O.page_set(F.col("s"))).collect()


def test_only_names_with_common_letters_are_compared(spark, monkeypatch):
    from itertools import combinations
    from random import Random

    rng = Random(7)
    words = "pump valve seal motor hose fence garden kitchen callback handbook notes record summary".split()
    stems = sorted({f"{rng.choice(words)} {rng.choice(words)} {rng.randint(10_000, 10_400)}" for _ in range(300)} | {"x", "a" * 300, "a" * 290 + "b" * 10})
    want = {p for p in combinations(stems, 2) if O.SequenceMatcher(None, *p).ratio() >= 0.85}
    calls, ratio = [], O.SequenceMatcher.ratio
    monkeypatch.setattr(O.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    monkeypatch.setattr(O, "AT_ONCE", 5000)
    assert want and set(O.alike_stems(stems, stems, 0.85)) == want
    assert len(calls) < len(stems) * (len(stems) - 1) / 2 / 10
    even, odd = stems[::2], stems[1::2]
    assert {*O.alike_stems(even, even, 0.85), *O.alike_stems(odd, odd, 0.85), *O.alike_stems(even, odd, 0.85)} == want
    monkeypatch.setattr(O, "TILE", 40)
    docs = spark.createDataFrame([("s", f"f/{t.replace(' ', '-')}.txt", "active") for t in stems], "source_id string, uri string, lifecycle string")
    assert {tuple(x[2:-4].replace("-", " ") for x in r) for r in O.similar_names(docs).collect()} == want
