from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.llm.split import _TOKENS, spans, split_oversized

SCHEMA = "chunk_id string, doc_id long, chunk_index long, heading_path array<string>, text string, token_count long, piece string, first_char int"


def size(text):
    return len(_TOKENS.findall(text))


@given(st.text(alphabet="ab é.!\n\t|9", max_size=2000), st.integers(8, 60), st.integers(0, 7))
@settings(max_examples=150, deadline=None)
def test_pieces_are_under_the_limit_in_order_and_whole(text, limit, overlap):
    found = spans(text, limit, overlap)
    assert sum(1 for _ in found) == 1 or all(n <= limit for _, _, n in found)
    covered = set()
    for (a, z, n), nxt in zip(found, [*found[1:], None]):
        assert size(text[a:z]) == n
        covered |= set(range(a, z))
        if nxt:
            assert a < nxt[0] <= nxt[1] and size(text[nxt[0] : z]) <= overlap
    assert all(k in covered or text[k].isspace() for k in range(len(text)))


def test_overlaps_are_worth_having():
    text = "word " * 95 + "end. tail. " + "word " * 400  # a boundary right before the cut is none to start again from
    found = spans(text, 100, 20)
    assert all(10 <= size(text[b[0] : a[1]]) <= 20 for a, b in zip(found, found[1:]))


def test_cuts_at_natural_boundaries():
    text = "One two three. " * 40 + "\n\n" + "Four five six. " * 40
    ends = [text[:z].rstrip()[-1] for _, z, _ in spans(text, 100, 10)]
    assert set(ends) == {"."}
    assert [n for _, _, n in spans("x, " * 300, 100, 0)] == [100] * 6  # no boundary: hard cuts


def test_whole_table(spark):
    long = "Word word. " * 400
    rows = [("a", 1, 0, ["H"], long, 5), ("a", 1, 0, ["H"], long, 5), ("b", 1, 1, None, "short", None), ("c", 1, 2, [], long, 0), ("d", 2, None, None, long, 9), ("e", 2, 1, None, None, 1), ("f", 2, 2, None, "", 1), (None, None, 3, None, long, 1), ("g", 3, 5, None, "a" * 5000, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = split_oversized(df).collect()
    assert {r["chunk_id"] for r in got} == {"a", "c", "d", None} and all(r["token_count"] <= 480 and size(r["text"]) == r["token_count"] for r in got)
    first = sorted(r["chunk_index"] for r in got if r["doc_id"] == 1)
    per = len([r for r in got if r["chunk_id"] == "a"])
    assert first == [*range(per), *range(per + 1, 2 * per + 1)]  # b keeps a place between them
    assert all(r["heading_path"] == ["H"] for r in got if r["chunk_id"] == "a") and all(r["chunk_index"] is None for r in got if r["chunk_id"] == "d")
    assert split_oversized(df.limit(0)).count() == 0
