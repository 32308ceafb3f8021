"""Operators that must do the whole job: no word, name or repair left out for its number or place."""

import numpy as np

from fernglass.llm import pii, scans


def test_everyday_words_beyond_the_broadcast(spark, monkeypatch):
    says = ["The pump was replaced by Mr Kaktup with few remarks.", "Ask Dr Gasket about the gasket and the flange.", "the gasket and the flange are new", "Signed by Leonard Tupgot, +1-437-555-0102, on the last page."]
    texts = spark.createDataFrame([("chunks", f"c{n}", f"{says[n % 4]} x{n}") for n in range(40)], "place string, row_key string, text string")
    found = lambda: sorted((r["row_key"], tuple(map(tuple, r["entities"]))) for r in pii.find_personal(texts).collect())
    want = found()
    monkeypatch.setattr(pii, "KNOWN", 2)
    assert want and found() == want and "c1" not in dict(want)


def test_skip_edges_of_many_names():
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefgh"), 8)) for _ in range(200)]
    tokens = [(t, 0, 0) for name in [*names, *(n[:3] + n[4:] for n in names), *(n[:4] + n[5] + n[4] + n[6:] for n in names)] for t in (name, "said")]
    edges = pii.skip_edges([(k, t) for k, (t, _, _) in enumerate(tokens) if t != "said"])

    last, want = {}, []
    for k, (low, _, _) in enumerate(tokens):
        if low != "said":
            other = last.get(low, next((i for t, i in last.items() if pii.one_edit(t, low)), None))
            if other is not None:
                want.append((other, k))
            last[low] = k
    assert edges == want and len(edges) >= 400


def test_field_is_fitted_to_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit_sample", lambda texts, rare, found, frequent: seen.extend((len(t), f) for t, f in zip(texts, found)))
    text = "word " * 6_000 + "Signed by Leonard Tupgot, on the last page."
    texts = spark.createDataFrame([("chunks", "a", text, None)], "place string, row_key string, text string, rare_words array<string>")
    pii.fit_field(texts, frozenset(["signed", "by", "on", "last", "page"]))
    assert [n for n, _ in seen] == [len(text)] and [k for _, f in seen for *_, k in f] == ["name"]


def test_word_before_chooses_among_all_repairs_of_least_cost(spark):
    words = ["eacccoc", "caeccoc", "cacecoc", "cacceoc", "cacccoe"]
    assert {scans.reading_cost("cacccoc", w) for w in words} == {0.3}
    # the last is the least frequent, and the only one that follows valve
    clean = [(f"{w}{n}", 1, f"look at {'valve' if w == words[4] else 'the'} {w} and the wall in each room of the house") for w in words for n in range(30 if w == words[4] else 60)]
    chunks = spark.createDataFrame([*clean, ("s", 2, "look at valve cacccoc and the wall\nin each room of the house")], "chunk_id string, doc_id long, text string")
    documents = spark.createDataFrame([(1, "text"), (2, "tesseract")], "doc_id long, extractor string")
    got = [(r["piece"], r["repair"]) for r in scans.find_noise(chunks, documents).filter("chunk_id = 's' and noise = 'misread'").collect()]
    assert got == [("cacccoc", "cacccoe")]
