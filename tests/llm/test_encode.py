import os

import pytest
from pyspark.sql import functions as F

from fernglass.llm.encode import TOKENIZERS, decode_documents, encode_documents, word_pieces, words_of

TEXTS = ["plain words, twice: plain words", "", None, "  two  spaces \n\n\t tabs ", "über Straße naïve 日本語 🙂🙂 é", "<|endoftext|> is text", "I'll don't 'S 12345678901234567890", "x" * 30_000, "a\x00b\x1cc d　e", "plain words, twice: plain words", "\r\n mixed\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, 1, "x") for n, t in enumerate(TEXTS)] + [(None, "no id", 1, "x"), (3, TEXTS[3], 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, _block int, ids string")


def test_ids_are_the_tokenizers(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    for block in (6_000_000, 4000):
        got = [(r["doc_id"], list(r["ids"])) for r in encode_documents(docs, block_chars=block).collect()]
        assert sorted(g for g in got if g[0] is not None) == sorted([*enumerate(want), (3, want[3])])
        assert [g[1] for g in got if g[0] is None] == [t.encode("no id", add_special_tokens=False).ids]


def test_counts_and_round_trip(docs):
    for block in (6_000_000, 4000):
        counts = sorted(((r["doc_id"], r["n_tokens"]) for r in encode_documents(docs, counts_only=True, block_chars=block).collect()), key=str)
        ids = encode_documents(docs, block_chars=block)
        assert counts == sorted(((r["doc_id"], len(r["ids"])) for r in ids.collect()), key=str)
        back = sorted(((r["doc_id"], r["text"]) for r in decode_documents(ids).collect()), key=str)
        assert back == sorted([*((n, t or "") for n, t in enumerate(TEXTS)), (None, "no id"), (3, TEXTS[3])], key=str)
    assert [r["text"] for r in decode_documents(ids.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1)).collect()] == [""]


def test_pieces_are_cut_at_words(spark):
    text = "a long text " * 30 + "y" * 90 + "  two  gaps\n\n end"
    pieces = spark.createDataFrame([(text,)], "t string").select(word_pieces(F.col("t"), 40)).first()[0]
    assert "".join(pieces) == text and len(pieces) > 8 and sum(len(words_of(p)) for p in pieces) == len(words_of(text))


def test_empty_table(docs):
    assert encode_documents(docs.filter(F.lit(False))).count() == 0
    assert [list(r["ids"]) for r in encode_documents(docs.filter("text is null")).collect()] == [[]]
