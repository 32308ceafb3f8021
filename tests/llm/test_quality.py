import pytest
from pyspark.sql import functions as F

from fernglass.llm.quality import _in_parts, text_statistics

PROSE = "It is better to check the pump twice than to restart it at once. The reason for this is simple."
CASES = {
    "prose": [PROSE, "user: can you look at it?\n\nassistant: yes, I will do that now.", "the pump was replaced because\nit was worn and nobody had\nchecked it since the last year", "Der Filter wurde gestern ersetzt, weil es Probleme gab.", "Ok.", "Ceci est la dernière page du contrat.\nIl faut la signer."],
    "list": ["- bolt\n- nut, 3 mm\n- washer\n- spring", "1) filter\n2) hose / pipe\n3) valve", "bolt\nnut\nwasher\nlock ring, 7 mm", "[x] check hose\n[ ] replace pump"],
    "table": ["| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |", "name\tsize\tprice\nbolt\t3 mm\t4.10\nnut\t\t2.20", "BOLT        2     4.10\nNUT         1     0.20\nTOTAL             4.30", 'bolt,3,"25 mm"\nnut,n/a,4\nring,spare,5'],
    "junk": ["00000000  a9 ee ec fe 3c d3 8e 42 c9 e5\n00000010  7e 40 9e f6 43 98 83 7a 74 c8", "=====================\n*********************", "Menu | Next | Home | Search | Login | Menu | Top", "auie9oIt1BeqwHNGDliUECUF6x3RcnUkoEUqsLzP21VoQN1M18bk1H5INOebMAJ9", "sraopre krke ws hjteozwr tftsizoe igsrg kagiuoeurq kpiwktek", "5.840,3.982,7.544,0.224,1.864,3.130,5.686"],
}


def run(spark, texts, **how):
    rows = [(n, t, "x", 1) for n, t in enumerate(texts)]
    return {r["doc_id"]: r for r in text_statistics(spark.createDataFrame(rows, "doc_id long, text string, form string, words int"), **how).collect()}


def test_forms(spark):
    every = [(f, t) for f, ts in CASES.items() for t in ts]
    got = run(spark, [t for _, t in every])
    assert [(every[n][0], got[n]["form"], every[n][1][:30]) for n in got if got[n]["form"] != every[n][0]] == []


def test_statistics(spark):
    got = run(spark, ["The pump is on.\nBig dog\n\n- a1!", None, "", " \n ", "?!"])
    r = got[0]
    assert sorted(got) == [0, 4]
    assert (r["word_count"], r["mean_word_length"], r["symbol_ratio"], r["ended_line_share"], r["common_word_share"]) == (7, 19 / 7, 3 / 22, 2 / 3, 3 / 7)
    assert (got[4]["word_count"], got[4]["mean_word_length"], got[4]["symbol_ratio"]) == (0, 0.0, 1.0)


@pytest.mark.parametrize("part", [30, 40, 64, 100])
def test_parts_make_no_difference(spark, part):
    texts = ["\n".join([PROSE] * 9), "- bolt\n- nut, 3 mm\n" * 20, "no line break at all " * 9, "a\n\n\nb\n", "| a | b |\n" * 9 + PROSE, "- " + PROSE * 4 + "\n- b", "5.840 3.982 7.544 0.224 " * 20, "bolt\n\n" * 40, PROSE + " " * 300 + PROSE]
    whole, cut = run(spark, texts), run(spark, texts, part=part)
    assert {k: tuple(v) for k, v in whole.items()} == {k: tuple(v) for k, v in cut.items()}


def test_a_huge_line_is_many_parts(spark):
    rows = spark.createDataFrame([(1, PROSE * 3000), (2, "x" * 200_000)], "doc_id long, text string")
    large = rows.select("doc_id", F.col("text").alias("_text"), F.xxhash64("text").alias("_key"))
    parts = _in_parts(large, 65_536)
    assert parts.count() >= 8 and parts.agg(F.sum(F.length("_text"))).first()[0] == len(PROSE) * 3000 + 200_000
    assert parts.agg(F.max(F.length("_text"))).first()[0] <= 65_536
    got = {r["doc_id"]: r for r in text_statistics(rows).collect()}
    assert got[1]["form"] == "prose" and got[1]["word_count"] == len((PROSE * 3000).split()) and got[2]["form"] in ("junk", "list")


def test_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE), (2, "- a\n- b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["form"]) for r in text_statistics(rows).collect()) == [(0, "prose"), (1, "prose"), (2, "list")]
    assert text_statistics(rows.limit(0)).count() == 0
