from fernglass.llm import scans
from fernglass.llm.scans import _rewrite, chosen_repairs, delete_keys, find_noise, header_key, reading_cost, repair_scans, shape

BODY = "the pump must be primed before it is started or the seal runs dry and the bearing is damaged by the control-panel heat".split()
CLEAN = " ".join(BODY) + ". "


def page(n, wrong=("", ""), cut=False, scan=True):
    text = CLEAN.replace(*wrong) if wrong[0] else CLEAN
    lines = [text[:58], text[58:]] if not cut else [text[:50] + "se-", "al " + text[58:]]
    lines = [text[:40].rsplit(" ", 1)[0], text[len(text[:40].rsplit(" ", 1)[0]) + 1 :]] if not cut else ["the pump must be primed before it is star-", "ted or the seal runs dry and the bearing is damaged by the control-", "panel heat."]
    return "\n".join([f"PUMP GUIDE    {n}", *lines, f"Page {n} of 9"]) if scan else "\n".join(lines)


def frames(spark):
    clean = [(f"c{n}", 100 + n, CLEAN * 3) for n in range(60)]
    scanned = [("s1", 1, page(1, ("before", "bcfore"))), ("s2", 1, page(2, cut=True)), ("s2", 1, page(2, cut=True)), ("s3", 1, page(3, ("damaged", "clamaged"))), ("e", 1, ""), (None, 1, page(4)), ("n", 1, None)]
    other = [("u1", 2, page(1, ("before", "bef0re"), cut=False) + "\n" + page(2, cut=True)), ("w", 3, page(1, scan=False)), ("r", 4, "Readings:\n94\n93\n12")]
    chunks = spark.createDataFrame([(*r, "x", "y") for r in clean + scanned + other], "chunk_id string, doc_id long, text string, noise string, n long".replace("n long", "n string"))
    documents = spark.createDataFrame([(1, "tesseract", 1), (2, None, 1), (3, "text", 1), (4, "text", 1)] + [(100 + n, "text", 1) for n in range(60)], "doc_id long, extractor string, text int")
    return chunks, documents


def test_shapes_and_costs():
    assert shape("modern") == shape("rnodern") == shape("modcrn") and set(delete_keys("pump")) == {shape("pump")} and len(delete_keys("pumped")) > 3
    assert reading_cost("bcfore", "before") == 0.3 and reading_cost("clamaged", "damaged") == 0.3 and reading_cost("w1fh", "with") == 0.6 and reading_cost("purnp", "pump") == 0.3
    assert reading_cost("pumps", "pump") > 1 and reading_cost("pimp", "pump") > 1 and reading_cost("same", "same") == 0
    assert header_key("PUMP GUIDE    12")[1] and header_key("PUMP GUIDE    12")[0] == header_key("Pump Guide")[0] and header_key("the wall.")[0] == "" and header_key("- Bolt")[0] == ""


def test_kinds_of_noise(spark):
    got = {}
    for r in find_noise(*frames(spark)).collect():
        got.setdefault(r["chunk_id"], set()).add(r["noise"])
    assert got == {"s1": {"misread", "header", "page_number"}, "s2": {"hyphen", "header", "page_number"}, "s3": {"misread", "header", "page_number"}, "u1": {"misread", "hyphen", "header", "page_number"}}


def test_repaired_text(spark):
    chunks, documents = frames(spark)
    got = {r["chunk_id"]: r["text"] for r in repair_scans(chunks, documents).collect()}
    assert got["s1"] == got["s2"] == got["s3"] == CLEAN.strip()
    assert find_noise(chunks.limit(0), documents).count() == 0


def test_rewriting_keeps_paragraphs_and_case():
    made = lambda **n: {"after": "", **n}
    noise = [made(noise="misread", piece="bcfore", repair="before"), made(noise="hyphen", piece="star-", repair="ted"), made(noise="page_number", piece="7", repair="")]
    assert _rewrite("Bcfore it is star-\n7\nted, (bcfore)\n\nnew control-\npanel", noise) == "Before it is started, (before)\n\nnew control-panel"
    assert _rewrite("BCFORE the\nlist\n- bcfore\n- two\n| a | b |\nend of\nit", noise) == "BEFORE the list\n\n- before\n- two\n| a | b |\n\nend of it"
    by_context = [made(noise="misread", piece="bcll", after="the", repair="bell"), made(noise="misread", piece="bcll", after="red", repair="ball")]
    assert _rewrite("the bcll and red bcll", by_context) == "the bell and red ball"


def test_the_word_before_decides_between_repairs_of_one_cost(spark):
    # "bcat" may be "beat" or, as c is read for e and h for b, stand beside "heat": both cost one confusion
    say = ["the strong beat of the music went on and on in the quiet room for hours", "the strong heat of the oven went on and on in the quiet room for hours"]
    clean = [(f"c{n}", 100 + n, f"{say[n % 2]}. the loud beat. a dry heat. ") for n in range(120)]
    page = lambda words: f"PUMP GUIDE    1\nthe music in this quiet room had some {words}\nand went on and on for hours\nPage 1 of 9"
    read = [("s1", 1, page("loud bcat of 1t")), ("s2", 1, page("dry bcat of 1t"))]
    chunks = spark.createDataFrame(clean + read, "chunk_id string, doc_id long, text string")
    repairs = spark.createDataFrame([("bcat", [(0.3, -10, "beat"), (0.3, -9, "heat")])], "read string, options array<struct<cost:double,rare:long,word:string>>")
    words = spark.createDataFrame([("s1", 1, "bcat", "loud"), ("s2", 1, "bcat", "dry"), ("s3", 1, "bcat", "")], "chunk_id string, doc_id long, a string, b string")
    got = {r["chunk_id"]: r["repair"] for r in chosen_repairs(words, repairs, chunks).collect()}
    assert got == {"s1": "beat", "s2": "heat", "s3": "beat"}


def test_known_words_make_no_difference(spark, monkeypatch):
    chunks, documents = frames(spark)
    rows = lambda: sorted(map(tuple, find_noise(chunks, documents).collect()), key=str)
    usual = rows()
    monkeypatch.setattr(scans, "KNOWN", 2)
    assert rows() == usual


def test_long_middles_cost_what_they_cost():
    assert reading_cost("abcdefghijklmnopqrstu" + "c", "abcdefghijklmnopqrstu" + "e") == 0.3
    assert reading_cost("rn" + "a" * 20 + "rn", "m" + "a" * 20 + "m") == 0.6
