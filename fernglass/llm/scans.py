"""Repair of text read from scanned pages: words cut over line ends, misread characters, running headers and page numbers.

A frequency lexicon is counted over the whole corpus. Words of wrapped text that the lexicon hardly has are joined with it through
a symmetric-delete index over shapes, in which characters that readers confuse are one. A weighted edit distance with confusion
pairs finds the repairs that cost least, and counts of the word with the word before it over the corpus pick one."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: What is read, and what is printed; each stands for a slip of the reader.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("€", "e"), ("f", "t"), ("t", "f"), ("0", "o"), ("o", "0"), ("5", "s"), ("$", "s"), ("1", "i"), ("1", "l"), ("i", "l"), ("l", "i"), ("|", "l"), ("|", "i"),
    ("!", "l"), ("!", "i"), ("@", "a"), ("b", "h"), ("h", "b"), ("6", "b"), ("8", "b"), ("¢", "c"), ("9", "g"), ("q", "g"), ("2", "z"), ("7", "t"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"),
    ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("iii", "m"), ("nn", "m"), ("£", "e"),
)
#: Marks that cut a word at a line end.
CUT_MARKS = "-­‐‑¬"
#: Cost of a confusion and of any other edit, and the most a repair may cost.
CONFUSED, OTHER, MOST = 0.3, 1.1, 0.95
#: Least count of a word to repair to, and how many times more frequent than the word read it must be.
LEAST, TIMES = 4, 20
#: Frequent words that are known without a join, a bound on what is sent to every task; all other words are joined, to the same end.
KNOWN = 40_000
#: Letters beyond which a run of them is no word: it has no repair.
WORD_LETTERS = 64
#: Word pairs that a task gathers before it states their counts.
PAIRS_AT_ONCE = 2_000_000

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_STRIP = ".,;:?()[]{}<>\"“”„«»‘’'…*_#=+~–—"
#: After single characters are made one, so that a slip in a pair does not hide it; "cl" is then "ei".
_SHAPE_PAIRS = (("rn", "m"), ("ei", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"))
_SHAPE = str.maketrans({"c": "e", "€": "e", "£": "e", "¢": "e", "f": "t", "7": "t", "0": "o", "5": "s", "$": "s", "1": "i", "|": "i", "!": "i", "l": "i", "@": "a", "b": "h", "6": "h", "8": "h", "9": "g", "q": "g", "2": "z"})
_PAGE_WORD = r"(?:page|pag|pg|p|seite|s|página|pagina|pág|blz|bladzijde)"
_NUMBER = r"(?:\d{1,4}|[0-9lIoO|]{1,3}|[ivxlIVXL]{1,7})"
_PAGE = re.compile(rf"^[\s\-–—~\[\](){{}}|*•.·<>=]*(?:{_PAGE_WORD}\b\.?\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur|van|out of)\s*{_NUMBER})?[\s\-–—~\[\](){{}}|*•.·<>=]*$", re.I)
_HEAD_NUMBER = re.compile(rf"^\s*[\-–—~\[(|]*\s*(?:{_PAGE_WORD}\b\.?\s*)?(\d{{1,4}}|[ivxl]{{1,6}})\s*[\-–—~\])|]*(?:\s{{2,}}|\t|\s*[|·•]\s*)|(?:\s{{2,}}|\t|\s*[|·•]\s*)(?:{_PAGE_WORD}\b\.?\s*)?[\-–—~\[(]*\s*(\d{{1,4}}|[ivxl]{{1,6}})\s*[\-–—~\])]*\s*$", re.I)
#: A line of some length that ends within a sentence, before a line of text; tried at line starts only, or a long line would be scanned from each of its characters.
_WRAPPED = r"(?m)^[^\n|]{25,}(?<![.!?:])\n ?[^\s|#*>\-]"


def shape(word: str) -> str:
    """A word with characters that are confused made one."""
    word = word.translate(_SHAPE)
    for pair, one in _SHAPE_PAIRS:
        word = word.replace(pair, one)
    return word


def delete_keys(word: str) -> list[str]:
    """The shape and all shapes less one character: two words share a key if their shapes are within one deletion on each side."""
    s = shape(word)
    return sorted({s, *(s[:i] + s[i + 1 :] for i in range(len(s)) if len(s) > 4)})


_BY_READ: dict[str, list[str]] = {}
for _read, _printed in CONFUSIONS:
    _BY_READ.setdefault(_read, []).append(_printed)


@lru_cache(maxsize=100_000)
def reading_cost(read: str, word: str) -> float:
    """The weighted edit distance from what is read to what is printed; more than ``MOST`` where their differing middles are long."""
    a = 0
    while a < min(len(read), len(word)) and read[a] == word[a]:
        a += 1
    z = 0
    while z < min(len(read), len(word)) - a and read[-1 - z] == word[-1 - z]:
        z += 1
    read, word = read[a : len(read) - z], word[a : len(word) - z]
    n, m = len(read), len(word)
    if abs(n - m) > 2 * MOST / CONFUSED:  # a confusion changes the length by two at most
        return 9.0
    cost = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost.get((i, j), 9.0)
            if c > MOST:
                continue
            steps = [(i + 1, j + 1, 0.0 if read[i] == word[j] else OTHER)] if i < n and j < m else []
            steps += [(i + k, j + len(p), CONFUSED) for k in (1, 2, 3) if i + k <= n for p in _BY_READ.get(read[i : i + k], ()) if word.startswith(p, j)]
            steps += [(i + 1, j, OTHER), (i, j + 1, OTHER)]
            for x, y, more in steps:
                if c + more < cost.get((x, y), 9.0):
                    cost[x, y] = c + more
    return cost.get((n, m), 9.0)


@lru_cache(maxsize=500_000)
def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def pair_code(first: str, second: str) -> int:
    return _code(first) - (1 << 31) << 32 | _code(second)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts in all and in unwrapped texts."""
    every, clean = Counter(), Counter()

    def stated() -> pa.RecordBatch:
        words = [w for w in every if len(w) <= WORD_LETTERS]
        return pa.record_batch([pa.array(words, pa.string()), pa.array([every[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["word", "n", "n_clean"])

    for batch in batches:
        for text, wrapped in zip(batch.column("text").to_pylist(), batch.column("_wrapped").to_pylist()):
            words = _WORD.findall(text.lower())
            words += [part for w in words if "-" in w for part in w.split("-")]
            every.update(words)
            if not wrapped:
                clean.update(words)
        if len(every) > PAIRS_AT_ONCE:
            yield stated()
            every.clear()
            clean.clear()
    yield stated()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of neighbouring words of a partition with their counts."""
    codes, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([codes, *waiting])
        order = np.argsort(own, kind="stable")
        weight = np.concatenate([counts, np.ones(len(own) - len(codes), np.int64)])[order]
        found, at = np.unique(own[order], return_index=True)
        return found, np.add.reduceat(weight, at) if len(at) else weight

    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = np.fromiter(map(_code, _WORD.findall(text.lower())), np.int64)
            waiting.append((words[:-1] - (1 << 31) << 32) | words[1:])
            held += len(waiting[-1])
        if held > PAIRS_AT_ONCE:
            codes, counts = gathered()
            waiting, held = [], 0
            if len(codes) > PAIRS_AT_ONCE:
                yield pa.record_batch([pa.array(codes), pa.array(counts)], ["code", "n"])
                codes, counts = codes[:0], counts[:0]
    codes, counts = gathered()
    yield pa.record_batch([pa.array(codes), pa.array(counts)], ["code", "n"])


def header_key(line: str) -> tuple[str, bool]:
    """``(key, has a number)`` of a line that could be a running header; the key is '' if it could not."""
    text = line.strip()
    bare = _HEAD_NUMBER.sub("", text).strip()
    numbered = bare != text
    if not 3 <= len(bare) <= 70 or bare[-1] in ".,;:!?" + CUT_MARKS or " | " in bare or bare[0] == "|" or " > " in bare or bare[0] in "-*•#>[(\"'" or "\t" in bare or re.search(r"\S {2,}\S", bare):
        return "", False
    words = re.findall(r"[^\W\d_][\w'’\-]*", bare)
    if not words or len(words) > 9 or sum(w[0].isupper() for w in words) < 0.75 * len(words):
        return "", False
    return re.sub(r"\W+", " ", shape(bare.lower())).strip(), numbered


def _items(known: frozenset[str], contexts: bool):
    """What may be noise in a text: ``(chunk_id, doc_id, kind, a, b)``; kinds are word, cut, page and head. A word is stated once, or with ``contexts`` once after each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, doc, text, wrapped in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "doc_id", "text", "_wrapped"))):
                lines = text.split("\n")
                solid = [k for k, line in enumerate(lines) if line.strip()]
                pages = [k for k in solid if _PAGE.match(lines[k]) and len(lines[k].strip()) <= 24]
                taken = set()
                order = {k: i for i, k in enumerate(solid)}
                for k in pages:
                    i = order[k]
                    near = [solid[j] for j in (i - 1, i + 1) if 0 <= j < len(solid)]
                    if not any(n in pages for n in near) and (len(solid) == 1 or not any(lines[n].rstrip().endswith(":") for n in near[:1] if n < k)):
                        taken.add(k)
                        out.append((chunk, doc, "page", lines[k].strip(), "", ""))
                for k in solid:
                    if k not in taken:
                        key, numbered = header_key(lines[k])
                        if key:
                            out.append((chunk, doc, "head", key, "n" if numbered else "", lines[k].strip()))
                if not wrapped:
                    continue
                for k, nxt in zip(solid, solid[1:]):
                    if k in taken or "|" in lines[k][:2]:
                        continue
                    line = lines[k].rstrip()
                    if len(line) > 3 and line[-1] in CUT_MARKS and line[-2].isalpha():
                        rest = next((lines[n] for n in solid[order[k] + 1 :] if n not in taken and not header_key(lines[n])[0]), lines[nxt])
                        a = re.search(r"[\w€@|¢$!-]+$", line[:-1])
                        b = re.match(r"\s*([\w€@|¢$!]+)", rest)
                        address = "@" in line.split()[-1] and "." in rest.split()[0]
                        if a and b and b.group(1)[0].islower() and not address:
                            out.append((chunk, doc, "cut", a.group().lower(), b.group(1).lower(), line[-1]))
                seen: set[object] = set()
                before, halved = "", False
                for k in solid:
                    if k in taken or header_key(lines[k])[0]:
                        continue
                    tokens = lines[k].split()
                    rest, halved = halved, tokens[-1][-1] in CUT_MARKS and tokens[-1][-2:-1].isalpha()
                    for position, token in enumerate(tokens):
                        bare = token.strip(_STRIP)
                        low = bare.lower()
                        if (rest and position == 0) or (halved and position == len(tokens) - 1):  # halves of a cut word
                            before = ""
                            continue
                        for part in low.split("-"):
                            once = (part, before) if contexts else part
                            if part not in known and once not in seen and 3 <= len(part) <= WORD_LETTERS and sum(map(str.isalpha, part)) >= 2 and sum(map(str.isdigit, part)) <= 2 and "." not in part and "/" not in part:
                                seen.add(once)
                                out.append((chunk, doc, "word", part, before, ""))
                        before = low
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk_id", "doc_id", "kind", "a", "b", "c"])

    return run


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        cost = np.array([reading_cost(a, b) for a, b in zip(f["read"], f["word"])])
        f = f.assign(cost=cost)[cost <= MOST]
        yield f[["read", "word", "cost", "n_word"]]


def corpus_lexicon(chunks: DataFrame) -> DataFrame:
    """``word, n, n_clean`` over all texts."""
    texts = chunks.select("text").filter(F.col("text").isNotNull()).withColumn("_wrapped", F.col("text").rlike(_WRAPPED))
    return cut(texts.mapInArrow(_count_words, "word string, n long, n_clean long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean")))


def chosen_repairs(words: DataFrame, repairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``words`` (``a``, after the word ``b``) with ``repair``: of the words that cost the least the one that follows ``b`` most often in the corpus, then the most frequent.

    Only pairs that some choice depends on are joined with the corpus' counts."""
    code = F.pandas_udf(lambda b, w: pd.Series([pair_code(x, y) for x, y in zip(b, w)]), "long")
    joined = words.join(repairs.withColumnRenamed("read", "a"), "a")
    sure = joined.filter(F.size("options") == 1).withColumn("repair", F.col("options")[0]["word"]).drop("options")
    open_ = joined.filter(F.size("options") > 1)
    asked = open_.select("b", F.explode("options").alias("o")).select("b", "o.word", "o.rare").distinct().withColumn("code", code("b", "word"))
    texts = chunks.select("text").filter(F.col("text").isNotNull())
    counts = texts.mapInArrow(_count_pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = asked.join(counts, "code", "left").select("b", "word", F.coalesce("n", F.lit(0)).alias("n"))
    each = open_.withColumn("o", F.explode("options")).withColumn("word", F.col("o.word")).join(counts, ["b", "word"])
    order = F.struct(-F.col("n"), F.col("o.rare"), "word")
    best = each.groupBy(*words.columns).agg(F.min_by("word", order).alias("repair"))
    return sure.select(*words.columns, "repair").unionByName(best)


def find_noise(chunks: DataFrame, documents: DataFrame, repairs: bool = True) -> DataFrame:
    """``chunk_id, noise, piece, after, repair``: each piece of noise in chunks read from scanned pages; noise is hyphen, misread, header or page_number.

    A document counts as scanned if its extractor is a character reader, or if its own text shows it: cut or misread words.
    Repeated and late rows of a chunk are one; null and empty texts have no noise. ``repair`` is the text to put for
    ``piece`` ('' to drop a line), of a misread word where it stands after the word ``after``; without ``repairs`` misread words are found but none is chosen.
    Names of other columns do not matter."""
    lexicon = corpus_lexicon(chunks)
    spark = chunks.sparkSession
    doubtful = F.expr("n_clean <= 1 or n_clean * 50 < n")  # a word that scans have much more often than other texts may be a slip of theirs
    known = frozenset(r[0] for r in lexicon.filter(F.expr(f"n_clean >= {LEAST * TIMES}") & ~doubtful).coalesce(32).orderBy(F.desc("n_clean"), "word").limit(KNOWN).select("word").collect())
    texts = chunks.select("chunk_id", "doc_id", "text").filter(F.col("text").contains("\n") & F.col("chunk_id").isNotNull())
    texts = texts.withColumn("_wrapped", F.col("text").rlike(_WRAPPED))
    items = cut(texts.mapInArrow(_items(known, repairs), "chunk_id string, doc_id long, kind string, a string, b string, c string").distinct())

    words = items.filter("kind = 'word'").select("chunk_id", "doc_id", "a", "b")
    reads = words.select(F.col("a").alias("read")).distinct().join(lexicon.select(F.col("word").alias("read"), "n", "n_clean"), "read", "left")
    reads = reads.select("read", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("n_clean", F.lit(0)).alias("n_clean")).filter(doubtful)
    keys = F.pandas_udf(lambda words: words.map(delete_keys), "array<string>")
    left = reads.select("read", "n", F.explode(keys("read")).alias("key"))
    right = lexicon.filter(f"n_clean >= {LEAST} and length(word) >= 3 and not word like '%-%'").select("word", F.col("n_clean").alias("n_word"), F.explode(keys("word")).alias("key"))
    candidates = left.join(right, "key").filter(f"read <> word and n_word >= {TIMES} * n").select("read", "word", "n_word").distinct()
    options = candidates.mapInPandas(_verify, "read string, word string, cost double, n_word long")
    if repairs:
        options = options.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("cost", (-F.col("n_word")).alias("rare"), "word"))).alias("options"))
        # all that cost the least, whatever their number, as the word before decides among them
        options = options.withColumn("options", F.filter("options", lambda o: o["cost"] == F.col("options")[0]["cost"]))
        found = chosen_repairs(words, options, chunks)
    else:
        found = words.join(options.select(F.col("read").alias("a")).distinct(), "a").withColumn("repair", F.lit(None).cast("string"))
    misread = found.select("chunk_id", "doc_id", F.lit("misread").alias("noise"), F.col("a").alias("piece"), F.col("b").alias("after"), "repair")

    cuts = items.filter("kind = 'cut'").withColumn("left", F.element_at(F.split("a", "-"), -1))
    cuts = cuts.withColumn("joined", F.concat("left", "b")).withColumn("compound", F.concat_ws("-", "left", "b"))
    asked = cuts.select(F.explode(F.array("joined", "compound", "left", "b")).alias("word")).distinct()
    counts = asked.join(lexicon.select("word", "n_clean"), "word")
    for c in ("joined", "compound", "left", "b"):
        cuts = cuts.join(counts.select(F.col("word").alias(c), F.col("n_clean").alias(f"n_{c}")), c, "left").fillna(0, [f"n_{c}"])
    whole = (F.col("c") != "-") & (F.col("c") != "‐") & (F.col("c") != "‑") & (F.col("n_compound") <= F.col("n_joined"))
    is_word = (F.col("n_joined") > F.col("n_compound")) | whole | ((F.col("n_compound") == 0) & ((F.col("n_left") <= 1) | (F.col("n_b") <= 1)))
    hyphen = cuts.filter(is_word).select("chunk_id", "doc_id", F.lit("hyphen").alias("noise"), F.concat("a", "c").alias("piece"), F.lit("").alias("after"), F.col("b").alias("repair"))

    heads = items.filter("kind = 'head'")
    repeated = heads.groupBy("doc_id", "a").agg(F.count_distinct("chunk_id", "c").alias("n")).filter("n > 1").select("doc_id", "a")
    heads = heads.join(repeated, ["doc_id", "a"])
    header = heads.select("chunk_id", "doc_id", F.lit("header").alias("noise"), F.col("c").alias("piece"), F.lit("").alias("after"), F.lit("").alias("repair"))
    numbered = heads.filter("b = 'n'").select("chunk_id", "doc_id", F.lit("page_number").alias("noise"), F.col("c").alias("piece"), F.lit("").alias("after"), F.lit("").alias("repair"))
    page = items.filter("kind = 'page'").select("chunk_id", "doc_id", F.lit("page_number").alias("noise"), F.col("a").alias("piece"), F.lit("").alias("after"), F.lit("").alias("repair"))

    noise = misread.unionByName(hyphen).unionByName(header).unionByName(numbered).unionByName(page)
    noise = cut(noise)
    reader = F.lower("extractor").rlike("tesseract|ocr|easyocr|paddle|abbyy")
    by_reader = documents.select("doc_id", F.coalesce(reader, F.lit(False)).alias("reader"), F.coalesce(F.lower("extractor").rlike("markdown|transcript|receipt"), F.lit(False)).alias("other"), (F.lower(F.trim(F.coalesce("extractor", F.lit("")))).isin("", "unknown")).alias("unsaid"))
    by_reader = by_reader.groupBy("doc_id").agg(F.max("reader").alias("reader"), F.max("other").alias("other"), F.max("unsaid").alias("unsaid"))
    evidence = noise.groupBy("doc_id").agg(F.count_if(F.col("noise").isin("hyphen", "misread")).alias("slips"), F.count_distinct("noise").alias("kinds"), F.count_distinct(F.when(F.col("noise").isin("header", "page_number"), F.col("chunk_id"))).alias("marked"))
    scanned = evidence.join(by_reader, "doc_id", "left").filter("reader or (not coalesce(other, false) and ((slips >= 1 and (kinds >= 2 or slips >= 2 or coalesce(unsaid, true))) or marked >= 3))").select("doc_id")
    return noise.join(scanned, "doc_id", "left_semi").select("chunk_id", "noise", "piece", "after", "repair").distinct()


_OWN_LINE = re.compile(r"^\s*(?:[-*+•‣◦▪●○]\s|\[[ xX]?\]\s|\(?\d{1,3}[.)]\s|#{1,6}\s|\|)|\S(?: {3,}|\t)\S|.\|.*\|")


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def _rewrite(text: str, noise: list[dict]) -> str:
    """A text without its noise, as paragraphs; blank lines part paragraphs, other line ends are spaces but about items of lists and rows of tables."""
    drop = {n["piece"] for n in noise if n["repair"] == "" and n["noise"] in ("header", "page_number")}
    after = {(n["after"], n["piece"]): n["repair"] for n in noise if n["noise"] == "misread"}
    words = {piece: repair for (_, piece), repair in sorted(after.items())}
    ends = {n["piece"] for n in noise if n["noise"] == "hyphen"}
    lines = [line for line in text.split("\n") if line.strip() not in drop]
    blocks: list[tuple[str, bool]] = []  # (text, stands on a line of its own)
    current, glue = "", False

    def close() -> None:
        nonlocal current
        if current:
            blocks.append((current, False))
        current = ""

    for number, line in enumerate(lines):
        if not line.strip():
            if not glue:
                close()
                blocks.append(("", False))
            continue
        piece = line.strip()
        if not glue and _OWN_LINE.search(line):
            close()
            blocks.append((piece, True))
            continue
        current += piece if glue or not current else " " + piece
        tail = re.search(r"[\w€@|¢$!-]+$", current[:-1]) if current[-1] in CUT_MARKS else None
        glue = bool(tail) and any(x.strip() for x in lines[number + 1 :])
        if glue and tail.group().lower() + current[-1] in ends:
            current = current[:-1]
    close()
    out = ""
    for k, (piece, own) in enumerate(blocks):
        if piece:
            out += ("" if not out else "\n" if own and blocks[k - 1][1] else "\n\n") + piece
    if words:
        before = ""

        def mend(m: re.Match) -> str:
            nonlocal before
            token = m.group()
            lead = token[: len(token) - len(token.lstrip(_STRIP))]
            body = token.strip(_STRIP)
            rest = token[len(lead) + len(body) :]
            read, before = before, body.lower()
            fixed = [_cased(repair, p) if (repair := after.get((read, p.lower()), words.get(p.lower()))) else p for p in body.split("-")]
            return lead + "-".join(fixed) + rest

        out = re.sub(r"\S+", mend, out)
    return out


def repair_scans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk_id, text``: the repaired text of every chunk that has noise of scanned pages, as continuous paragraphs."""
    noise = find_noise(chunks, documents).groupBy("chunk_id").agg(F.collect_list(F.struct("noise", "piece", "after", "repair")).alias("noise"))
    texts = chunks.select("chunk_id", "text").filter(F.col("text").isNotNull()).groupBy("chunk_id").agg(F.max("text").alias("text"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_rewrite(t, list(n)) for t, n in zip(text, found)])

    return texts.join(noise, "chunk_id").select("chunk_id", rewrite("text", "noise").alias("text"))
