"""Structure operators over DataFrames: sections, tables, chunks, pages and names that look like versions of one document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions.text import dated, normalised_stem, parent_folder, stripped

CHUNK = "doc_id long, chunk_index long, text string, token_count long, heading_path array<string>, lines array<long>, pages array<long>"
#: Fixed value: how alike two stems are that are worth mentioning.
SIMILAR = 0.85
#: Stems of a side of a tile, pairs held against each other at once, and tasks for each core.
TILE, AT_ONCE, TASKS = 4096, 1_000_000, 4


def _as_blocks(text: str) -> list[S.Block]:
    """Turns of a transcript: what blank lines part; the role stands before the colon."""
    return [S.Block(part, part.partition(":")[0][:20] if ":" in part[:24] else "prose") for part in text.split("\n\n")]


def cut_text(text: str, strategy: str) -> list[S.Piece]:
    if strategy == "markdown":
        return S.chunk_markdown(text)
    return S.chunk_blocks(_as_blocks(text)) if strategy == "blocks" else S.chunk_text(text)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, strategy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "strategy"))):
            rows += [(doc, k, p.text, p.tokens, list(p.heading_path), list(p.lines or ()), list(p.pages)) for k, p in enumerate(cut_text(text, strategy))]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "chunk_index", "text", "token_count", "heading_path", "lines", "pages"])


def strategy_of(extractor: Column) -> Column:
    """How a document is cut; names of extractors are inexact, and any other, or none, means plain text."""
    return F.when(F.lower(extractor).contains("markdown"), "markdown").when(F.lower(extractor).contains("transcript"), "blocks").otherwise("text")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Chunks of ``doc_id, text, extractor`` by the strategy of the extractor; null and blank texts have none. No rows move."""
    rows = documents.filter(F.col("text").rlike(r"\S")).select("doc_id", "text", strategy_of(F.col("extractor")).alias("strategy"))
    return rows.mapInArrow(_chunks, CHUNK)


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, k, list(path), len(body)) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for k, (path, body, _) in enumerate(S.sections(text))]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()))], ["doc_id", "section", "heading_path", "n_chars"])


def markdown_sections(documents: DataFrame) -> DataFrame:
    """``doc_id, section, heading_path, n_chars`` of each section with a body."""
    return documents.filter("text is not null").select("doc_id", "text").mapInArrow(_sections, "doc_id long, section long, heading_path array<string>, n_chars long")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, start, end, head) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for start, _, end, head in S.tables(text)]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "start", "end", "head"])


def pipe_tables(documents: DataFrame) -> DataFrame:
    """``doc_id, start, end, head`` of each pipe table; texts without a rule line never leave the JVM."""
    rows = documents.filter(F.col("text").rlike(r"(?m)^[|\-: \t]*--[|\-: \t]*$|\|")).select("doc_id", "text")
    return rows.mapInArrow(_tables, "doc_id long, start long, end long, head string")


def contents_pages(pages: DataFrame) -> DataFrame:
    """``pages`` that list contents, from ``text, page_count``, by expressions alone."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    ends = F.transform(F.filter(lines, lambda x: x.rlike(S.CONTENTS_LINE)), lambda x: F.regexp_extract(x, S.CONTENTS_LINE, 1).cast("int"))
    rows = pages.withColumns({"_lines": F.size(lines), "_n": ends})
    rises = F.zip_with(F.slice("_n", 1, F.greatest(F.size("_n") - 1, F.lit(0))), F.slice("_n", 2, F.greatest(F.size("_n") - 1, F.lit(0))), lambda a, b: F.when(a <= b, 1).otherwise(0))
    enough = (F.size("_n") >= S.CONTENTS_LINES) & (F.size("_n") >= F.col("_lines") * S.CONTENTS_SHARE)
    inside = F.forall("_n", lambda x: (x >= 1) & (x <= F.col("page_count")))
    ascending = F.aggregate(rises, F.lit(0), lambda s, x: s + x) >= (F.size("_n") - 1) * S.CONTENTS_ASCENDING
    return rows.filter(enough & inside & ascending).drop("_lines", "_n")


def respace_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``: the stored-order text ``raw`` with its words parted as in ``reading``."""

    @F.pandas_udf("string")
    def part(raw: pd.Series, reading: pd.Series) -> pd.Series:
        return pd.Series([S.respaced(a or "", b or "") for a, b in zip(raw, reading)])

    return pages.withColumn("text", part("raw", "reading"))


def document_sections(pages: DataFrame) -> DataFrame:
    """``doc_id, page, section, text, heading_path, opens`` of pages ``doc_id, page, text, headings`` with the path carried on; a document is one group, as
    each page needs what the one before leaves."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        path: list = []
        rows = []
        for r in frame.sort_values("page").itertuples():
            found, path = S.page_sections(r.text or "", [(h["title"], h["level"]) for h in (r.headings if r.headings is not None else [])], path)
            rows += [(r.doc_id, r.page, k, text, list(at), opens) for k, (text, at, opens) in enumerate(found)]
        return pd.DataFrame(rows, columns=["doc_id", "page", "section", "text", "heading_path", "opens"])

    return pages.groupBy("doc_id").applyInPandas(run, "doc_id long, page long, section long, text string, heading_path array<string>, opens boolean")


def page_islands(pages: DataFrame) -> DataFrame:
    """``doc_id, spec`` of pages ``doc_id, page``: runs of pages as ranges, by gaps and islands."""
    rows = pages.select("doc_id", "page").distinct().withColumn("_run", F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    runs = rows.groupBy("doc_id", "_run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    lists = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))).alias("l"))
    return lists.select("doc_id", F.array_join("l.s", ",").alias("spec"))


def unsupported_numbers(readings: DataFrame) -> DataFrame:
    """``readings`` with ``missing``: numbers of ``markdown`` that ``layer`` lacks, as they stand or by digits."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, r"\D", "")
    have = F.array_union(numbers(F.col("layer")), F.transform(numbers(F.col("layer")), bare))
    return readings.withColumn("missing", F.array_distinct(F.filter(numbers(F.col("markdown")), lambda n: ~F.array_contains(have, n) & ~F.array_contains(have, bare(n)))))


def alike_stems(first: list[str], second: list[str], least: float) -> list[tuple[str, str]]:
    """The pairs, the lesser stem first, whose ratio of matching blocks is ``least`` or more; both lists in order, and the same for pairs within one.

    Matched letters are at most those in common, so counts of letters leave few pairs. With M matched letters in B blocks of lengths a, b: 2M >= least (a + b),
    B <= a + b - 2M + 1, and common letter pairs are at least M - B."""
    within = first == second
    letters = sorted(set("".join(first) + "".join(second)))
    kind = np.uint8 if max(map(len, [*first, *second]), default=0) < 256 else np.int32
    counts = [np.array([[t.count(c) for t in x] for c in letters], kind) for x in (first, second)]
    sizes = [np.array([len(t) for t in x], np.int32) for x in (first, second)]
    pairs = {t: Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in {*first, *second}}
    found, matcher = [], SequenceMatcher(None)
    step = max(1, AT_ONCE // max(1, len(first)))
    for at in range(0, len(second), step):
        common = np.zeros((min(step, len(second) - at), len(first)), kind)
        for a, b in zip(*counts):
            common += np.minimum(b[at : at + step, None], a[None, :])
        q, p = np.nonzero(2 * common.astype(np.int32) >= least * (sizes[1][at : at + step, None] + sizes[0][None, :]) - 1e-6)
        for b, a in zip((q + at).tolist(), p.tolist()):
            x, y = first[a], second[b]
            if within and a >= b or x == y:
                continue
            x, y = min(x, y), max(x, y)
            total = len(x) + len(y)
            if (pairs[x] & pairs[y]).total() < 1.5 * least * total - total - 1 - 1e-6:
                continue
            matcher.set_seq2(y)
            matcher.set_seq1(x)
            if matcher.ratio() >= least:
                found.append((x, y))
    return found


def similar_names(documents: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``uri_a, uri_b``: active documents of one source and folder whose undated names are alike without version decoration.

    Files of one stem are a class: each is paired with its representative, the first path, and representatives of alike stems with each other, so that
    a folder of like names gives as many rows as files and no link is lost. All stems of a folder are held against each other by how often they have each letter, in tiles of
    at most about ``TILE`` names a side; what shares enough letters and letter pairs goes on, and the ratio of matching blocks decides."""
    rows = documents.filter((F.col("lifecycle") == "active") & ~dated(F.col("uri"))).select("source_id", "uri", parent_folder(F.col("uri")).alias("folder"), normalised_stem(F.col("uri")).alias("stem")).filter("stem <> ''").distinct()
    stems = rows.select("source_id", "folder", "stem").distinct()
    key = ["source_id", "folder"]
    tiles = stems.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    placed = stems.join(tiles, key).withColumn("_tile", F.pmod(F.hash("stem"), F.col("_tiles")))
    paired = placed.select(*key, "stem", "_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    paired = paired.select(*key, "stem", "_tile", F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"))

    def alike_in(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["_i"].iloc[0], frame["_j"].iloc[0]
        found = pd.DataFrame(alike_stems(*(sorted(frame["stem"][frame["_tile"] == t]) for t in (i, j)), least), columns=["sa", "sb"])
        return found.assign(source_id=frame["source_id"].iloc[0], folder=frame["folder"].iloc[0])[[*key, "sa", "sb"]]

    parts = TASKS * documents.sparkSession.sparkContext.defaultParallelism  # stated, as few bytes are much work
    alike = paired.repartition(parts, *key, "_i", "_j").groupBy(*key, "_i", "_j").applyInPandas(alike_in, "source_id string, folder string, sa string, sb string")
    first = rows.groupBy(*key, "stem").agg(F.min("uri").alias("_first"))
    a, b = (first.select(*key, F.col("stem").alias(f"s{x}"), F.col("_first").alias(f"u{x}")) for x in "ab")
    members = rows.join(first, [*key, "stem"]).filter("uri <> _first").select(F.col("_first").alias("uri_a"), F.col("uri").alias("uri_b"))
    linked = alike.join(a, [*key, "sa"]).join(b, [*key, "sb"]).filter("ua <> ub").select(F.least("ua", "ub").alias("uri_a"), F.greatest("ua", "ub").alias("uri_b"))
    return linked.unionByName(members).distinct()


def font_headings(runs: DataFrame) -> DataFrame:
    """``doc_id, page, number, heading, level`` of text runs ``doc_id, page, top, size, text`` in order of ``number``; level 1 is the largest type.

    Runs side by side on one line are joined. Body type is the size with most characters, ties the first met. Sizes at least two points above it that head
    at least three short lines with letters are levels; in a long document a size that spans few pages shares the level of the next smaller one. Blank runs
    and null texts don't count; a document without heads has no rows."""
    rows = runs.select("doc_id", "page", "number", "top", "size", stripped(F.col("text")).alias("text")).filter("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("page", "number")
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = rows.withColumn("_new", F.when(same("page") & same("top") & same("size"), 0).otherwise(1)).withColumn("_line", F.sum("_new").over(order))
    lines = rows.groupBy("doc_id", "_line").agg(F.first("page").alias("page"), F.min("number").alias("number"), F.first("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), " ").alias("heading"))
    weights = rows.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "number")).alias("met"))
    body = weights.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "met")).alias("_body"))
    last = rows.groupBy("doc_id").agg(F.max("page").alias("_last"))
    letters = F.length(F.regexp_replace("heading", r"(?U)[^\p{L}]", ""))
    heads = lines.join(body, "doc_id").filter((F.col("size") >= F.col("_body") + S.HEADING_POINTS) & (F.length("heading") <= S.HEADING_CHARS) & (letters >= S.HEADING_LETTERS))
    sizes = heads.groupBy("doc_id", "size").agg(F.count("*").alias("uses"), (F.max("page") - F.min("page")).alias("span")).filter(F.col("uses") >= S.HEADING_USES).join(last, "doc_id")
    sizes = sizes.withColumn("_wide", (F.col("_last") < S.LONG_DOCUMENT) | (F.col("span") >= F.col("_last") * S.LEAST_SPAN))
    every = Window.partitionBy("doc_id")
    sizes = sizes.withColumn("_wide", F.col("_wide") | ~F.max("_wide").over(every))  # where none spans enough, all count
    down = Window.partitionBy("doc_id").orderBy(F.desc("size"))
    above, wide = F.sum(F.col("_wide").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.sum(F.col("_wide").cast("int")).over(every)
    levels = sizes.select("doc_id", "size", (F.least(F.coalesce(above, F.lit(0)), wide - 1) + 1).cast("int").alias("level"))
    return heads.join(levels, ["doc_id", "size"]).select("doc_id", "page", "number", "heading", "level")


def heading_strip(texts: DataFrame) -> DataFrame:
    """``texts`` with ``plain``, the text without heading marks, and ``headings``, its headings ``title, level`` in order; a null text has none."""
    mark = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    lines = F.split(F.col("text"), r"\r\n|\n|\r", -1)
    level = lambda x: F.length(F.regexp_extract(x, mark, 1))
    title = lambda x: F.regexp_extract(x, mark, 2)
    heads = F.filter(F.transform(lines, lambda x: F.struct(title(x).alias("title"), level(x).alias("level"))), lambda h: h["title"] != "")
    plain = F.array_join(F.transform(lines, lambda x: F.when(title(x) != "", title(x)).otherwise(x)), "\n")
    return texts.withColumns({"plain": plain, "headings": heads})


def page_set(spec: Column) -> Column:
    """The pages of a specification such as ``3,5-7`` in order, null for ``all``; anything else raises when rows are computed."""
    parts = F.filter(F.transform(F.split(F.lower(F.trim(spec)), ","), lambda p: F.trim(p)), lambda p: p != "")
    low, high = (lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")), (lambda p: F.regexp_extract(p, r"(\d+)-?$", 1).cast("int"))
    wrong = F.filter(parts, lambda p: ~p.rlike(r"^\d+(-\d*)?$") | (low(p) < 1) | (high(p) < low(p)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))
    fault = F.raise_error(F.concat(F.lit("no page or range: "), F.coalesce(F.get(wrong, 0), F.lit("(none)")))).cast("array<int>")
    return F.when(F.lower(F.trim(spec)) == "all", F.lit(None).cast("array<int>")).when((F.size(wrong) > 0) | (F.size(parts) == 0), fault).otherwise(pages)
