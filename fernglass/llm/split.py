"""Splitting of oversized texts at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LIMIT, OVERLAP = 480, 64

_TOKENS = regex.compile(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")
#: Ends of natural units, from the strongest to the weakest: paragraph, line or row, sentence. A cut lies at the end of the match.
_BREAKS = (regex.compile(r"\n[^\S\n]*\n\s*"), regex.compile(r"\n"), regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+"))


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(first character, end character, size)`` of each piece of ``text``.

    The offsets of the tokens are the prefix sums of size, so token k is where size k is reached. Each kind of boundary is a
    sorted array of token numbers; the end of a piece is the last boundary up to ``limit`` by binary search, of the strongest
    kind that lies in the piece's second half, else of any kind, else a hard cut. The next piece starts at the first
    boundary within ``overlap`` before that end that leaves at least half of it, else ``overlap`` before it."""
    found = [m.span() for m in _TOKENS.finditer(text)]
    n = len(found)
    if n <= limit:
        return [(0, len(text), n)]
    starts = np.fromiter((a for a, _ in found), np.int64, n)
    kinds = [np.unique(np.searchsorted(starts, [m.end() for m in pattern.finditer(text)])) for pattern in _BREAKS]
    every = np.unique(np.concatenate(kinds)) if any(map(len, kinds)) else np.zeros(0, np.int64)

    def last(of: np.ndarray, low: int, high: int) -> int | None:
        """The last boundary in (low, high]."""
        k = np.searchsorted(of, high, "right") - 1
        return int(of[k]) if k >= 0 and of[k] > low else None

    pieces, at, done = [], 0, 0
    while True:
        high = at + limit
        if high >= n:
            pieces.append((found[at][0], found[n - 1][1], n - at))
            return pieces
        end = next((b for of in kinds if (b := last(of, max(done, at + limit // 2), high)) is not None), None)
        if end is None:
            end = last(every, done, high)
        if end is None:
            end = high
        pieces.append((found[at][0], found[end - 1][1], end - at))
        k = np.searchsorted(every, end - overlap)
        step = int(every[k]) if k < len(every) and every[k] <= end - (overlap + 1) // 2 else end - overlap
        at, done = max(step, at + 1), end


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, first, text, size = [], [], [], [], []
            for k, value in enumerate(batch.column("text").to_pylist()):
                cuts = spans(value, limit, overlap)
                if len(cuts) > 1:
                    for p, (a, b, n) in enumerate(cuts):
                        rows.append(k)
                        piece.append(p)
                        first.append(a)
                        text.append(value[a:b])
                        size.append(n)
            at = pa.array(rows, pa.int64())
            kept = batch.select(["chunk_id", "doc_id", "chunk_index", "heading_path"]).take(at)
            extra = [pa.array(piece, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string()), pa.array(size, pa.int64())]
            yield pa.record_batch([*kept.columns, *extra], [*kept.schema.names, "piece", "first_char", "text", "token_count"])

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, doc_id, chunk_index, piece, first_char, text, token_count, heading_path`` of the pieces of oversized chunks.

    A chunk is oversized if its text has more than ``limit`` tokens (runs of letters and digits, and other characters that
    are not white space), whatever its ``token_count`` says. ``chunk_index`` is the piece's place in its document after the
    split: its chunk's old index, and one more for each piece added before it. Repeated and late rows of a chunk are one;
    null, empty and blank texts have no pieces; a null index stays null; other columns are left out. A text has no more tokens
    than characters, so only rows with more than ``limit`` characters leave the JVM."""
    long = chunks.select("chunk_id", "doc_id", "chunk_index", "heading_path", "text").filter(F.length("text") > limit)
    pieces = long.mapInArrow(_split(limit, overlap), "chunk_id string, doc_id long, chunk_index long, heading_path array<string>, piece long, first_char long, text string, token_count long")
    key = ["chunk_id", "doc_id", "chunk_index", "piece", "first_char"]
    pieces = pieces.groupBy(*key).agg(F.max(F.struct("text", "token_count", "heading_path")).alias("r")).select(*key, "r.*")
    return _renumber(cut(pieces))


def _renumber(pieces: DataFrame, width: int = 4096) -> DataFrame:
    """Shift each piece by what earlier oversized chunks of its document added; in two steps, so that a document with a third of all chunks is many groups."""
    added = pieces.groupBy("doc_id", "chunk_index", "chunk_id").agg(F.count_distinct("piece").alias("n"))
    added = added.groupBy("doc_id", "chunk_index").agg((F.max("n") - 1).alias("more")).withColumn("_block", F.floor(F.col("chunk_index") / width))
    blocks = added.groupBy("doc_id", "_block").agg(F.sum("more").alias("_sum"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("doc_id", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("doc_id", "_block").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    shift = added.withColumn("_inside", F.coalesce(F.sum("more").over(inside), F.lit(0)))
    same = shift["doc_id"].eqNullSafe(blocks["doc_id"]) & shift["_block"].eqNullSafe(blocks["_block"])
    shift = shift.join(blocks, same).select(shift["doc_id"].alias("_doc"), shift["chunk_index"].alias("_index"), (F.col("_before") + F.col("_inside")).alias("_shift"))
    on = pieces["doc_id"].eqNullSafe(shift["_doc"]) & pieces["chunk_index"].eqNullSafe(shift["_index"])
    out = pieces.join(shift, on).withColumn("chunk_index", F.col("chunk_index") + F.col("_shift") + F.col("piece"))
    return out.select("chunk_id", "doc_id", "chunk_index", "piece", "first_char", "text", "token_count", "heading_path")
