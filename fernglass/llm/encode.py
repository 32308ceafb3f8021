"""Encoding of a corpus with a public byte-level BPE tokenizer by a table of distinct words.

A byte-level BPE never merges over the borders of the words its pattern cuts, so a text's ids are the ids of its words one after
another. Documents are laid out in blocks; each block states its distinct words, each distinct word of the corpus is encoded
once, and the ids come back to the block, where they are put in place by position. What is shuffled is the texts once and each
block's dictionary, never the occurrences of words. A text larger than a block is cut at borders of words into pieces that are
placed by themselves."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed value: the pattern that cuts a text into words before the merges of the byte-level vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie unless told otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Characters of text in a block; a block is what one call of a worker holds.
BLOCK_CHARS = 6_000_000
#: The most partitions that blocks are spread over; beyond it a partition has several, one after another. Blocks whose rows of one word meet in one task.
MOST_PARTITIONS, BLOCKS_OF_A_WORD = 20_000, 4096


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a rank file; strings that look like special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: str) -> list[str]:
    return _words(text)


_words = regex.compile(WORD_PATTERN).findall


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block of this partition; the rows of a block come together."""
    last, seen = None, set()
    for batch in batches:
        for block, text in zip(batch.column("_block").to_pylist(), batch.column("_text").to_pylist()):
            if block != last:
                if seen:
                    yield _word_batch(last, seen)
                last, seen = block, set()
            if text:
                seen.update(_words(text))
    if seen:
        yield _word_batch(last, seen)


def _word_batch(block: int, words: set[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(words), block), pa.int64()), pa.array(list(words), pa.string())], ["_block", "_word"])


def _encode_words(path: str):
    """The ids of each (block, word); rows of a word come together, so each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        last, ids = None, []
        for batch in batches:
            out = []
            for word in batch.column("_word").to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                out.append(ids)
            yield pa.record_batch([batch.column("_block"), batch.column("_word"), pa.array(out, pa.list_(pa.int32()))], ["_block", "_word", "_ids"])

    return run


def _place(counts_only: bool, names: list[str]):
    """Put the ids of a block's words in place in its texts."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        known = words.column("_word").to_pylist()
        lists = words.column("_ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
        starts = lists.offsets.to_numpy() if len(known) else np.zeros(1, np.int64)
        flat = lists.values.to_numpy() if len(known) else np.zeros(0, np.int32)
        keys = [texts.column(c) for c in names]
        if counts_only:
            length = dict(zip(known, np.diff(starts).tolist()))
            sizes = [sum(map(length.__getitem__, _words(t))) if t else 0 for t in texts.column("_text").to_pylist()]
            return pa.table([*keys, pa.array(sizes, pa.int64())], [*names, "n_tokens"])
        flat = flat.tolist()
        ids = {word: flat[a:b] for word, a, b in zip(known, starts.tolist(), starts[1:].tolist())}
        pieces, offsets = [], [0]
        for t in texts.column("_text").to_pylist():
            placed = np.fromiter(chain.from_iterable(map(ids.__getitem__, _words(t))), np.int32) if t else np.zeros(0, np.int32)
            pieces.append(placed)
            offsets.append(offsets[-1] + len(placed))
        values = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        return pa.table([*keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], [*names, "ids"])

    return run


def _encoded(texts: DataFrame, total: int, path: str, counts_only: bool, block_chars: int) -> DataFrame:
    """The columns and the ids, or their number, of texts ``_text`` with columns that are not constant, ``total`` characters in all."""
    keys = [c for c in texts.columns if c != "_text"]
    blocks = max(1, -(-total // block_chars))
    parts = min(MOST_PARTITIONS, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks))
    texts = texts.withColumn("_block", F.pmod(F.xxhash64(F.length("_text"), *keys), F.lit(blocks))).repartition(parts, "_block").sortWithinPartitions("_block")
    # all columns go along, so that both sides read one exchange
    words = texts.mapInArrow(_block_words, "_block long, _word string")
    # the distinct-word table is laid out by word: a word's rows, one for each block, meet where it is encoded, for so many blocks at once
    words = words.withColumn("_share", F.floor(F.col("_block") / BLOCKS_OF_A_WORD)).repartition(parts, "_word", "_share").sortWithinPartitions("_word")
    words = words.select("_block", "_word").mapInArrow(_encode_words(path), "_block long, _word string, _ids array<int>")
    out = ", ".join(f"{c} {kind}" for c, kind in texts.dtypes if c in keys) + (", n_tokens long" if counts_only else ", ids array<int>")
    return texts.groupBy("_block").cogroup(words.groupBy("_block")).applyInArrow(_place(counts_only, keys), out)


def word_pieces(text: Column, chars: int) -> Column:
    """A text cut into pieces of at most about ``chars`` characters where a word starts with its space: no word of the pattern goes over such a place.

    Where a stretch of ``chars`` has none, the piece goes on to the next one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chars}}}(?<=\S)(?= \S)|.+?(?<=\S)(?= \S)|.+"), F.lit(0))


def encode_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", *, counts_only: bool = False, folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, ids`` of every document by a byte-level tokenizer without special tokens, or ``doc_id, n_tokens``.

    An empty or null text has the empty list, or 0. Documents with a null id are encoded too; repeated rows give repeated rows;
    other columns, whatever their names, are left out. ``folder`` holds the rank file ``<tokenizer>.tiktoken`` on every node."""
    path = f"{folder}/{tokenizer}.tiktoken"
    result = "n_tokens" if counts_only else "ids"
    texts = documents.select("doc_id", F.col("text").alias("_text"))
    large = F.coalesce(F.length("_text") > block_chars, F.lit(False))
    small_chars, large_chars = texts.agg(F.sum(F.when(~large, F.length("_text"))), F.sum(F.when(large, F.length("_text")))).first()
    out = _encoded(texts.filter(~large), small_chars or 0, path, counts_only, block_chars)
    if not large_chars:
        return out
    # rows of large texts are told apart by a number that the cut of lineage keeps, whatever is computed again
    rows = cut(texts.filter(large).withColumn("_row", F.monotonically_increasing_id()))
    pieces = rows.select("doc_id", "_row", F.posexplode(word_pieces(F.col("_text"), block_chars)).alias("_piece", "_text"))
    placed = _encoded(pieces, large_chars, path, counts_only, block_chars).groupBy("doc_id", "_row")
    joined = F.sum("n_tokens") if counts_only else F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "ids"))), lambda x: x["ids"]))
    return out.unionByName(placed.agg(joined.alias(result)).select("doc_id", result))


def _decode(shared):
    """Texts of lists of ids: ids are joined to pieces by place in the table of pieces, and a row's pieces put together, without a row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            flat = table.take(lists.flatten())
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), flat), pa.scalar(b"", pa.large_binary()))
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", *, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` through a join of ids with pieces; the inverse of ``encode_documents`` on valid Unicode, row by row.

    The piece table has an entry per id of the vocabulary (50,256), which bounds the broadcast. Empty and null lists give ''; repeated rows and
    null ids give rows of their own; bytes that are no text become the replacement character; an id that the table lacks raises."""
    path = f"{folder}/{tokenizer}.tiktoken"
    with open(path, "rb") as lines:
        pieces = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    table = [pieces.get(k) for k in range(max(pieces) + 1)]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(encoded.sparkSession.sparkContext.broadcast(table)), "doc_id long, text string")
