"""Concatenate and cut: documents become one token stream that is cut every ``sequence_tokens`` ids.

Two passes.  The first tokenises each partition once, stores the ids and sums the partition's tokens; prefix sums over these
totals (two numbers a partition) give each partition its global offset.  The second turns every document's global range into
pieces, one for each fixed window that the range touches, with boundary records.  Nothing is shuffled, and no group is gathered.

Null texts count as empty and give only the end id; empty tables give no rows; repeated rows are packed as often as they occur;
other columns are ignored.  Long documents simply span more windows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

TOKENS = "part int, at long, id long, n long, ids binary"
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, first boolean, last boolean"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a byte-level BPE file, as a function from texts to id lists.

    The merges of the file run in a faster library that gives the same ids; texts with an added token's string go to the file's own library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    added = tuple(x["content"] for x in said.get("added_tokens", ()))
    plain = {**{b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    other = iter(range(256, 512))
    to_byte = {plain[b] if b in plain else chr(next(other)): b for b in range(256)}
    ranks = {bytes(to_byte[c] for c in word): k for word, k in said["model"]["vocab"].items() if word not in added}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(x in text for x in added):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _narrow(ids: list[int]) -> np.ndarray:
    """A document's ids as 16-bit numbers if all of them fit, else as 32-bit ones."""
    wide = np.array(ids, "<u4")
    return wide.astype("<u2") if wide.max() < 65536 else wide


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = _tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                ids = [_narrow([*encode(text or ""), end_id]) for text in rows.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), rows.column(0).cast(pa.int64()), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "at", "id", "n", "ids"])

    return run


def _cut(base, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset_of = base.value
        for batch in batches:
            out: list[tuple] = []
            for part, at, key, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                place, start = offset_of[part] + at, 0
                while start < n:
                    inside = (place + start) % size
                    length = min(size - inside, n - start)
                    out.append((key, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, (place + start) // size, inside, start == 0, start + length == n))
                    start += length
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "first", "last"])

    return run


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Stored token rows: partition, place in the partition's stream, document, token count with the end id, ids as 16-bit numbers (32-bit where one needs it)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stash(source.mapInArrow(_tokenise(tokenizer_path or default_tokenizer(), end_id), TOKENS), "tokens")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence_tokens: int = 1024, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of documents in fixed windows of one global token stream.

    One row a piece: document, first id, length, checksum of its ids, the document's tokens, window, place in the window, and whether the
    piece is its document's first or last.  Only the last window can be short; it is what a trainer pads.
    """
    tokens = tokenise(docs, id_col, text_col, tokenizer_path, end_id)
    totals = {r.part: r.total for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect()}  # two numbers a partition
    base = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, total in totals.items():
        base[part + 1] = total
    shipped = tokens.sparkSession.sparkContext.broadcast(np.cumsum(base).tolist())
    pieces = tokens.mapInArrow(_cut(shipped, sequence_tokens), PIECES)
    return pieces.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("first").alias("starts_document"), F.col("last").alias("ends_document"))
