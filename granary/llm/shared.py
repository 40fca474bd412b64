"""Helpers of the training-data operators: shared storage, Arrow text columns and vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the only word separators.
SPACES = (9, 10, 11, 12, 13, 32)
SHINGLE = 5
BATCH_ROWS = 1000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SPACES)] = True
#: Bytes that are neither ASCII letters or digits nor part of a longer UTF-8 character.
NOT_ALNUM = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = 8  # words of more 8-byte lanes are hashed one by one


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, the session's ``spark.checkpoint.dir``.  Only a local session without one gets a local folder, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts are long: tasks exchange them with Python in Arrow batches of at most ``BATCH_ROWS`` rows.  A session's own smaller number stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The session's end deletes a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost executor loses nothing.  The session's end deletes the table."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/granary/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets.  Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word of a chunk, and for each row where its words begin.  ``apart``: a mask of separating bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    between = apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = between[:-1], between[1:]
    starts = np.flatnonzero(~between & (before | edge[:n]))
    ends = np.flatnonzero(~between & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """64-bit hashes of any byte ranges of a chunk, A-Z lowered or not.

    A range is read in lanes of eight bytes, and each lane goes through the finaliser with what came before; long ranges take xxhash.  Hashers
    of different seeds are independent.
    """

    def __init__(self, data: np.ndarray, lower: bool = True, seed: int = 0) -> None:
        self.data = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
        self.lanes = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))
        self.seed = seed

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix(size.astype(np.uint64) + np.uint64(((self.seed + 1) * 0x9E3779B97F4A7C55) & 0xFFFFFFFFFFFFFFFF))
        todo = np.flatnonzero((size > 0) & (size <= 8 * _LANES))
        for k in range(_LANES):
            if not len(todo):
                break
            left = size[todo] - 8 * k
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
            out[todo] = mix((out[todo] ^ (self.lanes[starts[todo] + 8 * k] & keep)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
            todo = todo[left > 8]
        for k in np.flatnonzero(size > 8 * _LANES).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[starts[k] : ends[k]], self.seed)
        return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SEPARATOR, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and for each row where its words begin."""
    starts, ends, at = find_words(data, offsets, apart)
    return Hasher(data, seed=seed)(starts, ends), at


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, at the position of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * np.uint64((0xA24BAED4963EE407 * (2 * k + 1) * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(total)


def _whole(words: np.ndarray) -> np.ndarray:
    """One hash of all words of a short text."""
    whole = np.full(1, len(words), np.uint64)
    for k in range(len(words)):
        whole = mix((whole ^ words[k : k + 1]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
    return whole


def shingle_rows(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE, seed: int = 0) -> Iterator[np.ndarray]:
    """Shingle hashes of each row in order of their places; fewer words than ``width`` make one shingle, no words none."""
    words, at = word_hashes(data, offsets, seed=seed)
    windows = window_hashes(words, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield windows[a : b - width + 1] if b - a >= width else _whole(words[a:b]) if b > a else words[:0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    for row in shingle_rows(data, offsets, width, seed):
        yield np.unique(row)
