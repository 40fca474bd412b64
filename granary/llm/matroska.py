"""Matroska: lossless byte tracks in an EBML container, and a parser from stored bytes to packet tables.

``to_media`` stores each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as 8-bit PCM frames in laced blocks of
clusters with cues.  ``packet_table`` parses stored files into one row a frame (track, timestamp, byte range); ``read_media`` joins the
frames of a file again and computes features.

Null texts count as empty.  Bytes that are no valid EBML give the packets before the fault and an error text, never a crash.  Repeated rows
give repeated results, empty tables none, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

PAD = 64
FRAME = 1024
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 4  # 32 frames of 1024 samples keep relative timestamps within 16 bits
RATE = 8000

# Element ids of the public EBML and Matroska specifications (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, FRAME_DURATION, CODEC, AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
INSIDE_SEGMENT = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}


class Packet(NamedTuple):
    """A frame: its track, timestamp in scale units, cluster and block numbers, place in the block, key flag and byte range in the file."""

    track: int
    timestamp: int
    cluster: int
    block: int
    lace: int
    key: bool
    start: int
    length: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: list[tuple[int, str, float, int]]
    cues: list[tuple[int, int]]
    scale: int
    error: str | None


# ---- writing


def _size(n: int) -> bytes:
    width = max(1, -(-(n + 2).bit_length() // 7))  # all-ones values are reserved
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], relative: int) -> bytes:
    """A key-frame SimpleBlock of track 1: no lacing for one frame, fixed for equal sizes, EBML lacing otherwise."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        head, lace = b"", 0
    elif len(set(sizes)) == 1:
        head, lace = bytes([len(frames) - 1]), 2
    else:
        head, lace = bytes([len(frames) - 1]) + _size(sizes[0]), 3
        for before, now in zip(sizes, sizes[1:-1]):
            step = now - before
            width = 1
            while abs(step) > (1 << 7 * width - 1) - 1:
                width += 1
            head += (step + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | lace << 1) + head + b"".join(frames))


_HEAD = _element(EBML, _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(MAX_ID, 4) + _number(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4) + _number(DOC_READ_VERSION, 2))


def _tracks(frame: int) -> bytes:
    audio = _element(AUDIO, _element(FREQUENCY, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    return _element(TRACKS, _element(TRACK, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(LACING, 1) + _number(FRAME_DURATION, frame * (10**9 // RATE)) + _element(CODEC, b"A_PCM/INT/LIT") + audio))


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % PAD or (0 if payload else PAD))


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file of one 8-bit track; a timestamp unit is one sample.  Larger frames make shorter clusters, as a block's time in its cluster has 16 bits."""
    if not 0 < frame * FRAMES_A_BLOCK < 1 << 15:
        raise ValueError(f"a frame must have 1 to {(1 << 15) // FRAMES_A_BLOCK - 1} samples")
    body = _element(INFO, _number(TIMESTAMP_SCALE, 10**9 // RATE) + _element(DURATION, struct.pack(">d", len(payload))) + _element(MUXER, b"granary") + _element(WRITER, b"granary")) + _tracks(frame)
    parts, cues, at = [body], [], len(body)
    span = frame * FRAMES_A_BLOCK
    reach = span * min(BLOCKS_A_CLUSTER, ((1 << 15) - 1) // span + 1)
    for first in range(0, len(payload), reach):
        blocks = [_number(TIMESTAMP, first)]
        for a in range(first, min(first + reach, len(payload)), span):
            stop = min(a + span, len(payload))
            blocks.append(_laced([payload[k : min(k + frame, stop)] for k in range(a, stop, frame)], a - first))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, first) + _element(CUE_PLACE, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


# ---- reading


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """Value and next position of a variable-length integer; with ``marker`` its length bit stays (ids).  An unknown size is -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad variable-length integer at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Elements in a range: id, body start, body end.  One of unknown size ends at the next element of the segment's level, or at the end."""
    while at < end:
        key, at = _vint(data, at, True)
        n, at = _vint(data, at, False)
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"element {key:x} at {at} runs past its parent")
        if n < 0 and key == CLUSTER:
            probe = at
            while probe < end:
                inner, after = _vint(data, probe, True)
                if inner in INSIDE_SEGMENT:
                    break
                size, after = _vint(data, after, False)
                probe = after + max(size, 0)
            stop = min(probe, end)
        yield key, at, stop
        at = stop


def _lace_sizes(data: bytes, at: int, end: int, lace: int) -> tuple[list[int], int]:
    if lace == 0:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lace == 2:
        if (end - at) % count:
            raise ValueError(f"fixed lacing doesn't divide at {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    if lace == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
            sizes.append(n)
    else:
        for k in range(count - 1):
            before = at
            n, at = _vint(data, at, False)
            sizes.append(n if k == 0 else sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"lacing runs past its block at {at}")
    return [*sizes, last], at


def demux(data: bytes) -> Media:
    """Packets, tracks and cues of a file; the error names the first fault, and what came before it stays."""
    packets: list[Packet] = []
    tracks: list[tuple[int, str, float, int]] = []
    cues: list[tuple[int, int]] = []
    duration: dict[int, int] = {}  # of a track's frames, in nanoseconds
    scale, clusters, blocks = 1_000_000, 0, 0
    starts: set[int] = set()  # of clusters, from the segment's first byte
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0

    def block(a: int, b: int, base: int, simple: bool) -> None:
        nonlocal blocks
        track, a = _vint(data, a, False)
        relative, flags = struct.unpack_from(">hB", data, a)
        sizes, a = _lace_sizes(data, a + 3, b, flags >> 1 & 3)
        stamp = base + relative
        for k, n in enumerate(sizes):
            packets.append(Packet(track, stamp + k * duration.get(track, 0) // scale, clusters - 1, blocks, k, bool(flags & 0x80) or not simple, a, n))
            a += n
        blocks += 1

    try:
        top = iter(_children(data, 0, len(data)))
        if not data or next(top)[0] != EBML:
            raise ValueError("no EBML header")
        for key, a, b in top:
            if key != SEGMENT:
                continue
            origin = at = a
            for key, a, b in _children(data, a, b):
                before, at = at, b
                if key == INFO:
                    scale = next((whole(x, y) for k, x, y in _children(data, a, b) if k == TIMESTAMP_SCALE), scale)
                elif key == TRACKS:
                    for k, x, y in _children(data, a, b):
                        if k == TRACK:
                            number, codec, rate, depth = 0, "", 0.0, 0
                            for k2, x2, y2 in _children(data, x, y):
                                if k2 == TRACK_NUMBER:
                                    number = whole(x2, y2)
                                elif k2 == FRAME_DURATION:
                                    duration[number] = whole(x2, y2)
                                elif k2 == CODEC:
                                    codec = data[x2:y2].decode("ascii", "replace")
                                elif k2 == AUDIO:
                                    for k3, x3, y3 in _children(data, x2, y2):
                                        if k3 == FREQUENCY:
                                            rate = real(x3, y3)
                                        elif k3 == BIT_DEPTH:
                                            depth = whole(x3, y3)
                            tracks.append((number, codec, rate, depth))
                elif key == CLUSTER:
                    base, clusters = 0, clusters + 1
                    starts.add(before - origin)
                    for k, x, y in _children(data, a, b):
                        if k == TIMESTAMP:
                            base = whole(x, y)
                        elif k == SIMPLE_BLOCK:
                            block(x, y, base, True)
                        elif k == BLOCK_GROUP:
                            for k2, x2, y2 in _children(data, x, y):
                                if k2 == BLOCK:
                                    block(x2, y2, base, False)
                elif key == CUES:
                    for k, x, y in _children(data, a, b):
                        if k == CUE_POINT:
                            time = place = 0
                            for k2, x2, y2 in _children(data, x, y):
                                if k2 == CUE_TIME:
                                    time = whole(x2, y2)
                                elif k2 == CUE_PLACE:
                                    place = next((whole(x3, y3) for k3, x3, y3 in _children(data, x2, y2) if k3 == CUE_CLUSTER), 0)
                            cues.append((time, place))
            if any(place not in starts for _, place in cues):
                raise ValueError("a cue points at no cluster")
    except (ValueError, IndexError, struct.error) as e:
        return Media(packets, tracks, cues, scale, str(e))
    return Media(packets, tracks, cues, scale, None)


# ---- Spark


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """One Matroska file a row: the id, the text's bytes before padding, and the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                raw = [(x or "").encode() for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x), frame) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a frame of each stored file, in file order: track, timestamp in nanoseconds, cluster, block, lace, key, byte range."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1).to_pylist()):
                found = demux(data or b"")
                columns = list(zip(*found.packets)) or [()] * 8
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                arrays[1] = pa.array([t * found.scale for t in columns[1]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found.packets), batch.column(0).type), *arrays], ["id", "track", "timestamp_ns", "cluster", "block", "lace", "key", "start", "length"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, track int, timestamp_ns long, cluster int, block int, lace int, key boolean, start long, length long").withColumnRenamed("id", id_col)


def feature(found: Media, payload: bytes) -> str:
    """Container and signal features of one file, as text that is equal for equal bytes."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(len(samples), 1)
    crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
    span = (max((p.timestamp for p in found.packets), default=0)) * found.scale // 1000
    return f"packets={len(found.packets)};blocks={len({p.block for p in found.packets})};clusters={len(found.cues)};last_us={span};mean={int(samples.sum()) * 1000 // n};energy={int((samples * samples).sum()) // n};crossings={crossings};peak={int(np.abs(samples).max(initial=0))}"


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read stored files back: sizes, digests of the joined frames and of the file, tail checksum, feature text and the first error."""
    kind, counted = media.schema[id_col].dataType.simpleString(), "n_bytes" in media.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                data = data or b""
                found = demux(data)
                payload = b"".join([data[p.start : p.start + p.length] for p in found.packets])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, payload), found.error))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    source = media.select(F.col(id_col).alias("id"), (F.col("n_bytes") if counted else F.lit(None).cast("long")).alias("n_bytes"), F.col(media_col).alias("media"))
    return source.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string").withColumnRenamed("id", id_col)
