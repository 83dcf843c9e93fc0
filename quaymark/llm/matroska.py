"""Matroska files as media columns: mux bytes into laced blocks, parse EBML into a packet table, compute features.

A payload is 8-bit unsigned PCM, one channel, 8000 samples a second. Frames of `frame_bytes` samples go into SimpleBlocks
of up to `lace` frames (fixed-size, Xiph and EBML lacing in turn), blocks into clusters, and a Cues element lists the
clusters. The parser reads variable-length ids and sizes (unknown sizes too), clusters, block groups, all four kinds of
lacing and cues, and gives a row for each frame: track, timestamp, byte range, lacing, key flag, cluster.

Cases: a null payload is an empty one; an empty payload makes a file without clusters and no packets. Equal payloads
make equal files. Payloads of any length are stored whole. A damaged file gets the
reason in the column `error` and nulls for what it would tell; its packets are none.
Repeated
rows each give a row; an empty table gives an empty result; only the named columns are read. An output column that would
have the id's name gets an underscore.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import outputs, read, sliced, written

#: Element ids of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}
LACING = ("none", "xiph", "fixed", "ebml")
RATE = 8000
APP = b"quaymark"


def vint(value: int, width: int | None = None) -> bytes:
    """A size or number with its length marker."""
    if width is None:
        width = 1
        while value >= (1 << (7 * width)) - 1:
            width += 1
    return ((1 << (7 * width)) | value).to_bytes(width, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int, bool]:
    """Value, offset behind it, and whether all its bits are set (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError("no variable-length number here")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the file ends within a number")
    full = (1 << (7 * width)) - 1
    value = int.from_bytes(data[at : at + width], "big") & full
    return value, at + width, value == full


def _signed(data: bytes, at: int) -> tuple[int, int]:
    value, after, _ = read_vint(data, at)
    return value - ((1 << (7 * (after - at) - 1)) - 1), after


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ_VERSION, 2)]))
_INFO = element(INFO, _uint(TIMESTAMP_SCALE, 125_000) + element(MUXING_APP, APP) + element(WRITING_APP, APP))  # a tick is a sample: 1/8000 s
_TRACKS = element(TRACKS, element(TRACK_ENTRY, b"".join([_uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), element(CODEC_ID, b"A_PCM/INT/LIT"), element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))])))


def lace_frames(frames: list[bytes], lacing: str) -> bytes:
    """A block's body: the lace head, then the frames."""
    if lacing == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            step, width = len(b) - len(a), 1
            while not -((1 << (7 * width - 1)) - 1) < step < (1 << (7 * width - 1)) - 1:
                width += 1
            head += vint(step + (1 << (7 * width - 1)) - 1, width)
    elif len({len(f) for f in frames}) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return head + b"".join(frames)


def mux(payload: bytes, frame_bytes: int = 1024, lace: int = 4, cluster_blocks: int = 7) -> bytes:
    """A file that holds the payload as samples. Block timestamps are relative to their cluster and fit 16 bits."""
    if frame_bytes * lace * cluster_blocks > 32_000:
        raise ValueError("a cluster's blocks must fit 16-bit timestamps")
    span = frame_bytes * lace
    clusters, cues, at = [], [], len(_INFO) + len(_TRACKS)
    for first in range(0, len(payload), span * cluster_blocks):
        body = [_uint(TIMESTAMP, first)]
        for k, start in enumerate(range(first, min(len(payload), first + span * cluster_blocks), span)):
            stop = min(len(payload), start + span)
            frames = [payload[i : min(stop, i + frame_bytes)] for i in range(start, stop, frame_bytes)]
            kind = "none" if len(frames) == 1 else "ebml" if k % 3 == 2 else "xiph" if k % 3 == 1 or len(frames[-1]) != frame_bytes else "fixed"
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", start - first, 0x80 | LACING.index(kind) << 1) + lace_frames(frames, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(cluster)
        clusters.append(cluster)
    return _HEAD + element(SEGMENT, b"".join([_INFO, _TRACKS, *clusters, *([element(CUES, b"".join(cues))] if cues else [])]))


def walk(data: bytes, start: int = 0, stop: int | None = None, parent: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(id, parent, offset of the element, start of its body, its end), depth first."""
    at, stop = start, len(data) if stop is None else stop
    while at < stop:
        if not data[at]:
            raise ValueError("no element id here")
        width = 9 - data[at].bit_length()
        ident = int.from_bytes(data[at : at + width], "big")
        size, body, unknown = read_vint(data, at + width)
        if unknown and parent == SEGMENT and ident not in _TOP | {SEGMENT}:
            raise ValueError("only segments and clusters may have an unknown size")
        end = _end_of_unknown(data, body, stop, ident) if unknown else body + size
        if end > stop:
            raise ValueError("an element is longer than its parent")
        yield ident, parent, at, body, end
        if ident in _MASTERS:
            yield from walk(data, body, end, ident)
        at = end


def _end_of_unknown(data: bytes, at: int, stop: int, ident: int) -> int:
    """An element of unknown size ends before the first that can't be its child."""
    if ident == SEGMENT:
        return stop
    while at < stop:
        width = 9 - data[at].bit_length()
        if int.from_bytes(data[at : at + width], "big") in _TOP | {SEGMENT, EBML}:
            return at
        size, body, _ = read_vint(data, at + width)
        at = body + size
    return stop


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags, and (offset, size) of the frames of a block."""
    track, at, _ = read_vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = LACING[flags >> 1 & 3]
    if kind == "none":
        return track, time, flags, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "xiph":
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == "ebml":
        if n > 1:
            size, at, _ = read_vint(data, at)
            sizes.append(size)
            for _ in range(n - 2):
                step, at = _signed(data, at)
                sizes.append(sizes[-1] + step)
    elif (end - at) % n:
        raise ValueError("a fixed-size lace doesn't divide its block")
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace's frames are longer than its block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return track, time, flags, list(zip(starts, sizes, strict=True))


def packets(data: bytes) -> list[dict]:
    """A row for each frame, in file order; each cue must point at a cluster of its time. A damaged file raises ValueError."""
    try:
        return _packets(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"the file ends too early ({e})") from e


def _packets(data: bytes) -> list[dict]:
    out, cluster, cluster_time, segment = [], -1, 0, 0
    times: dict[int, int] = {}
    cue_time, at_cluster, cues, group = 0, 0, [], None
    for ident, parent, at, body, end in walk(data):
        if ident == SEGMENT:
            segment = body
        elif ident == CLUSTER:
            cluster, at_cluster = cluster + 1, at
        elif ident == TIMESTAMP and parent == CLUSTER:
            cluster_time = int.from_bytes(data[body:end], "big")
            times[at_cluster - segment] = cluster_time
        elif ident == BLOCK_GROUP:
            group = len(out)
        elif ident == REFERENCE_BLOCK and group is not None:
            for row in out[group:]:
                row["key"] = False
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, time, flags, frames = block_frames(data, body, end)
            for k, (start, size) in enumerate(frames):
                out.append({"track": track, "timestamp": cluster_time + time, "lace_index": k, "lacing": LACING[flags >> 1 & 3], "key": ident == BLOCK or bool(flags & 0x80), "start": start, "size": size, "cluster": cluster})
        elif ident == CUE_TIME:
            cue_time = int.from_bytes(data[body:end], "big")
        elif ident == CUE_CLUSTER:
            cues.append((cue_time, int.from_bytes(data[body:end], "big")))
    if any(times.get(where) != time for time, where in cues):
        raise ValueError("a cue points at no cluster of its time")
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0), len(raw)


def feature(samples: np.ndarray) -> str:
    """Mean, RMS about the middle, zero-crossing rate and a 16-bin histogram of samples, in fixed decimals."""
    if not len(samples):
        return ""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bins = np.bincount(samples >> 4, minlength=16)
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};zcr={crossings / max(1, len(x) - 1):.6f};hist={','.join(map(str, bins.tolist()))}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a Matroska file, as a table of the shared folder."""
    names = outputs(id_col, "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [padded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {names[0]} bigint, {names[1]} binary"), "media")


def _parsed(media: bytes | None) -> tuple[list[dict], str | None]:
    """The packets of a file, and why there are none if it is damaged."""
    try:
        return (packets(media), None) if media is not None else ([], "no file")
    except ValueError as e:
        return [], str(e)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: id, n, track, timestamp, lace_index, lacing, key, start, size, cluster."""
    kinds = [("n", pa.int64()), ("track", pa.int64()), ("timestamp", pa.int64()), ("lace_index", pa.int32()), ("lacing", pa.string()), ("key", pa.bool_()), ("start", pa.int64()), ("size", pa.int64()), ("cluster", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [_parsed(m)[0] for m in batch.column(1).to_pylist()]
            rows = [{"n": k} | p for file in found for k, p in enumerate(file)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in rows], t) for c, t in kinds)], names=[id_col, *(c for c, _ in kinds)])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n bigint, track bigint, timestamp bigint, lace_index int, lacing string, key boolean, start bigint, size bigint, cluster bigint")


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per file what its packets hold: sizes, hashes and features of the payload read back and of the file, and an error if it is damaged."""
    size, held = outputs(id_col, "n_bytes", "media")
    told = outputs(id_col, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def row(data: bytes | None) -> tuple:
        found, error = _parsed(data)
        if error:
            return None, None, None, None, None, None, error
        payload = b"".join(data[p["start"] : p["start"] + p["size"]] for p in found)
        shape = f"packets={len(found)};clusters={len({p['cluster'] for p in found})};end={max((p['timestamp'] for p in found), default=0)};"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), shape + feature(np.frombuffer(payload, dtype=np.uint8)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [row(data.as_py()) for data in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[id_col, size, *told])

    kind = media.schema[id_col].dataType.simpleString()
    types = ("bigint", "string", "bigint", "bigint", "string", "string", "string")
    return media.select(id_col, size, held).mapInArrow(run, f"`{id_col}` {kind}, {size} bigint, " + ", ".join(f"{n} {t}" for n, t in zip(told, types, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(read(spark, sf_dir, "documents"))).drop("error")
