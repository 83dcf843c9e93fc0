"""WARC records in seekable Zstandard bundles: write, index, read back whole, fetch single records.

A bundle is a file of independent Zstandard frames, each with several records, and a seek table as its footer
(a skippable frame that names every frame's compressed and full size). A record is found by bundle, frame and
offset within that frame, so fetching one record decompresses one frame. Bundles are rows of a binary column,
which Spark's committer writes once however often a task is repeated; export_files() lays them out as files.

Cases: a null payload is an empty one. Null ids are kept as null, empty ones as empty; equal payloads under null ids only are all
responses. Rows that repeat an id and a payload are all responses if theirs is the largest id. A payload larger
than a frame or a bundle gets a frame or a bundle of its own. An empty table gives no bundles and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import fresh, joined, read, written

#: Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ID_PREFIX, NO_ID = "urn:record:", "urn:unnamed"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = "bundle string, n_records bigint, n_frames bigint, content binary, entries array<struct<record_id:string,frame:int,frame_at:bigint,at:bigint,length:bigint>>"
RECORD_SCHEMA = "record_id string, uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, bundle string, frame int, at bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """(record_id, uri, payload, refers_to): refers_to is the largest id with an equal payload, null for that record itself and for payloads under min_bytes."""
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = written(rows.select("record_id", "digest"), "digests")
    # A count and a maximum for each digest: a group of copies of any size leaves one row for each map task.
    groups = written(ids.groupBy("digest").agg(F.max("record_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null"), "copies")
    # Only ids meet their group; payloads then meet by id, so no group of copies gathers.
    others = joined(ids, groups, ["digest"], "copies").where("not record_id <=> refers_to").distinct()
    found = others.select(F.col("record_id").alias("other_id"), F.col("digest").alias("other"), "refers_to")
    marked = rows.join(found, F.col("record_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other")), "left")
    return marked.select("record_id", "uri", "payload", F.when(F.octet_length("payload") >= min_bytes, F.col("refers_to")).alias("refers_to"))


def _name(record_id) -> str:
    return NO_ID if record_id is None else ID_PREFIX + quote(str(record_id), safe="")


def _record(record_id, uri: str | None, payload: bytes, refers_to, date: str) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(record_id)}>", f"WARC-Target-URI: {quote(uri or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    def __init__(self, level: int):
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, record_id: str | None, record: bytes) -> None:
        self.entries.append({"record_id": record_id, "frame": len(self.frames), "frame_at": self.bytes, "at": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)

    def end_frame(self) -> None:
        if self.open:
            frame = self.press.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def whole(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table])


def write_bundles(marked: DataFrame, frame_bytes: int = 1 << 16, bundle_bytes: int = 4 << 20, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Bundles of the records of mark_revisits(), as a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        bundle = _Bundle(level)

        def flush() -> pa.RecordBatch:
            nonlocal n, bundle
            content = bundle.whole()
            row = {"bundle": [f"{part:06d}-{n:05d}"], "n_records": [len(bundle.entries)], "n_frames": [len(bundle.frames)], "content": [content], "entries": [bundle.entries]}
            n, bundle = n + 1, _Bundle(level)
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("bundle", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int64()), ("content", pa.binary()), ("entries", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            for record_id, uri, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(None if record_id is None else str(record_id), _record(record_id, uri, payload.encode("utf-8", "surrogatepass"), refers_to, date))
                if bundle.open_bytes >= frame_bytes:
                    bundle.end_frame()
                    if bundle.bytes >= bundle_bytes:
                        yield flush()
        if bundle.entries:
            yield flush()

    return written(marked.select("record_id", "uri", "payload", "refers_to").mapInArrow(run, BUNDLE_SCHEMA), "warc")


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, frame_at, at, length): where each record lies, relative to its frame."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.frame_at", "e.at", "e.length")


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, full size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the bundle's end")
    width = 12 if flags & 0x80 else 8
    size = n * width + 9
    if struct.unpack("<II", content[-size - 8 : -size]) != (SKIPPABLE, size):
        raise ValueError("the seek table's frame is damaged")
    out, at = [], 0
    for k in range(n):
        packed, full = struct.unpack_from("<II", content, len(content) - size + k * width)
        out.append((at, packed, full))
        at += packed
    return out


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at an offset of a frame, and the offset after it. A response's digest is held against its payload."""
    end = data.index(b"\r\n\r\n", at)
    head = _headers(data[at:end])
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    body = data.index(b"\r\n\r\n", start, stop) + 4
    http = _headers(data[start : body - 4])
    kind = head["warc-type"]
    payload = data[body:stop] if kind == "response" else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if payload is not None and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")
    named = lambda key: key in head and head[key] != f"<{NO_ID}>"
    name = lambda key: unquote(head[key].strip("<>").removeprefix(ID_PREFIX)) if named(key) else None
    return {"record_id": name("warc-record-id"), "uri": unquote(head["warc-target-uri"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": name("warc-refers-to"), "payload": payload}, stop + 4


_RECORDS = pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64())])


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of every bundle, frame by frame. payloads=False checks payloads but leaves them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_buffer().to_pybytes()
                for k, (start, packed, full) in enumerate(seek_table(raw)):
                    data, at, rows = press.decompress(raw[start : start + packed], max_output_size=full), 0, []
                    while at < len(data):
                        row, after = parse_record(data, at)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row | {"bundle": bundle.as_py(), "frame": k, "at": at})
                        at = after
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return bundles.select("bundle", "content").mapInArrow(run, RECORD_SCHEMA)


def fetch(bundles: DataFrame, wanted: DataFrame | None = None, id_col: str = "record_id", payloads: bool = True) -> DataFrame:
    """The records with the ids of wanted (all without it), by their frame-relative offsets: only frames that hold one are decompressed. payloads=False checks payloads but leaves them out."""
    # The places of a bundle are at most its records, which bundle_bytes bounds.
    if wanted is None:
        sought = bundles.select("bundle", "content", F.transform("entries", lambda e: F.struct(e["frame"].alias("frame"), e["at"].alias("at"))).alias("places"))
    else:
        (key,) = fresh(wanted, "wanted_id")
        ids = wanted.select(F.col(id_col).cast("string").alias(key)).distinct()
        places = index(bundles).join(ids, F.col("record_id") == F.col(key), "left_semi").groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "at"))).alias("places"))
        sought = bundles.select("bundle", "content").join(places, "bundle").select("bundle", "content", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, content, places in zip(*batch.columns, strict=True):
                raw, rows, held = content.as_buffer().to_pybytes(), [], {}
                table = seek_table(raw)
                for place in places.as_py():
                    k = place["frame"]
                    if k not in held:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                        start, packed, full = table[k]
                        rows, held = [], {k: press.decompress(raw[start : start + packed], max_output_size=full)}
                    row = parse_record(held[k], place["at"])[0]
                    if not payloads:
                        row["payload"] = None
                    rows.append(row | {"bundle": bundle.as_py(), "frame": k, "at": place["at"]})
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return sought.mapInArrow(run, RECORD_SCHEMA)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Lay the bundles out as .warc.zst files of a folder that all executors reach; returns (bundle, file). A repeated task replaces its files with equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            files = []
            for bundle, content in zip(*batch.columns, strict=True):
                file = f"{root}/{bundle.as_py()}.warc.zst"
                store.create_dir(root, recursive=True)
                with store.open_output_stream(file) as out:
                    out.write(content.as_buffer())
                files.append(file)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], names=["bundle", "file"])

    return bundles.select("bundle", "content").mapInArrow(run, "bundle string, file string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = fetch(write_bundles(mark_revisits(pages)), payloads=False)
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT DISTINCT hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (((instr('0123456789abcdef', substr(hex, (5 * (i // 4) + 1)::INT, 1)) - 1) * 65536
    + (instr('0123456789abcdef', substr(hex, (5 * (i // 4) + 2)::INT, 1)) - 1) * 4096
    + (instr('0123456789abcdef', substr(hex, (5 * (i // 4) + 3)::INT, 1)) - 1) * 256
    + (instr('0123456789abcdef', substr(hex, (5 * (i // 4) + 4)::INT, 1)) - 1) * 16
    + (instr('0123456789abcdef', substr(hex, (5 * (i // 4) + 5)::INT, 1)) - 1)) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS digest
  FROM p),
m AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN p.page_id = m.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> m.keeper THEN m.keeper END AS refers_to
FROM p JOIN b USING (hex) JOIN m USING (hex)
"""
