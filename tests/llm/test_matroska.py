import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import matroska as M

DATA = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.integers(1, 300), st.integers(1, 8), st.integers(1, 9))
def test_round_trip(payload, frame, lace, blocks):
    data = M.mux(payload, frame, lace, blocks)
    found = M.packets(data)
    assert b"".join(data[p["start"] : p["start"] + p["size"]] for p in found) == payload
    at = 0
    for p in found:
        if p["lace_index"] == 0:
            assert p["timestamp"] == at
        at += p["size"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=2, max_size=20), st.sampled_from(["xiph", "ebml"]))
def test_lacing(frames, kind):
    body = M.vint(5) + b"\x00\x07" + bytes([M.LACING.index(kind) << 1]) + M.lace_frames(frames, kind)
    track, time, _, found = M.block_frames(body, 0, len(body))
    assert (track, time) == (5, 7) and [body[a : a + n] for a, n in found] == frames


def test_unknown_sizes_groups_and_damage():
    block = M.element(M.BLOCK, M.vint(1) + b"\x00\x01\x00" + b"abc")
    group = M.element(M.BLOCK_GROUP, block + M.element(M.REFERENCE_BLOCK, b"\x01"))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M._uint(M.TIMESTAMP, 9) + group
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M._INFO + cluster + cluster
    rows = M.packets(data)
    assert [(r["timestamp"], r["key"], data[r["start"] : r["start"] + r["size"]], r["cluster"]) for r in rows] == [(10, False, b"abc", 0), (10, False, b"abc", 1)]
    whole = M.mux(bytes(range(256)) * 40)
    with pytest.raises(ValueError):
        M.packets(whole[:-3])
    assert M.packets(M.mux(b"")) == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = M.query(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for r in M.store(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        told = next(x for x in rows if x.doc_id == r.doc_id)
        payload, packets, clusters, last = naive_read(bytes(r.media))
        assert payload.rstrip(b"\0") == docs[r.doc_id].encode().rstrip(b"\0")
        assert (told.media_bytes, told.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert told.feature == f"packets={packets};clusters={clusters};end={last};" + naive_feature(payload)


def naive_number(data, at):
    """A variable-length number by its bits."""
    bits = f"{data[at]:08b}"
    width = bits.index("1") + 1
    rest = bits[width:] + "".join(f"{b:08b}" for b in data[at + 1 : at + width])
    return int(rest, 2), at + width


def naive_children(data):
    """[(id in hex, body)] of a master element's body."""
    out, at = [], 0
    while at < len(data):
        width = f"{data[at]:08b}".index("1") + 1
        name = data[at : at + width].hex()
        size, body = naive_number(data, at + width)
        out.append((name, data[body : body + size]))
        at = body + size
    return out


def naive_read(data):
    """Payload, packets, clusters and last timestamp of a file of SimpleBlocks."""
    (segment,) = [body for name, body in naive_children(data) if name == "18538067"]
    payload, packets, clusters, last = b"", 0, 0, 0
    for name, cluster in naive_children(segment):
        if name != "1f43b675":
            continue
        clusters += 1
        parts = naive_children(cluster)
        base = next(int.from_bytes(b, "big") for n, b in parts if n == "e7")
        for name2, block in parts:
            if name2 != "a3":
                continue
            _, at = naive_number(block, 0)
            last = max(last, base + int.from_bytes(block[at : at + 2], "big", signed=True))
            lacing, at = block[at + 2] >> 1 & 3, at + 3
            frames = 1
            if lacing:
                frames, at = block[at] + 1, at + 1
            if lacing == 1:
                for _ in range(frames - 1):
                    while block[at] == 255:
                        at += 1
                    at += 1
            elif lacing == 3:
                for _ in range(frames - 1):
                    _, at = naive_number(block, at)
            packets += frames
            payload += block[at:]  # frames follow each other, whatever their sizes
    return payload, packets, clusters, last


def naive_feature(payload):
    x = [b - 128 for b in payload]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    bins = [sum(b // 16 == k for b in payload) for k in range(16)]
    return f"mean={sum(x) / len(x):.6f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.6f};zcr={crossings / max(1, len(x) - 1):.6f};hist={','.join(map(str, bins))}"


def test_cases(spark):
    long = "".join(random.Random(1).choices("abc é\n", k=100_000))
    docs = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (None, long, "m"), (3, long, "m"), (3, long, "m")], "doc_id bigint, text string, media string")
    rows = M.describe(M.store(docs)).collect()
    assert [r.payload_bytes % 64 for r in rows] == [0] * 5 and {r.payload_bytes for r in rows if r.n_bytes == 0} == {64}
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes}) == 1
    table = M.packet_table(M.store(docs))
    assert table.where("doc_id = 3").agg({"size": "sum"}).first()[0] == 2 * max(r.payload_bytes for r in rows)
    assert M.describe(M.store(docs.limit(0))).count() == 0


def test_damaged_files_are_told(spark):
    whole = M.mux(bytes(range(256)) * 40)
    lace = M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\x00\x00\x02\x05\xff")
    short = M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\x00")
    bad = [whole[:-3], b"\x00", M._HEAD + M.element(M.SEGMENT, M.element(M.CLUSTER, M._uint(M.TIMESTAMP, 0) + lace)), M._HEAD + M.element(M.SEGMENT, M.element(M.CLUSTER, short)), None]
    for data in bad[:-1]:
        with pytest.raises(ValueError):
            M.packets(data)
    df = spark.createDataFrame([(k, 1, data) for k, data in enumerate([*bad, whole])], "doc_id bigint, n_bytes bigint, media binary")
    rows = sorted(M.describe(df).collect())
    assert [r.error is None for r in rows] == [False] * 5 + [True] and rows[0].feature is None and rows[5].payload_bytes == 256 * 40
    assert M.packet_table(df).select("doc_id").distinct().count() == 1
    assert M.describe(M.store(df.select(M.F.lit("t").alias("media"), "doc_id"), "doc_id", "media")).columns[0] == "doc_id"
    assert M.describe(M.store(df.selectExpr("doc_id as n_bytes", "'t' as text"), "n_bytes"), "n_bytes").where("n_bytes_ = 1 and payload_bytes = 64").count() == 6
