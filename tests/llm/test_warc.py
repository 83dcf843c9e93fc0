import zstandard

from quaymark.llm import warc

DATA = "/root/testdata/sf0.001"


def test_query_against_sql(spark, same):
    same(warc.query(spark, DATA), warc.SQL)


def test_round_trip_and_fetch(spark):
    long = "x<" * 200_000
    rows = [(1, "http://a/ä b", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u\r\nX: y", "ünï 日本"), (None, "u", "only null"), (7, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    bundles = warc.write_bundles(warc.mark_revisits(pages), frame_bytes=200, bundle_bytes=300)
    assert bundles.count() > 1
    got = {r.record_id: r for r in warc.read_bundles(bundles).collect()}
    assert len(got) == 8
    assert got["5"].payload == long.encode() and got["6"].payload.decode() == "ünï 日本" and got["1"].uri == "http://a/ä b"
    assert (got["1"].record_type, got["1"].refers_to, got["1"].payload, got["1"].payload_bytes) == ("revisit", "7", None, 4)
    assert got["7"].record_type == "response" and got["3"].refers_to == "4" and got["4"].payload == b""
    assert got[None].record_type == "response"
    some = warc.fetch(bundles, spark.createDataFrame([(5,), (2,), (99,)], "record_id bigint")).collect()
    assert {r.record_id: r.payload for r in some} == {"5": long.encode(), "2": None}
    assert sorted(warc.fetch(bundles).collect(), key=str) == sorted(warc.read_bundles(bundles).collect(), key=str)
    for r in bundles.collect():
        plain = zstandard.ZstdDecompressor()
        for start, packed, full in warc.seek_table(r.content):
            assert len(plain.decompress(r.content[start : start + packed])) == full


def test_min_bytes_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    got = sorted((r.record_id, r.refers_to) for r in warc.mark_revisits(pages, min_bytes=3).collect())
    assert sorted(got, key=str) == sorted([(1, None), (2, None), (3, 4), (4, None), (4, None)], key=str)
    empty = warc.write_bundles(warc.mark_revisits(pages.limit(0)))
    assert warc.read_bundles(empty).count() == 0 and warc.index(empty).count() == 0
    bundles = warc.write_bundles(warc.mark_revisits(pages))
    files = warc.export_files(bundles, f"file://{tmp_path}").collect()
    assert all((tmp_path / f"{r.bundle}.warc.zst").stat().st_size > 0 for r in files)


def test_empty_ids(spark):
    pages = spark.createDataFrame([("", "u", "a"), (None, "u", "a"), (None, "u", "b"), ("x", "u", "")], "page_id string, url string, html string")
    got = sorted(((r.record_id, r.record_type, r.refers_to) for r in warc.fetch(warc.write_bundles(warc.mark_revisits(pages))).collect()), key=str)
    assert got == sorted([("", "response", None), (None, "revisit", ""), (None, "response", None), ("x", "response", None)], key=str)
