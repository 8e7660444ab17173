import base64
import hashlib

import pytest
import zstandard

from skein.llm import warc

PAGES = [(5, "http://a/\nb", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "u", "é🙂" * 20_000), (6, "u", "x\r\n\r\nWARC/1.1"), (3, "u", "same"), (None, "u", "same")]
SCHEMA = "page_id long, url string, html string, archive string"


def pages(spark):
    return spark.createDataFrame([(*p, "extra") for p in PAGES], SCHEMA)


def test_round_trip_equals_contract(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark)).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "response" if page == first else "revisit", None if page == first else first))
    assert got == sorted(want, key=str)


def test_seek_table_index_and_fetch(spark):
    bundles = warc.write(warc.mark(pages(spark)).coalesce(1), frame_bytes=50, bundle_bytes=3000).cache()
    rows = bundles.collect()
    assert len(rows) > 1
    for row in rows:
        table = warc.frames(row.archive)
        whole = b"".join(warc.read_frame(row.archive, k, table) for k in range(len(table)))
        assert zstandard.ZstdDecompressor().stream_reader(row.archive, read_across_frames=True).read() == whole  # a plain reader skips the table
        for r in row.records:
            head, _, end = warc.parse(warc.read_frame(row.archive, r.frame), r.offset)
            assert head["WARC-Record-ID"] == f"<{r.record_id}>" and end - r.offset == r.length
    got = {r.page_id: r.payload for r in warc.fetch(bundles, spark.createDataFrame([(4,), (6,), (77,)], "page_id long")).collect()}
    assert got == {4: ("é🙂" * 20_000).encode(), 6: b"x\r\n\r\nWARC/1.1"}


def test_small_payloads_are_responses_and_empty_table(spark):
    kinds = {(r.page_id, r.record_type) for r in warc.round_trip(pages(spark), min_bytes=1).collect() if r.page_id in (1, 2)}
    assert kinds == {(1, "response"), (2, "response")}
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_an_index_that_is_wrong_is_noticed(spark):
    bundles = warc.write(warc.mark(pages(spark)).coalesce(1))
    for broken in ("slice(records, 2, 100)", "transform(records, r -> named_struct('record_id', 'urn:page:0', 'frame', r.frame, 'offset', r.offset, 'length', r.length))"):
        with pytest.raises(Exception, match="index"):
            warc.read(bundles.selectExpr("archive", f"{broken} AS records")).collect()


def test_payload_longer_than_a_bundle(spark):
    long = "abc " * 3_000_000  # 12 MB
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(spark.createDataFrame([(1, "u", long), (2, "u", "x"), (3, "u", long)], "page_id long, url string, html string")).collect()}
    assert got == {1: (12_000_000, "response"), 2: (1, "response"), 3: (12_000_000, "revisit")}
