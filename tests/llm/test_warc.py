import gzip
import hashlib
import io

import pytest

from marketloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, revisit string"


def test_round_trip(spark, tmp_path):
    big, small = "é" * 600, "a" * 999
    rows = [(i, f"http://x/{i}", big, "c", "d") for i in (3, 9, 5)] + [(i, None, small, "c", "d") for i in (1, 2)]
    rows += [(20, "http://x/\r\ny", None, None, None), (None, "u", "b" * 1000, None, None), (21, "u", "b" * 1000, None, None), (30, "u", "<p>\r\n\r\nWARC/1.1</p>" * 9000, "", "")]
    rows += [(9, "http://x/9", big, "c", "d")]
    got = warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    by = {r.page_id: r for r in got}
    assert [(by[i].record_type, by[i].refers_to) for i in (3, 5, 9, 1, 2)] == [("revisit", 9), ("revisit", 9), ("response", None), ("response", None), ("response", None)]
    assert (by[None].record_type, by[None].refers_to, by[21].record_type) == ("revisit", 21, "response")
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        assert (by[page_id].payload_bytes, by[page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if by[page_id].record_type == "response":
            assert by[page_id].payload == data
    assert by[20].url == "http://x/%0D%0Ay"


def test_one_member_per_record_and_broken_archives():
    records = [warc.page_record(i, "u", b"x" * i, None, False, "2024-01-01T00:00:00Z") for i in (1, 200_000)]
    data = b"".join(records)
    assert gzip.decompress(records[0]).startswith(b"WARC/1.1\r\n")
    assert [len(r.block) for r in warc.read_records(io.BytesIO(data))][1] > 200_000
    for cut in (data[:-3], data[: len(records[0]) + 40]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(cut)))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
