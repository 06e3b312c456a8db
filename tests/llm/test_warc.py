import base64
import hashlib

import pytest

from tablewarden.llm import warc
from tablewarden.llm.common import shared_path

INSIDE = (
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0063-8000-000000000000>\r\n"
    "Content-Length: 2\r\n\r\nhi\r\n\r\n"
)


def expected(pages):
    out, known = [], {}
    for page_id, html in pages:
        known.setdefault(html or "", []).append(page_id)
    met = set()
    for page_id, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids = known[html or ""]
        top = max((i for i in ids if i is not None), default=None)
        first = page_id == top and (page_id, html or "") not in met
        met.add((page_id, html or ""))
        out.append((page_id, len(body), digest, "response" if first else "revisit", None if first else top))
    return out


PAGES = [
    (1, "<p>a</p>"), (2, None), (3, ""), (4, "x" + INSIDE + "y" * 700 + INSIDE), (5, "WARC/1.0\r\n"), (6, "<p>a</p>"),
    (7, "\r\n\r\n" * 5), (8, INSIDE), (9, "ünïcode " * 300), (-3, "neg"), (None, "no id"), (10, "same"), (10, "same"),
    (11, "z" * 3000 + "WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 9999999\r\n\r\n"), (12, "WARC/1.0\r\n" * 200),
] + [(100 + k, f"page {k} " * k) for k in range(20)]


@pytest.mark.parametrize("split", ["128m", "600"])
def test_round_trip_with_magic_inside_payloads(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = shared_path(spark, "warc-test")
        pages = spark.createDataFrame([(i, f"http://h/{i} a", h, 5) for i, h in PAGES], "page_id long, url string, html string, sha1 int")
        warc.write_archives(pages.coalesce(2), path)
        got = [tuple(r) for r in warc.read_archives(spark, path).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=repr) == sorted(expected(PAGES), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
