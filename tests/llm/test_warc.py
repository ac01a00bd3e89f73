import base64
import gzip
import hashlib
import json
import os
from collections import defaultdict

import pytest

from tabtwin.llm.queries import QUERIES
from tabtwin.llm.warc import RecordReader, archive_pages, classify, normalise_warcs, read_warcs, write_warcs

DATA = "/root/testdata/sf0.01"


def brute(rows, min_bytes=0):
    same = defaultdict(list)
    for page, html in rows:
        same[(html or "").encode()].append(page)
    for page, html in rows:
        raw = (html or "").encode()
        ids = [x for x in same[raw] if x is not None]
        top = max(ids) if ids and len(raw) >= min_bytes else page
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        yield (page, len(raw), digest, *(("response", None) if page == top else ("revisit", top)))


def columns(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert columns(QUERIES["op1_warc"](spark, DATA)) == sorted(brute(rows), key=str)


ROWS = [(2**60 + 1, "a"), (1, "é\r\n\r\nWARC/1.1\r\n"), (2, None), (3, ""), (4, "é\r\n\r\nWARC/1.1\r\n"), (4, "é\r\n\r\nWARC/1.1\r\n"),
        (None, "a"), (None, "solo"), (None, "solo"), (5, "x" * 3_000_000), (6, "\x00\n"), (-3, "a")]


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_edge_cases(spark, tmp_path, min_bytes):
    df = spark.createDataFrame([(p, f"http://x/{i}\r\n y" if i % 2 else None, h, "z") for i, (p, h) in enumerate(ROWS)],
                               "page_id long, url string, html string, payload string")
    got = archive_pages(df, str(tmp_path), min_bytes=min_bytes)
    assert columns(got) == sorted(brute(ROWS, min_bytes), key=str)
    sent = {(r.page_id, r.html or "") for r in df.collect()}
    assert all((r.page_id, bytes(r.payload).decode()) in sent for r in got.collect() if r.record_type == "response")
    assert archive_pages(df.limit(0), str(tmp_path / "none")).count() == 0


def test_archives_become_members_with_an_index(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"text {i} " * 300) for i in range(50)], "page_id long, url string, html string")
    whole = write_warcs(classify(df).coalesce(2), str(tmp_path / "whole"), max_bytes=20_000)
    assert whole.count() > 4
    files = {r.path: r.records for r in normalise_warcs(whole, str(tmp_path / "members")).collect()}
    assert sum(files.values()) == 50
    for path, records in files.items():
        raw = open(path, "rb").read()
        index = [json.loads(x) for x in open(path + ".idx")]
        assert len(index) == records and sum(x["length"] for x in index) == len(raw)
        one_by_one = b"".join(gzip.decompress(raw[x["offset"]:x["offset"] + x["length"]]) for x in index)
        before = gzip.decompress(open(path.replace("/members/", "/whole/"), "rb").read())
        assert one_by_one == before
        assert [h["warc-record-id"] for h, _ in RecordReader().feed(before)] == [x["id"] for x in index]
    assert not [x for x in os.listdir(tmp_path / "members") if x.startswith("_")]
