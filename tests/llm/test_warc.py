import hashlib
import uuid

import duckdb
import pytest

from loam.llm import warc as W
from loam.llm.common import shared_folder


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


ROWS = [
    (1, "http://www.Example.org:80/a?b=c#d", "é" * 600),
    (2, "https://example.org/a?b=c", "é" * 600),
    (3, "http://sub.example.org", "é" * 600),
    (3, "http://sub.example.org", "é" * 600),
    (4, None, None),
    (5, "no host", "short\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://example.org/a b\r\nc", "short\r\n\r\nWARC/1.1\r\n\r\n"),
    (None, "http://x.y/", "é" * 600),
    (None, "http://x.y/", "z" * 1000),
    (None, "http://x.y/", "z" * 1000),
    (9, "http://x.y/", "q" * 999),
    (8, "http://x.y/", "q" * 999),
    (10, "http://big.y/?q", "<p>" * 200_000),
]


@pytest.mark.parametrize("groups", [0, 100])
def test_round_trip(spark, monkeypatch, groups):
    monkeypatch.setattr(W, "BLOCK_LINES", 3)
    monkeypatch.setattr(W, "BROADCAST_GROUPS", groups)
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, first int")
    at = folder(spark)
    got = sorted(map(tuple, W.archive(pages, at).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        b = (html or "").encode()
        first = max((j for j, _, h in ROWS if h == html and j is not None), default=None)
        revisit = len(b) >= 1000 and first is not None and i != first
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    for url in {r[1] for r in ROWS if r[1] and " " not in r[1]}:
        same = [r for r in ROWS if r[1] and W._plain_key(r[1]) == W._plain_key(url)]
        found = W.lookup(spark, f"{at}/index", url)
        assert len(found) == len(same)
        for headers, block in found:
            if headers["WARC-Type"] == "response":
                assert W.payload_of(block) in {(r[2] or "").encode() for r in same}
    assert W.lookup(spark, f"{at}/index", "http://absent.org/") == []
    monkeypatch.setattr(W, "DIRECTORY_ROWS", 1)
    assert len(W.lookup(spark, f"{at}/index", "http://x.y/")) == 5


def test_keys(spark):
    urls = [r[1] for r in ROWS if r[1]]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", W.url_key(W.F.col("u")).alias("k")).collect()
    assert all(r.k == W._plain_key(r.u) for r in got if "\n" not in r.u)
    assert W._plain_key("http://www.Example.org:80/a?b=c#d") == "org,example)/a?b=c"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.archive(pages, folder(spark)).count() == 0


def test_broken_records():
    with pytest.raises(ValueError):
        W.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n")
    with pytest.raises(ValueError):
        W.parse(b"nothing")


def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = db.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({W.ORACLE_SQL['op8_warc']})").fetchall()
    assert sorted(map(tuple, W.op8_warc(spark, sf).collect())) == sorted(want)


ODD = ["http://u:p@e.org:8080/x", "http://e.org/a b", "http://e.org/a\tb", "http://[abc/", "http://é.example/ü?q=\U0001f600 x", "", " ", "ftp://h", "http://h?a#b#c", "//nohost", "http://www.www.x/", "HTTP://E.ORG/A", "a\nb"]


def test_keys_of_odd_urls(spark):
    got = {r.u: (r.k, r.s) for r in spark.createDataFrame([(u,) for u in ODD], "u string").select("u", W.url_key(W.F.col("u")).alias("k"), W.safe_url(W.F.col("u")).alias("s")).collect()}
    for u, (k, s) in got.items():
        assert k == W._plain_key(u) == W._plain_key(s) and not set(s) & set(map(chr, range(33)))
    assert got["http://u:p@e.org:8080/x"][0] == "org,e)/x" and got["http://e.org/a b"][0] == "org,e)/a%20b" and got["http://e.org/a\tb"][0] == "org,e)/a%09b"
    assert spark.range(1).select(W.url_key(W.F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("direct", [True, False])
def test_every_url_is_found(spark, monkeypatch, direct):
    """By the bulk lookup and one at a time, with a directory in parts, small blocks, and pages of all sizes; by ranges, or by whole files."""
    monkeypatch.setattr(W, "BLOCK_LINES", 4)
    monkeypatch.setattr(W, "DIRECTORY_ROWS", 2)
    monkeypatch.setattr(W, "PAGE_BYTES", 1500)
    monkeypatch.setattr(W, "FILE_BYTES", 9000)
    monkeypatch.setattr(W, "FILE_RECORDS", 5)
    if not direct:
        monkeypatch.setattr(W, "in_reach", lambda folder: False)
    rows = [(100 + i, u, f"page {i} of {u}" * (1 + 40 * (i % 4))) for i, u in enumerate([*ODD, *ODD, "http://hot.org/"] + ["http://hot.org/"] * 30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    at = folder(spark)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in W.archive(pages, at).collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response") for i, _, h in rows}
    lines = W.located(spark, f"{at}/index", spark.createDataFrame([("org,hot)/",), ("org,hot)/",), ("none",), (None,)], "key string"))
    assert lines.count() == 31
    for u in [*ODD, "http://hot.org/"]:
        want = sorted(h for _, v, h in rows if W._plain_key(v) == W._plain_key(u))
        assert sorted(W.payload_of(block).decode() for _, block in W.lookup(spark, f"{at}/index", u)) == want
    import glob
    import os

    assert all(os.path.getsize(f) < 25_000 for f in glob.glob(f"{at.removeprefix('file:')}/warc/part-*"))


def test_heads_of_a_file():
    record = lambda n, head: b"WARC/1.1\r\nWARC-Target-URI: u%d\r\nX: %s\r\nContent-Length: %d\r\n\r\n" % (n, b"h" * head, n) + b"x" * n + b"\r\n\r\n"
    parts = [record(n, head) for n, head in [(0, 0), (5, 200_000), (70_000, 3), (1, 1), (200_000, 0), (2, 70_000)]]
    data = b"".join(parts)
    got = list(W._heads(len(data), lambda at, n: data[at : at + n], "f"))
    assert [x[2] for x in got] == [len(x) for x in parts] and got[-1][1] + got[-1][2] == len(data) and got[1][0] == "u5"
    for wrong in (data[:-1], data + b"nothing", b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(W._heads(len(wrong), lambda at, n: wrong[at : at + n], "f"))
