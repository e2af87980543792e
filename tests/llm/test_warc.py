"""Archives and their index: what is written is found and read back."""

import hashlib
import re

import pytest
from oracle import differences
from pyspark.sql import functions as F

from quillon.llm import warc as W
from quillon.llm.queries import ORACLES, op11_warc, op12_hard_negatives

SCHEMA = "page_id long, url string, html string, file string, Payload string"
TRICK = "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4
SAME = "<p>the same page, long enough to be worth a revisit</p>" * 3
ODD = [
    (1, "http://a.example.org/x?q=1#top", "<p>one</p>"),
    (2, "https://A.example.org:8080/x?q=1", SAME),
    (5, "https://b.example.org", SAME),
    (4, "ftp://user:pw@b.example.org/y z\r\nX-Page-ID: 99", SAME),
    (None, "http://c.example.org/", SAME),
    (2, "https://A.example.org:8080/x?q=1", SAME),
    (7, None, TRICK),
    (8, "no url at all", TRICK),
    (9, "", None),
    (10, "http://d.example.org/\U0001f600é", ""),
    (11, "http://d.example.org/long", "ä\U0001f600\r\n" * 400_000),
    (None, None, None),
    (12, "http://e.example.org/", "x" * 99),
    (13, "http://e.example.org/", "x" * 99),
    (14, "http://e.example.org/", "y" * 100),
    (15, "http://e.example.org/", "y" * 100),
]


def expected(rows):
    firsts: dict = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            firsts[html] = min(i, firsts.get(html, i))
    out = []
    for i, _, html in rows:
        data, first = (html or "").encode(), firsts.get(html)
        again = first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", "p") for r in rows], SCHEMA).repartition(3)


def read_back(store, given):
    wanted = given.select(W.surt(W.uri_of(F.col("url"))).alias("surt"), "page_id")
    got = store.captures(wanted, on=("surt", "page_id")).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr), got


def test_odd_pages_round_trip(spark, tmp_path):
    given = pages(spark, ODD)
    store = W.Store.made(given, f"file://{tmp_path}/store")
    found, rows = read_back(store, given)
    assert found == expected(ODD)
    stored = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert all(stored[d] == (h or "").encode() for _, _, h in ODD for d in [hashlib.sha256((h or "").encode()).hexdigest()])
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_small_blocks_windows_and_directory_parts(spark, tmp_path, monkeypatch):
    for name, value in {"BLOCK_ENTRIES": 2, "DIRECTORY_ROWS": 3, "WINDOW": 200, "SECTION": 500, "BROADCAST_ROWS": 0}.items():
        monkeypatch.setattr(W, name, value)
    rows = ODD + [(100 + k, f"http://h{k % 5}.example.net/{k % 7}", f"page {k % 11} " * 20) for k in range(60)]
    given = pages(spark, rows)
    found, _ = read_back(W.Store.made(given, str(tmp_path / "store")), given)
    assert found == expected(rows)


def test_index_is_sorted_sparse_and_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 10)
    rows = [(k, f"http://host{k % 9}.example.net/p{k % 50}", f"<p>{k}</p>") for k in range(200)]
    store = W.Store.made(pages(spark, rows), str(tmp_path / "store"))
    directory = spark.read.parquet(f"{store.index}/directory").orderBy("first", "block").collect()
    assert sum(r.entries for r in directory) == 200 and all(r.entries <= 10 for r in directory)
    assert all(a.last <= b.first for a, b in zip(directory, directory[1:]))
    wanted = spark.createDataFrame([("net,example,host3)/p3",), ("net,example,host3)/none",), ("zz",), ("",)], "surt string")
    hits = W._searched(wanted, directory).distinct().count()
    assert 1 <= hits <= 5 < len(directory)
    assert {r.page_id for r in store.captures(wanted).collect()} == {k for k in range(200) if k % 9 == 3 and k % 50 == 3}
    assert store.captures(wanted.where("surt = 'zz'")).collect() == []


def test_archives_are_warc_records_one_after_another(spark, tmp_path):
    W.write_archives(pages(spark, ODD), str(tmp_path / "a"))
    n = 0
    for path in (tmp_path / "a").glob("part-*"):
        data, at = path.read_bytes(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at) + 4
            length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:end]).group(1))
            assert data[end + length : end + length + 4] == b"\r\n\r\n"
            at, n = end + length + 4, n + 1
    assert n == len(ODD)


def test_record_that_does_not_hold_what_it_states_is_refused():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: %d\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    with pytest.raises(ValueError, match="does not hold"):
        W.capture(head % len(block) + block, True)


@pytest.mark.parametrize("url,key", [("http://a.B.org/x#y", "org,b,a)/x"), ("https://u:p@a.org:80/x?q=/#z", "org,a)/x?q=/"), ("http://a.org", "org,a)/"), ("http://a.org?q", "org,a)/?q"), ("plain", ")/plain"), (None, ")/")])
def test_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(W.surt(W.uri_of(F.col("url")))).first()[0] == key


def test_empty_table(spark, tmp_path):
    given = pages(spark, ODD).where("false")
    assert read_back(W.Store.made(given, str(tmp_path / "store")), given)[0] == []


def test_queries_equal_their_sql(spark, sf_dir):
    assert differences(op11_warc(spark, sf_dir), ORACLES["op11_warc"], sf_dir) == []
    assert differences(op12_hard_negatives(spark, sf_dir), ORACLES["op12_hard_negatives"], sf_dir) == []
