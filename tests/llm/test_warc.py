import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from verifold.llm import warc


def test_loser_tree_merges_like_sorted():
    rnd = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rnd.randrange(20) for _ in range(rnd.choice([0, 1, 7]))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def plain(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            d = hashlib.sha256(b).hexdigest()
            first[d] = min(first.get(d, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        revisit = len(b) >= 100 and sum((h2 or "") == (h or "") for _, _, h2 in pages) > 1 and i != first.get(d)
        out.append((i, len(b), d, "revisit" if revisit else "response", first[d] if revisit else None))
    return out


def test_round_trip_and_order(spark, tmp_path):
    rnd = random.Random(3)
    pages = []
    for i in range(300):
        url = rnd.choice(["http://a.example.com/x", "https://www.example.org/", f"http://h{i % 7}.net/p{i % 11}?q=é", None, "no scheme", "http://a.example.com/x"])
        html = rnd.choice(["", "short", "é" * 60, "<p>same page</p>\r\n\r\nWARC/1.1\r\n" * 9, f"<b>{i}</b>\n" * rnd.randrange(1, 40), None])
        pages.append((i, url, html))
    pages += [(400, "http://long.net/", "x" * 3_000_000), (401, "http://longer.net/", "y" * 17_000_000), (5, pages[5][1], pages[5][2]), (None, "http://n.net/", "<i>no id</i>" * 20)]
    df = spark.createDataFrame([(*p, "x", 0, "y") for p in pages], "page_id long, url string, html string, record_type string, payload_bytes int, _at string").repartition(5)
    index = warc.captures(df, most=2500, rows=40)
    rows = index.orderBy("merge_part", "merge_at").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=key) == sorted(plain(pages), key=key)
    order = [(r.url_key or "", r.capture_ts, -1 if r.page_id is None else r.page_id) for r in rows]
    assert order == sorted(order)
    assert len({r.archive for r in rows}) >= 15 and len({r.merge_part for r in rows}) >= 4
    assert [r.merge_at for r in rows if r.merge_part == 0] == list(range(sum(r.merge_part == 0 for r in rows)))
    assert sorted((r.url or "" for r in rows)) == sorted(u or "" for _, u, _ in pages)


def test_index_names_places_that_can_be_read_alone(spark, tmp_path):
    pages = [(i, f"http://a.b/{i % 5}", f"<p>{i % 9}\r\n\r\n</p>" * 20) for i in range(60)] + [(90, "http://big.net/", "z" * 17_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, str(tmp_path / "w"), most=1000)
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    assert len(files) > 4 and all(len(d) < 1000 + 600 for n, d in files.items() if len(d) < 10_000)
    html = {i: h.encode() for i, _, h in pages}
    for d in files.values():  # any gzip reader reads an archive whole
        assert gzip.decompress(d).startswith(b"WARC/1.1\r\n")
    for r in warc.read_runs(spark, str(tmp_path / "w")).collect():
        head, block = warc.parsed(gzip.decompress(files[r.archive][r.offset : r.offset + r.length]))
        assert head["warc-record-id"] == f"<urn:page:{r.page_id}>"
        assert block.partition(b"\r\n\r\n")[2] == (html[r.page_id] if r.record_type == "response" else b"")
    assert warc.read_runs(spark, str(tmp_path / "w")).count() == len(pages)


def test_damaged_archives_are_told(spark):
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.records(warc.member(one) * 2)) == [(0, len(warc.member(one)), {"content-length": "3"}, b"abc"), (len(warc.member(one)), len(warc.member(one)), {"content-length": "3"}, b"abc")]
    for bad in (warc.member(one)[:-9], warc.member(one[:-4] + b"xxxx"), warc.member(b"no record")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(bad))


def test_empty_table_and_url_keys(spark):
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.url_key("https://www.Example.com:8080/a?b") == "com,example:8080)/a?b"
    assert warc.url_key("http://example.com") == "com,example)/"
    assert spark.range(1).select(F.lit(1)).count() == 1
