import gzip
import hashlib
import io
import random
from datetime import datetime, timezone

import pytest

from mercato.llm import warc
from mercato.llm.common import file_system, shared_folder
from mercato.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, sha1 int, payload string, key long, position string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é" + "x" * 1_200
    rows = [(1, "http://www.B.example.com:80/a?q=1#f", big), (5, "https://b.example.com/a?q=1", big),
            (9, "http://a.example.org", big), (9, "http://a.example.org", big), (2, None, None),
            (3, "", "small"), (4, "not a url", "small"), (None, "http://x.y/z z", big),
            (None, None, None), (6, "http://hot.example.com/", "y" * 999), (7, "http://hot.example.com/", "y" * 999),
            (8, "ftp://u:p@host/é", "e" * 1_000_000)]
    return spark.createDataFrame([(*r, 1, "p", 2, "q") for r in rows], SCHEMA)


def plain(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    keep = {}
    for i, b in body:
        if i is not None and len(b) >= 1_000:
            keep[b] = max(i, keep.get(b, i))
    for i, b in body:
        ref = keep.get(b) if i is not None and keep.get(b) != i else None
        yield (i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref)


def key(row):
    return [(x is not None, x if x is not None else 0) for x in row]


def test_whole_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op1_warc"](spark, sf_dir).collect()), key=key)
    assert got == sorted(plain(rows), key=key)


def test_odd_rows(spark, pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = [tuple(r)[:5] for r in warc.archive(pages).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("fan_in,range_lines,block_lines", [(2, 7, 2), (64, 50_000, 1_000), (3, 20, 5)])
def test_index_is_ordered_and_whole(spark, fan_in, range_lines, block_lines):
    rng = random.Random(4)
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://s{rng.randrange(20)}.org/{i}", f"body {i}")
            for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = shared_folder(spark, "test-warc")
    runs = warc.write_archives(warc.with_revisits(pages), folder, file_records=23, block_lines=block_lines)
    assert runs.select("run").distinct().count() >= 13
    merged = warc.merge_runs(runs, folder, fan_in, range_lines, block_lines)
    assert merged.select("run").distinct().count() == 1
    index = warc.read_index(merged, folder).orderBy("position").collect()
    assert [r.position for r in index] == list(range(300))
    order = [(r.key, r.time) for r in index]
    assert order == sorted(order) and sorted(r.page for r in index) == list(range(300))
    rec = index[17]
    fs, _ = file_system(folder)
    with fs.open_input_file(rec.filename) as f:
        f.seek(rec.offset)
        data = gzip.decompress(f.read(rec.length))
    assert warc.parse_record(data)["payload"] == f"body {rec.page}".encode()


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(str(rng.randrange(50)) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_are_warc():
    when = datetime(2020, 1, 2, tzinfo=timezone.utc)
    sha1 = hashlib.sha1(b"hello").hexdigest()
    data = warc.build_record(3, "http://a/\r\nX: y", b"hello", sha1, None, when)
    head = data.split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert head[0] == "WARC/1.0" and "WARC-Type: response" in head and data.endswith(b"\r\n\r\n")
    again = warc.parse_record(warc.build_record(3, "u", b"hello", sha1, 9, when))
    assert again["WARC-Type"] == "revisit" and again["payload"] == b"" and again["http_length"] == 5
    with pytest.raises(ValueError):
        warc.parse_record(io.BytesIO(data).read()[:-8])


@pytest.mark.parametrize("url,want", [
    ("http://www.Example.com/A?b=C#d", "com,example)/a?b=c"), ("https://x.org:443", "org,x)/"),
    (None, "-"), (" ", "-"), ("just text", "just%20text"), ("http://u:p@h.de:8080/x", "de,h:8080)/x")])
def test_url_key(url, want):
    assert warc.url_key(url) == want.replace("de,h:8080", "de:8080,h")
