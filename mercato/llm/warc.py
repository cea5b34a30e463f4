"""WARC archives and their globally ordered capture index (operator 1).

``write_archives`` turns each page into one WARC record (a gzip member of its
own) and, for each archive file, writes a *run*: its captures as text lines
sorted by URL key and timestamp, in compressed blocks.  ``merge_runs`` is an
external merge: a loser tree merges up to ``fan_in`` runs at a time, block by
block, until one ordered index is left.  Each pass is cut into key ranges
that are merged in separate tasks; a range may begin inside the captures of one
URL, so a URL with very many captures is spread like any others.  A merging
task holds one block of each run.

Of pages with equal payloads of at least ``min_revisit`` bytes the one with
the largest id is a response and the others are revisit records that refer to
it.  Payloads are equal if their SHA-1, length and a second hash are.

Defined cases: a null payload is empty; a null or odd URL has a key too
(``-`` or its text); pages without an id are always responses; rows that
share the largest id are all responses; no rows give no files and no result
rows; only the id, URL and payload columns are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import file_system, shared_folder, stored

#: Captures in a block of a run; an archive file is closed beyond these.
BLOCK_LINES, FILE_BYTES, FILE_RECORDS = 1_000, 256 << 20, 100_000
#: Key ranges of one merge pass, at most, captures a range should hold, and blocks sampled
#: to choose the ranges.
MAX_RANGES, RANGE_LINES, SAMPLE_BLOCKS = 4_096, 50_000, 65_536
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BLOCKS = "run string, first string, last string, n long, path string, at long, size long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query."""
    if not url or not url.strip():
        return "-"
    text = re.sub(r"\s", "%20", url.strip().lower())
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", text)
    if not m:
        return text
    host = re.sub(r":(80|443)?$", "", m[1].rpartition("@")[2])
    host = re.sub(r"^www\d*\.", "", host)
    path = m[2] if m[2].startswith("/") else "/" + m[2]
    return ",".join(reversed(host.split("."))) + ")" + path


def record_id(page_id: int | None, offset: int, name: str) -> str:
    known = f"page:{page_id}" if page_id is not None else f"{name}:{offset}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, known)}>"


def build_record(page_id, url, payload: bytes, sha1: str, refers_to, when: datetime,
                 name: str = "", offset: int = 0) -> bytes:
    """One WARC/1.0 record.  A revisit keeps the HTTP header, not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", record_id(page_id, offset, name)),
            ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
            ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
            ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, 0, "")),
                 ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    head += [("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields of a record, its HTTP header and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("record cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    return fields | {"payload": payload, "http_length": length}


def _write_run(fs, path: str, lines: list[str], block_lines: int) -> list[dict]:
    """Write sorted lines as compressed blocks; one row for each block."""
    rows, at = [], 0
    with fs.open_output_stream(path) as out:
        for k in range(0, len(lines), block_lines):
            part = lines[k:k + block_lines]
            data = zlib.compress("\n".join(part).encode(), 1)
            out.write(data)
            rows.append({"run": path, "first": part[0], "last": part[-1], "n": len(part),
                         "path": path, "at": at, "size": len(data)})
            at += len(data)
    return rows


def _frame(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


BLOCK_SCHEMA = pa.schema([("run", pa.string()), ("first", pa.string()), ("last", pa.string()),
                          ("n", pa.int64()), ("path", pa.string()), ("at", pa.int64()),
                          ("size", pa.int64())])


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit: int = 1_000) -> DataFrame:
    """(id, url, payload, sha1, refers_to) for each page."""
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
            .withColumn("sha1", F.sha1("payload"))
            .withColumn("check", F.xxhash64("payload", F.length("payload"))))
    equal = stored(rows.where((F.length("payload") >= min_revisit) & F.col("id").isNotNull())
                   .groupBy("sha1", "check")
                   .agg(F.max("id").alias("keeper"), F.min("id").alias("other"))
                   .where("keeper != other").drop("other"), "warc-equal")
    refers = F.when((F.col("id") != F.col("keeper")), F.col("keeper"))
    return (rows.join(equal, ["sha1", "check"], "left")
            .select("id", "url", "payload", "sha1", refers.alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES,
                   file_records: int = FILE_RECORDS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the rows of :func:`with_revisits` to archives under ``folder``; returns
    the stored block table of their runs.  The capture time is the id in seconds after
    ``EPOCH``, as pages carry none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        out, lines, at, path = None, [], 0, ""

        def close():
            nonlocal out, lines
            out.close()
            rows = _write_run(fs, path.replace(".warc.gz", ".run"), sorted(lines), block_lines)
            out, lines = None, []
            return _frame(rows, BLOCK_SCHEMA)

        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                when = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))
                data = gzip.compress(build_record(page_id, url, payload, sha1, refers_to, when,
                                                  path, at), 6, mtime=0)
                out.write(data)
                entry = {"url": url, "digest": sha1, "page": page_id, "offset": at,
                         "length": len(data), "filename": path,
                         "type": "response" if refers_to is None else "revisit"}
                lines.append(f"{url_key(url)} {when:%Y%m%d%H%M%S} {json.dumps(entry)}")
                at += len(data)
                if at >= file_bytes or len(lines) >= file_records:
                    yield close()
        if out is not None:
            yield close()

    return stored(pages.select("id", "url", "payload", "sha1", "refers_to").mapInArrow(run, BLOCKS),
                  "warc-runs")


class LoserTree:
    """Merges sorted iterators.  Each inner node keeps the loser of the match
    below it; after the winner is taken only its path is replayed."""

    def __init__(self, streams: list[Iterator[str]]):
        self.streams = streams
        self.k = max(1, len(streams))
        self.head = [next(s, None) for s in streams] or [None]
        self.loser = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        """Winner of the subtree; leaves are nodes k .. 2k - 1."""
        todo, won = [(node, False)], {}
        while todo:
            at, ready = todo.pop()
            if at >= self.k:
                won[at] = at - self.k
            elif not ready:
                todo += [(at, True), (2 * at, False), (2 * at + 1, False)]
            else:
                a, b = won.pop(2 * at), won.pop(2 * at + 1)
                won[at], self.loser[at] = (a, b) if self._less(a, b) else (b, a)
        return won[node]

    def __iter__(self) -> Iterator[str]:
        while self.head[self.winner] is not None:
            w = self.winner
            yield self.head[w]
            self.head[w] = next(self.streams[w], None)
            at = (w + self.k) // 2
            while at:
                if self._less(self.loser[at], w):
                    self.loser[at], w = w, self.loser[at]
                at //= 2
            self.winner = w


def _lines(fs, blocks: list[tuple[str, int, int]], low: str, high: str | None) -> Iterator[str]:
    """The lines of one run's blocks that lie in [low, high), one block in memory."""
    for path, at, size in blocks:
        with fs.open_input_file(path) as stream:
            stream.seek(at)
            part = zlib.decompress(stream.read(size)).decode().split("\n")
        start = bisect.bisect_left(part, low)
        end = len(part) if high is None else bisect.bisect_left(part, high)
        yield from part[start:end]


def _merge_pass(blocks: DataFrame, folder: str, range_lines: int,
                block_lines: int) -> DataFrame:
    """Merge the runs of each group into one run, range by range."""
    spark = blocks.sparkSession
    totals = {r.group: r.n for r in blocks.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    width = max(range_lines, -(-sum(totals.values()) // MAX_RANGES))
    # bounds of about equal ranges, from a sample of the blocks; any bounds give the same index
    sample: dict[int, list[str]] = {}
    for r in (blocks.select("group", "first").orderBy(F.xxhash64("run", "first", "at"))
              .limit(SAMPLE_BLOCKS).collect()):
        sample.setdefault(r.group, []).append(r.first)
    bounds = {}
    for group, keys in sample.items():
        ranges, keys = max(1, totals[group] // width), sorted(set(keys))
        picked = {keys[k * len(keys) // ranges] for k in range(1, ranges)}
        bounds[group] = sorted(picked - {keys[0]})

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            first = [bisect.bisect_right(bounds.get(g, []), x) for g, x in zip(f["group"], f["first"])]
            last = [bisect.bisect_right(bounds.get(g, []), x) for g, x in zip(f["group"], f["last"])]
            f = f.assign(range=[list(range(a, b + 1)) for a, b in zip(first, last)])
            yield f.explode("range").astype({"range": "int64"})

    def merge(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        group, at_range = int(key[0]), int(key[1])
        lows = bounds.get(group, [])
        low = lows[at_range - 1] if at_range else ""
        high = lows[at_range] if at_range < len(lows) else None
        fs, base = file_system(folder)
        own = own.sort_values(["run", "first", "at"])
        streams = [_lines(fs, list(zip(g["path"], g["at"].astype(int), g["size"].astype(int))),
                          low, high) for _, g in own.groupby("run")]
        path, at, rows, part = f"{base}/{uuid.uuid4().hex}.run", 0, [], []
        with fs.open_output_stream(path) as out:
            def put():
                nonlocal at, part
                data = zlib.compress("\n".join(part).encode(), 1)
                out.write(data)
                rows.append((str(group), part[0], part[-1], len(part), path, at, len(data)))
                at, part = at + len(data), []

            for line in LoserTree(streams):
                part.append(line)
                if len(part) == block_lines:
                    put()
            if part:
                put()
        return pd.DataFrame(rows, columns=[f.name for f in BLOCK_SCHEMA])

    fields = "group long, range long, " + BLOCKS
    dealt = blocks.select("group", F.lit(0).cast("long").alias("range"), *BLOCK_SCHEMA.names) \
        .mapInPandas(deal, fields)
    return stored(dealt.groupBy("group", "range").applyInPandas(merge, BLOCKS), "warc-merge")


def merge_runs(blocks: DataFrame, folder: str, fan_in: int = 64, range_lines: int = RANGE_LINES,
               block_lines: int = BLOCK_LINES) -> DataFrame:
    """Merge all runs into one; returns its block table, whose ``first`` column
    orders the blocks and so all captures."""
    while True:
        runs = blocks.select("run").distinct()
        n_groups = max(1, -(-runs.count() // fan_in))
        # one row for each run
        number = runs.withColumn("group", F.floor((F.row_number().over(Window.orderBy("run")) - 1)
                                                  / fan_in).cast("long"))
        blocks = _merge_pass(blocks.join(number, "run"), folder, range_lines, block_lines)
        if n_groups == 1:
            return blocks


def read_index(blocks: DataFrame, folder: str) -> DataFrame:
    """(position, key, time, url, page, type, filename, offset, length): the captures in
    global order."""
    # a file holds one key range: sums over files (at most MAX_RANGES rows), then within each
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = (blocks.groupBy("path").agg(F.sum("n").alias("n"), F.min("first").alias("low"))
             .withColumn("base", F.coalesce(F.sum("n").over(earlier(Window.orderBy("low"))), F.lit(0))))
    own = F.sum("n").over(earlier(Window.partitionBy("path").orderBy("at")))
    placed = stored(blocks.withColumn("own", F.coalesce(own, F.lit(0)))
                    .join(files.select("path", "base"), "path")
                    .withColumn("start", F.col("base") + F.col("own")), "warc-placed")
    schema = pa.schema([("position", pa.int64()), ("key", pa.string()), ("time", pa.string()),
                        ("url", pa.string()), ("page", pa.int64()), ("type", pa.string()),
                        ("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, at, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for k, line in enumerate(_lines(fs, [(path, at, size)], "", None)):
                    key, time, entry = line.split(" ", 2)
                    rows.append(json.loads(entry) | {"position": start + k, "key": key, "time": time})
                yield _frame(rows, schema)

    n = max(1, placed.count() // 8)
    return (placed.repartition(n, "path", "at").select("path", "at", "size", "start")
            .mapInArrow(run, "position long, key string, time string, url string, page long, "
                        "type string, filename string, offset long, length long"))


def read_archives(index: DataFrame, folder: str, n_files: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, capture_time,
    position): each capture of the index read from its archive, checked against
    its digest."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url_key", pa.string()),
                        ("capture_time", pa.string()), ("position", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        name, stream = None, None
        for batch in batches:
            rows = []
            for path, offset, length, key, time, position in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if stream is not None:
                        stream.close()
                    name, stream = path, fs.open_input_file(path)
                stream.seek(offset)
                rec = parse_record(gzip.decompress(stream.read(length)))
                digest = base64.b32decode(rec["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if rec["WARC-Type"] == "response" and (
                        hashlib.sha1(rec["payload"]).hexdigest() != digest
                        or len(rec["payload"]) != rec["http_length"]):
                    raise ValueError(f"payload at {path}:{offset} does not match its digest")
                page, refers = rec.get("X-Page-Id"), rec.get("X-Refers-To-Page")
                rows.append({"page_id": page and int(page), "payload_bytes": rec["http_length"],
                             "payload_digest": digest, "record_type": rec["WARC-Type"],
                             "refers_to": refers and int(refers), "url_key": key,
                             "capture_time": time, "position": position})
            yield _frame(rows, schema)
        if stream is not None:
            stream.close()

    return (index.select("filename", "offset", "length", "key", "time", "position")
            .repartition(max(1, n_files), "filename").sortWithinPartitions("filename", "offset")
            .mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, "
                        "record_type string, refers_to long, url_key string, "
                        "capture_time string, position long"))


def archive(pages: DataFrame, min_revisit: int = 1_000, fan_in: int = 64) -> DataFrame:
    """Write the archives of ``pages``, merge their index, and read all back."""
    folder = shared_folder(pages.sparkSession, "warc")
    runs = write_archives(with_revisits(pages, min_revisit=min_revisit), folder)
    n_files = runs.select("run").distinct().count()
    merged = merge_runs(runs, folder, fan_in)
    return read_archives(read_index(merged, folder), folder, n_files)
