"""WARC archives of pages, and their capture index by external merge.

A record is its header, its block and the two CRLF that end it, compressed as a gzip member of its own; an archive is a
row of such members, closed at a number of bytes, so that the index names places that a reader can seek. Archives are
written by Spark's text writer, so wherever Spark can write: an archive is one line of it, whose separator is the zero
byte that every gzip member below 16 MB ends with. They are read back as whole files and cut member by member. Each
archive gives an index run sorted by (URL key, timestamp, page); runs are dealt by key ranges of bounded size, each task
gets the slices of the runs one after the other from Spark's sort, which spills, and merges them with a loser tree, so
that the parts in order hold the captures of all URLs in global order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen, shared_folder

LEAST_BYTES = 100
CRLF2 = "\r\n\r\n"
#: Seconds since 1970 of page 0's capture where a table has no capture times.
EPOCH = 1_704_067_200
SALTS = 32
#: An archive is closed at so many compressed bytes; a range of the merge has about so many captures.
ARCHIVE_BYTES, MERGE_ROWS = 16_000_000, 200_000
CHUNK = 1 << 16

INDEX = "url_key string, capture_ts string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"

INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def url_key(url: str) -> str:
    """A sortable key: host labels reversed, then port and the rest; scheme and a leading www. are dropped."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(.*)", url, re.S)
    if not m:
        return url
    host, colon, port = m[1].rpartition("@")[2].lower().partition(":")
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + colon + port + ")" + (m[2] or "/")


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, record_type, refers_to) and _at, if pages has it.

    Payloads of one digest may be a third of all rows, so the digests that occur twice are joined back under a salt.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = [c for c in ("page_id", "url", "html", "_at") if c in pages.columns]
    rows = pages.select(*own, F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    many = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = many.select(F.col("payload_digest").alias("_d"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(many, (F.col("payload_digest") == F.col("_d")) & (F.col("_salt") == F.col("_s")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_d", "_s", "_first", "_salt")


def record(row: DataFrame) -> Column:
    """The text of a WARC record but for the two CRLF at its end."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    date = F.date_format(F.col("_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.coalesce("html", F.lit(""))))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "), date,
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), plain(F.col("url")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF2),
    ]
    return F.concat(*head, block)


def member(data: bytes, level: int = 1) -> bytes:
    """data as gzip that ends with a zero byte: from 16 MB on, where the length's last byte isn't zero, an empty member follows."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + member(b"")


def archives(most: int):
    """Records to archives without their last byte, which is zero: gzip members until there are `most` bytes of them."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            for r in x.column(0):
                held.append(member(r.as_py() + CRLF2.encode()))
                size += len(held[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], schema=schema)

    return run


def write_archives(pages: DataFrame, path: str, most: int = ARCHIVE_BYTES, least: int = LEAST_BYTES, ts_col: str | None = None) -> None:
    """Write a record per page to archives of some `most` bytes, more only where a single record has more.

    Of pages with equal payloads of at least `least` bytes, the one with the smallest page_id is a response and the
    others revisit it. A null html is an empty payload; a null url gives a record without a target; a null page_id an
    empty record id; rows that repeat the smallest page_id are all responses. Line breaks in a url become spaces. Other
    columns are not read; no pages give no archives.
    """
    at = F.col(ts_col).cast("timestamp") if ts_col else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)))
    rows = decided(pages.select("page_id", "url", "html", at.alias("_at")), least)
    packed = rows.select(record(rows).cast("binary").alias("value")).mapInArrow(archives(most), "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive; an empty one belongs to the one before it."""
    view, at, held = memoryview(data), 0, None
    while at < len(data):
        d, to, out = zlib.decompressobj(31), at, []
        while not d.eof:
            if to >= len(data):
                raise ValueError(f"the member at byte {at} doesn't end")
            out.append(d.decompress(view[to : to + CHUNK]))
            to = min(len(data), to + CHUNK)
        to -= len(d.unused_data)
        content = b"".join(out)
        if content or held is None:
            if held:
                yield held
            held = (at, to - at, content)
        else:
            held = (held[0], to - held[0], held[2])
        at = to
    if held:
        yield held


def parsed(content: bytes, at: int = 0) -> tuple[dict, bytes]:
    """Headers and block of a record, which must end where its length says."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"WARC/") or end < 0:
        raise ValueError(f"no record at byte {at}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in content[:end].decode("utf-8").split("\r\n")[1:])}
    stop = end + 4 + int(headers["content-length"])
    if content[stop:] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} doesn't end where its length says")
    return headers, content[end + 4 : stop]


def records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, block) of each record of an archive; offset and length are of its compressed bytes."""
    for at, length, content in members(data):
        yield at, length, *parsed(content, at)


def index_entry(archive: str, at: int, length: int, head: dict, block: bytes) -> tuple:
    """An index row of a record; the payload of a response is read whole and must have the digest that its header names."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    said = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    if head["warc-type"] == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a damaged payload at byte {at} of {archive}")
    number = lambda x: int(x) if (x := head.get(x, "").strip("<>").removeprefix("urn:page:")) else None
    url = head.get("warc-target-uri")
    stamp = re.sub(r"\D", "", head["warc-date"])
    return None if url is None else url_key(url), stamp, number("warc-record-id"), url, head["warc-type"], digest, said, number("warc-refers-to"), archive, at, length


def order(row: tuple) -> tuple:
    """Captures in order: URL key (none first), timestamp, page, place."""
    return row[0] or "", row[1], -1 if row[2] is None else row[2], row[8], row[9]


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives below path: of each file a run, sorted by order()."""
    schema = _schema()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for name, content in zip(x.column(0), x.column(1)):
                data, archive = content.as_py(), name.as_py().rpartition("/")[2]
                yield _batch(sorted((index_entry(archive, *r) for r in records(data)), key=order), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, INDEX)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; an empty run comes last, and a tie goes to the lower run."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:  # the first to come waits here
                self.loser[node] = winner
                return
            if self._before(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        while self.k and (top := self.loser[0] if self.k > 1 else 0) >= 0 and self.heads[top] is not None:
            yield self.heads[top]
            self.heads[top] = head = next(self.runs[top], None)
            self.keys[top] = None if head is None else self.key(head)
            self._play(top)


def merge_runs(index: DataFrame, rows: int = MERGE_ROWS) -> DataFrame:
    """The runs merged: INDEX with merge_part and merge_at, by which captures stand in global order.

    Runs are cut at common key ranges of about `rows` captures, found from a sample; a URL with very many captures is
    cut between captures. A task gets its slices run by run, each sorted, and holds its range as columns.
    """
    schema = _schema().append(pa.field("merge_at", pa.int64()))
    names = INDEX_NAMES

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _schema())
        if not table.num_rows:
            return
        of = [table.column(n).to_pylist() for n in ("url_key", "capture_ts", "page_id", "archive", "offset")]
        runs = np.flatnonzero(np.array([True, *(a != b for a, b in zip(of[3], of[3][1:]))])).tolist()
        key = lambda i: (of[0][i] or "", of[1][i], -1 if of[2][i] is None else of[2][i], of[3][i], of[4][i])
        tree = LoserTree([iter(range(s, e)) for s, e in zip(runs, [*runs[1:], table.num_rows])], key)
        merged, at = iter(tree), 0
        while some := [i for _, i in zip(range(8192), merged)]:
            out = table.take(pa.array(some, pa.int64())).append_column("merge_at", pa.array(range(at, at + len(some)), pa.int64()))
            at += len(some)
            yield from out.cast(schema).combine_chunks().to_batches()

    by = [F.coalesce("url_key", F.lit("")), "capture_ts", F.coalesce("page_id", F.lit(-1)), "archive", "offset"]
    width = max(1, -(-index.count() // rows))
    dealt = index.repartitionByRange(width, *by).sortWithinPartitions("archive", *by[:3], "offset")
    return dealt.select(*names).mapInArrow(merge, f"{INDEX}, merge_at long").withColumn("merge_part", F.spark_partition_id())


def captures(pages: DataFrame, most: int = ARCHIVE_BYTES, least: int = LEAST_BYTES, ts_col: str | None = None, rows: int = MERGE_ROWS) -> DataFrame:
    """Write pages as archives to the shared folder and read them back as one merged capture index."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path, most, least, ts_col)
    # frozen, as the ranges are cut by a sample of the runs and each archive is parsed once
    return merge_runs(frozen(read_runs(spark, path), "runs"), rows)
