"""A recorded log played back at a rate, as a stream, and a gauge that slows a sink down when it falls behind."""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType


@dataclass
class Slice(InputPartition):
    """Some rows of one row group of a file."""

    file: str
    group: int
    skip: int
    rows: int


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class EventLoad(DataSource):
    """Rows of Parquet files in the order of their names, due at a rate from a start on: format "event_load".

    Options: path, a file or folder; rate, rows a second; started, seconds since 1970 (the first use, unless given; give it
    where a query is to go on after a restart); batch, rows of an Arrow batch, 100 unless given; most, rows of a micro-batch,
    all that are due unless given, and with it position, a file beside the checkpoint of the query that says how far it
    got, as Spark doesn't tell a source that starts anew. The log is recorded: its files don't change.
    """

    @classmethod
    def name(cls) -> str:
        return "event_load"

    def schema(self) -> StructType:
        fs, files = _files(self.options["path"])
        with fs.open_input_file(files[0]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LoadReader(schema, dict(self.options))


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, at = _located(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return fs, [at]
    found = [x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File and x.base_name.endswith(".parquet")]
    if not found:
        raise ValueError(f"no Parquet files at {path}")
    return fs, sorted(found)


class LoadReader(DataSourceStreamReader):
    """Hands out ranges of rows. Footers are read as far as rows are due, and no rows in the driver."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path = schema.names, options["path"]
        self.rate, self.started = float(options.get("rate", 100)), float(options.get("started", time.time()))
        self.most, self.batch = int(options["most"]) if "most" in options else None, int(options.get("batch", 100))
        self.position = options.get("position")
        if self.most is not None and (self.most < 1 or not self.position):
            raise ValueError("most needs to be 1 or more, and position a file")
        self.files: list[str] | None = None
        self.groups: list[tuple[str, int, int]] = []
        self.ends: list[int] = []
        self.known, self.at = 0, self._begun()

    def _begun(self) -> int:
        if not self.position:
            return 0
        fs, at = _located(self.position)
        if fs.get_file_info(at).type != pafs.FileType.File:
            return 0
        with fs.open_input_file(at) as f:
            return int(f.read())

    def _reached(self, row: int) -> None:
        """Written when a micro-batch is planned: by then its offsets are logged, so that the file is never behind the log."""
        if self.position and row != self.at:
            fs, at = _located(self.position)
            with fs.open_output_stream(at) as f:
                f.write(str(row).encode())
        self.at = row

    def _grow(self, rows: int) -> int:
        """How many of so many rows there are."""
        fs, files = _files(self.path) if self.files is None else (_located(self.path)[0], self.files)
        self.files = files
        while (self.ends[-1] if self.ends else 0) < rows and self.known < len(files):
            with fs.open_input_file(files[self.known]) as f:
                meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                self.groups.append((files[self.known], g, n))
                self.ends.append((self.ends[-1] if self.ends else 0) + n)
            self.known += 1
        return min(rows, self.ends[-1] if self.ends else 0)

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        due = max(0, int(self.rate * (time.time() - self.started)))
        if self.most is not None:
            due = min(due, self.at + self.most)
        return {"row": max(self._grow(due), self.at)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        one, two = start["row"], end["row"]
        self._grow(two)
        self._reached(two)
        out = []
        for k in range(bisect_right(self.ends, one), len(self.ends)):
            file, group, n = self.groups[k]
            first = self.ends[k] - n
            if first >= two:
                break
            skip = max(0, one - first)
            out.append(Slice(file, group, skip, min(n, two - first) - skip))
        return out

    def commit(self, end: dict) -> None:
        self._reached(end["row"])

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, skip, left = _located(self.path)[0], partition.skip, partition.rows
        with fs.open_input_file(partition.file) as f:
            for b in pq.ParquetFile(f).iter_batches(self.batch, row_groups=[partition.group], columns=self.names):
                if skip >= b.num_rows:
                    skip -= b.num_rows
                    continue
                b = b.slice(skip, left)
                skip, left = 0, left - b.num_rows
                yield b.select(self.names)
                if left <= 0:
                    return


def level_of(rows: float, seconds: float, full_rows: float = 5000.0, full_seconds: float = 0.1) -> float:
    """ingest.pressure() of one micro-batch, where a full load may be given."""
    return max(min(1.0, rows / full_rows), min(1.0, seconds / full_seconds))


class Gauge(StreamingQueryListener):
    """How far behind the last micro-batch of a query was, and the delay that follows, as ingest.delay_ms() has it.

    name: the query that is watched, all of them unless given. full_rows and full_seconds make a pressure of 1.
    """

    def __init__(self, name: str | None = None, full_rows: float = 5000.0, full_seconds: float = 0.1) -> None:
        self.name, self.full = name, (full_rows, full_seconds)
        self.level = self.peak = 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is None or p.name == self.name:
            self.level = level_of(p.numInputRows, p.batchDuration / 1000, *self.full)
            self.peak = max(self.peak, self.level)

    def onQueryIdle(self, event) -> None:
        self.level = 0.0

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def delay(self) -> float:
        """Seconds."""
        return 0.1 if self.level > 0.8 else 0.01 if self.level > 0.5 else 0.0


def paced(step: Callable[[DataFrame, int], None], gauge: Gauge, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """step, for foreachBatch, after the delay that the gauge asks for."""

    def run(batch: DataFrame, epoch: int) -> None:
        if gauge.delay:
            wait(gauge.delay)
        step(batch, epoch)

    return run
