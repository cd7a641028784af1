"""Captured pages in WARC files: a data source with filters pushed to an index, splits, commits and streams.

``df.write.format("page_warc")`` of (page_id, url, html) writes a compressed WARC file a task, a record a
page, each a gzip member of its own as other WARC tools expect, and beside it an index: host, offset and
length of each record, by host. A commit file lists the files of a write; only those are seen, so what
failed or repeated tasks leave behind never shows. Reading takes pieces of files of about ``splitBytes``. A filter on
``host`` (equal to, or in) is answered from the index: only the records of those hosts are read.

Read as a stream, a commit is an offset. Paths are such as pyarrow's file systems open, from all executors.
One write at a time may run on a path.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "page_id long, url string, host string, html string"
SPLIT_BYTES = 64 << 20
#: Bytes of neighbouring records that are fetched at once.
GATHERED_BYTES = 2 << 20
#: Records as near as this in a file are read at once.
GAP_BYTES = 64 << 10
#: Records that a writer holds as Python values for the index.
INDEX_ROWS = 1 << 14
#: Characters of pages that a reader holds before it hands them on.
BATCH_CHARS = 4 << 20
HOST = re.compile(r"^https?://([^/?#]+)")
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("html", pa.string())])
INDEX = pa.schema([("host", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def use(spark: SparkSession) -> None:
    """Registers the source, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageWarc)


def host_of(url: str | None) -> str | None:
    """The host of a link as ``functions.pages.host`` has it: empty without one, null for null."""
    found = HOST.match(url or "")
    return None if url is None else found[1].lower() if found else ""


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC record as a gzip member. What a header line can't hold, and nulls, stand in JSON."""
    body = (html or "").encode()
    fields = json.dumps({"page_id": page_id, "url": url, "null": html is None})
    target = "".join(c for c in url or "" if c.isprintable())
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {target}\r\nContent-Type: text/html\r\nPage-Fields: {fields}\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse(raw: bytes) -> tuple[int | None, str | None, str | None]:
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = json.loads(lines["Page-Fields"])
    return fields["page_id"], fields["url"], None if fields["null"] else rest[: int(lines["Content-Length"])].decode()


@dataclass(frozen=True)
class File:
    name: str
    bytes: int


def commits(path: str) -> list[str]:
    """The names of the commit files, in order."""
    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.endswith(".json"))


def committed(path: str, names: list[str]) -> list[File]:
    system, root = fs.FileSystem.from_uri(path)
    files: list[File] = []
    for name in names:
        with system.open_input_stream(f"{root}/commits/{name}") as f:
            told = json.loads(f.read())
        files = [] if told["replaces"] else files
        files += [File(x["name"], x["bytes"]) for x in told["files"]]
    return files


@dataclass
class Piece(InputPartition):
    """The records of a file that begin in a range of its bytes."""

    name: str
    start: int
    stop: int


def pieces(files: list[File], size: int) -> list[Piece]:
    return [Piece(f.name, lo, min(lo + size, f.bytes)) for f in files for lo in range(0, f.bytes, size)]


def batches(rows: Iterable[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (``PAGES``) as batches that end with ``size`` characters of pages, so what a task holds does not grow with
    their length; Spark would gather thousands of pages, of any length, as Python values."""
    held: list[tuple] = []
    chars = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*held, strict=True), PAGES, strict=True)], schema=PAGES)

    for row in rows:
        held.append(row)
        chars += len(row[3] or "") + 64
        if chars >= size:
            yield made()
            held, chars = [], 0
    if held:
        yield made()


def indexed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True) if rows else ([], [], []), INDEX, strict=True)], schema=INDEX)


class Records:
    """Reads pieces; with ``hosts``, only records of those."""

    def __init__(self, path: str, hosts: list[str] | None = None):
        self.path, self.hosts = path, hosts
        self.bytes_read = 0

    def chosen(self, system: fs.FileSystem, root: str, piece: Piece) -> pa.Table:
        inside = (pc.field("offset") >= piece.start) & (pc.field("offset") < piece.stop)
        if self.hosts is not None:
            inside &= pc.field("host").isin(self.hosts)
        return pq.read_table(f"{root}/data/{piece.name}.index", filesystem=system, filters=inside).sort_by("offset")

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, root = fs.FileSystem.from_uri(self.path)
        index = self.chosen(system, root, piece).to_pylist()
        if not index:
            return
        with system.open_input_file(f"{root}/data/{piece.name}") as f:
            at = 0
            while at < len(index):
                # neighbours are fetched together, but never more than a few MB
                end, lo = at + 1, index[at]["offset"]
                while end < len(index) and index[end]["offset"] - index[end - 1]["offset"] - index[end - 1]["length"] <= GAP_BYTES and index[end]["offset"] - lo < GATHERED_BYTES:
                    end += 1
                size = index[end - 1]["offset"] + index[end - 1]["length"] - lo
                raw = f.read_at(size, lo)
                self.bytes_read += size
                for x in index[at:end]:
                    page_id, url, html = parse(raw[x["offset"] - lo : x["offset"] - lo + x["length"]])
                    yield page_id, url, x["host"], html
                at = end


class PageWarc(DataSource):
    """Options: ``path``, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "page_warc"

    def schema(self) -> str:
        return SCHEMA

    @property
    def split(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema: StructType) -> PageReader:
        return BatchReader(self.options["path"], self.split)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(self.options["path"], self.split)

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return BatchWriter(self.options["path"], schema.fieldNames(), overwrite)


class PageReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.split, self.records = split, Records(path)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            if isinstance(x, EqualTo | In) and x.attribute == ("host",):
                asked = [v for v in (x.value if isinstance(x, In) else [x.value]) if v is not None]
                known = self.records.hosts
                self.records.hosts = asked if known is None else [h for h in known if h in asked]
            else:
                yield x

    def partitions(self) -> list[Piece]:
        path = self.records.path
        return pieces(committed(path, commits(path)), self.split) if self.records.hosts != [] else []

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.records.read(partition)


class BatchReader(PageReader):
    """As ``PageReader``, in batches."""

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches(super().read(partition), BATCH_CHARS)


class PageStream(DataSourceStreamReader):
    """An offset is the number of commits that have been read."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(committed(self.path, commits(self.path)[start["commits"] : end["commits"]]), self.split)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches(Records(self.path).read(partition), BATCH_CHARS)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str
    bytes: int


class PageWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite
        missing = {"page_id", "url", "html"} - set(columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        name, at, found, own = f"{uuid.uuid4().hex}.warc.gz", 0, [], []
        with system.open_output_stream(f"{root}/data/{name}", compression=None) as f:
            for row in iterator:
                raw = record(row["page_id"], row["url"], row["html"])
                f.write(raw)
                own.append((host_of(row["url"]), at, len(raw)))
                at += len(raw)
                if len(own) >= INDEX_ROWS:
                    found.append(indexed(own))
                    own = []
        index = pa.Table.from_batches([*found, indexed(own)])
        pq.write_table(index.sort_by([("host", "ascending"), ("offset", "ascending")]), f"{root}/data/{name}.index", filesystem=system, row_group_size=1 << 16)
        return Written(name, at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        n = len(commits(self.path))
        told = {"replaces": self.overwrite, "files": [{"name": m.name, "bytes": m.bytes} for m in messages if m is not None and m.bytes]}
        with system.open_output_stream(f"{root}/commits/{n:09d}.part") as f:
            f.write(json.dumps(told).encode())
        system.move(f"{root}/commits/{n:09d}.part", f"{root}/commits/{n:09d}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                for name in (m.name, f"{m.name}.index"):
                    system.delete_file(f"{root}/data/{name}")


class BatchWriter(PageWriter, DataSourceArrowWriter):
    """As ``PageWriter``, from batches, of which one page at a time becomes Python values."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        def rows() -> Iterator[dict]:
            for batch in iterator:
                cols = {c: batch.column(self.columns.index(c)) for c in ("page_id", "url", "html")}
                yield from ({c: x[i].as_py() for c, x in cols.items()} for i in range(len(batch)))

        return super().write(rows())
