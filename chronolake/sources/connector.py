"""A vendor's request interface as a Spark data source, and archives that are written all or not at all.

`spark.read.format("vendor")` asks a transport for daily series, a request a symbol.  Symbols are dealt out over
partitions; equality and membership on `symbol` and bounds on `day` are taken over by the reader, so symbols that
aren't wanted are never asked for and a request carries the days that are.  A task keeps a pause between its requests
and asks again, after longer and longer waits, while the vendor says that too much was asked.

`df.write.format("archive")` hands each task's rows to an archiver.  Tasks write under a staging folder that nobody
reads; the commit publishes one manifest that names every part, so a failed job leaves the archive as it was.  A
streaming batch is published under its number, once, however often it is tried.
"""

from __future__ import annotations

import datetime as dt
import gzip
import importlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronolake.sources.readers import Throttle, payload_text, retried

SERIES = "symbol STRING, day DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
FIELDS = ("open", "high", "low", "close", "volume")


def called(name: str):
    """What a `module:name` option stands for."""
    module, _, what = name.partition(":")
    return getattr(importlib.import_module(module), what)


class Transport(Protocol):
    """How a vendor is asked; made anew in each task from the source's options."""

    def symbols(self) -> list[str]: ...

    def ask(self, symbol: str, first: str | None, last: str | None) -> str: ...


class Files:
    """Answers kept as files, a folder `symbol=...` each, on any file system that Arrow knows."""

    def __init__(self, options: dict):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(options["root"])

    def _list(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(folder))
        return sorted(f.path for f in found if not posixpath.basename(f.path).startswith(("_", ".")))

    def symbols(self) -> list[str]:
        return [posixpath.basename(p).partition("=")[2] for p in self._list(self.root)]

    def ask(self, symbol: str, first: str | None = None, last: str | None = None) -> str:
        parts = []
        for path in self._list(f"{self.root}/symbol={symbol}"):
            with self.fs.open_input_stream(path) as f:
                lines = f.read().decode().splitlines()
            parts += lines if not parts else lines[1:]  # a header each
        inside = [x for x in parts[1:] if (first is None or x[:10] >= first) and (last is None or x[:10] <= last)]
        return "\n".join(parts[:1] + inside)


class Shelves:
    """Answers kept in Parquet files, a row (symbol, answer) each, under folders `shelf=...`: files don't grow in number with the symbols.

    Symbols are listed shelf by shelf, and `near` says which a task should ask for: those of a shelf come in the order
    of its rows, so that a task reads a file once for all of them.
    """

    def __init__(self, options: dict):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(options["root"])
        self.at: dict[str, tuple[str, int]] | None = None
        self.held: dict[str, str] = {}

    def _files(self) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True))
        return sorted(f.path for f in found if f.path.endswith(".parquet"))

    def symbols(self) -> list[str]:
        return [s for path in self._files() for s in pq.read_table(path, columns=["symbol"], filesystem=self.fs, partitioning=None).column(0).to_pylist()]

    def near(self, names: list[str], parts: int) -> list[tuple[str, ...]]:
        """Names, as `symbols` orders them, in runs."""
        return [tuple(names[len(names) * i // parts : len(names) * (i + 1) // parts]) for i in range(parts)]

    def _groups(self, path: str) -> Iterator[tuple[int, list[str]]]:
        with pq.ParquetFile(path, filesystem=self.fs) as f:
            for g in range(f.num_row_groups):
                yield g, f.read_row_group(g, columns=["symbol"]).column(0).to_pylist()

    def ask(self, symbol: str, first: str | None = None, last: str | None = None) -> str:
        if symbol not in self.held:
            if self.at is None:
                self.at = {s: (path, g) for path in self._files() for g, names in self._groups(path) for s in names}
            path, group = self.at[symbol]
            with pq.ParquetFile(path, filesystem=self.fs) as f:
                self.held = dict(zip(*(c.to_pylist() for c in f.read_row_group(group, columns=["symbol", "answer"]).columns), strict=True))
        lines = self.held[symbol].splitlines()
        inside = [x for x in lines[1:] if (first is None or x[:10] >= first) and (last is None or x[:10] <= last)]
        return "\n".join(lines[:1] + inside)


def _from_json(text: str) -> dict[str, list[str | None]]:
    """Columns of the first object of objects: days with fields that may be numbered (`1. open`)."""
    tables = (v for v in json.loads(text).values() if isinstance(v, dict) and v and all(isinstance(x, dict) for x in v.values()))
    days = {day: {k.split(". ")[-1]: x for k, x in row.items()} for day, row in next(tables, {}).items()}
    return {"timestamp": list(days), **{f: [row.get(f) for row in days.values()] for f in FIELDS}}


def _from_csv(text: str) -> pa.Table:
    kinds = dict.fromkeys(("timestamp", *FIELDS), pa.string())
    options = pyarrow.csv.ConvertOptions(column_types=kinds, include_columns=list(kinds), include_missing_columns=True)
    return pyarrow.csv.read_csv(io.BytesIO(text.encode() + b"\n"), convert_options=options)


def series(symbol: str, text: str) -> pa.RecordBatch:
    """A vendor's answer, CSV or JSON, as rows; dates and numbers that can't be read are null."""
    text = text.strip()
    got = _from_csv(text) if text and text[0] != "{" else _from_json(text or "{}")
    column = lambda c: pa.array(got[c].to_pylist() if isinstance(got, pa.Table) else got[c], pa.string())
    day = pc.strptime(pc.utf8_slice_codeunits(column("timestamp"), 0, 10), format="%Y-%m-%d", unit="s", error_is_null=True).cast(pa.date32())
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    values = [pc.if_else(pc.match_substring_regex(v, number), v, pa.scalar(None, pa.string())).cast(pa.float64()) for v in map(column, FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array([symbol] * len(day), pa.string()), day, *values], names=["symbol", "day", *FIELDS])


@dataclass
class Symbols(InputPartition):
    """The symbols that one task asks for."""

    names: tuple[str, ...]

    def __post_init__(self):
        super().__init__(self.names)


class VendorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.only: set[str] | None = set(options["symbols"].split(",")) if options.get("symbols") else None
        self.first: str | None = None
        self.last: str | None = None

    def _transport(self) -> Transport:
        return called(self.options.get("transport", f"{__name__}:Files"))(self.options)

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column == "symbol" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            elif column == "day" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                day = f.value
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    low = (day + dt.timedelta(days=isinstance(f, GreaterThan))).isoformat()
                    self.first = max(self.first or low, low)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    high = (day - dt.timedelta(days=isinstance(f, LessThan))).isoformat()
                    self.last = min(self.last or high, high)
            else:
                yield f

    def partitions(self):
        vendor = self._transport()
        names = vendor.symbols()
        if self.only is not None:
            names = [n for n in names if n in self.only]
        parts = max(1, min(len(names), int(self.options.get("partitions", "8"))))
        dealt = vendor.near(names, parts) if hasattr(vendor, "near") else [tuple(names[i::parts]) for i in range(parts)]
        return [Symbols(d) for d in dealt]

    def read(self, partition: Symbols) -> Iterator[pa.RecordBatch]:
        vendor = self._transport()
        pause = Throttle(float(self.options.get("gap", "0.12")))
        times, wait = int(self.options.get("retries", "3")), float(self.options.get("wait", "2"))
        for name in partition.names:
            answer = retried(lambda n=name: pause(lambda: payload_text(vendor.ask(n, self.first, self.last))), times, wait)
            rows = series(name, answer)
            inside = pa.array([True] * len(rows))  # a vendor may answer more than it was asked for
            for bound, keep in ((self.first, pc.greater_equal), (self.last, pc.less_equal)):
                if bound is not None:
                    inside = pc.and_(inside, pc.fill_null(keep(rows.column("day"), pa.scalar(dt.date.fromisoformat(bound))), False))
            yield rows.filter(inside)


class Vendor(DataSource):
    """Daily series of a vendor.  Options: transport, symbols, partitions, gap, retries, wait, and what the transport reads."""

    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return SERIES

    def reader(self, schema: StructType) -> VendorReader:
        return VendorReader(self.options)


class Archiver(Protocol):
    """What a user puts in: rows of one task in Arrow batches to one part, which it names."""

    suffix: str

    def write(self, stream, batches: Iterator[pa.RecordBatch]) -> int: ...


class JsonLines:
    """Rows as gzipped JSON lines, as Spark reads them."""

    suffix = "json.gz"

    def write(self, stream, batches: Iterator[pa.RecordBatch]) -> int:
        n = 0
        with gzip.GzipFile(fileobj=stream, mode="wb", mtime=0) as z:
            for batch in batches:
                for row in batch.to_pylist():
                    z.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=_shown).encode() + b"\n")
                n += batch.num_rows
        return n


class Discard:
    """Takes rows and keeps none."""

    suffix = ""

    def write(self, stream, batches: Iterator[pa.RecordBatch]) -> int:
        return sum(b.num_rows for b in batches)


def _shown(value):
    return value.isoformat() if isinstance(value, dt.date | dt.datetime) else str(value)


@dataclass
class Part(WriterCommitMessage):
    """A finished part, if the archiver keeps one, and its rows."""

    name: str
    rows: int


class _Parts:
    """Both writers: tasks stage parts, one manifest publishes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.job = dict(options), overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = self._at()
        archiver: Archiver = called(self.options.get("archiver", f"{__name__}:JsonLines"))()
        if not archiver.suffix:
            return Part("", archiver.write(None, iterator))
        name = f"{self.job}/{uuid.uuid4().hex}.{archiver.suffix}"  # a name for each attempt: two of one task never meet
        fs.create_dir(f"{root}/parts/{self.job}")
        try:
            with fs.open_output_stream(f"{root}/parts/{name}", compression=None) as stream:
                return Part(name, archiver.write(stream, iterator))
        except BaseException:
            fs.delete_file(f"{root}/parts/{name}")
            raise

    def _publish(self, messages: list[Part | None], manifest: str) -> None:
        fs, root = self._at()
        fs.create_dir(f"{root}/manifests")
        done = f"{root}/manifests/{manifest}.json"
        if fs.get_file_info(done).type != pyarrow.fs.FileType.NotFound:
            self._forget(messages)  # an earlier try of this batch is there
            return
        before = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/manifests")) if f.path.endswith(".json")] if self.overwrite else []
        parts = [m for m in messages if m is not None]
        told = {"parts": [m.name for m in parts if m.name], "rows": sum(m.rows for m in parts), "replaces": [posixpath.basename(p) for p in before]}
        with fs.open_output_stream(f"{done}.{self.job}", compression=None) as f:
            f.write(json.dumps(told).encode())
        fs.move(f"{done}.{self.job}", done)  # the archive changes here, and only here

    def _forget(self, messages: list[Part | None]) -> None:
        fs, root = self._at()
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/parts/{m.name}")


class ArchiveWriter(_Parts, DataSourceArrowWriter):
    def commit(self, messages):
        self._publish(messages, self.job)

    def abort(self, messages):
        fs, root = self._at()
        if fs.get_file_info(f"{root}/parts/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/parts/{self.job}")  # lost tasks' parts, too


class ArchiveStream(_Parts, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        self._publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages, batchId):
        self._forget(messages)


class Archive(DataSource):
    """Options: path, archiver (`module:name`; JSON lines, if not given)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        raise ValueError("an archive is read by `archived`")

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        to_arrow_schema(schema)  # what Arrow can't carry is refused before any task runs
        return ArchiveWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> ArchiveStream:
        return ArchiveStream(self.options, False)


def register(spark: SparkSession) -> None:
    """Make `vendor` and `archive` known as formats, and let filters reach Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Vendor)
    spark.dataSource.register(Archive)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, part, rows of the manifest) that are published and not replaced."""
    told = spark.read.schema("parts ARRAY<STRING>, rows BIGINT, replaces ARRAY<STRING>").option("pathGlobFilter", "*.json").json(f"{path}/manifests")
    told = told.withColumn("manifest", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    gone = told.select(F.explode("replaces").alias("manifest"))
    return told.join(gone, "manifest", "left_anti")


def archived(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the parts that published manifests name; what failed jobs left is not read."""
    parts = [f"{path}/parts/{r.part}" for r in manifests(spark, path).select(F.explode("parts").alias("part")).collect()]  # one name a task
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)
