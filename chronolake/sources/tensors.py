"""Files of named arrays, read by parts and digested.

A container is eight bytes (the header's length, little-endian), a JSON header of name: dtype, shape and the range of
its bytes behind the header, then these bytes.  `spark.read.format("tensors")` reads the headers on the driver, cuts
every array into pieces of `piece` bytes, and deals pieces to partitions by their size, so a file of any size is read
at once in many places; a filter on names reaches the reader, and bytes of other arrays aren't read.

`array_digests` are those of single arrays; each is one chain of bytes, streamed piece by piece through one task.
`parameter_digest` is the chain over all arrays of a group in order of name, name before bytes, streamed in the same
way: a group's digest is as sequential as the chain that defines it, but no more than a piece is in memory.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

PIECES = "file STRING, name STRING, dtype STRING, shape ARRAY<BIGINT>, piece INT, data BINARY"


def header(fs: pyarrow.fs.FileSystem, path: str) -> tuple[int, dict]:
    """Where a container's bytes begin, and its arrays; an error if the file isn't whole."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        (n,) = struct.unpack("<Q", f.read_at(8, 0)) if size >= 8 else (size,)
        if 8 + n > size:
            raise ValueError(f"{path} is no container, or torn")
        told = {k: v for k, v in json.loads(f.read_at(n, 8)).items() if k != "__metadata__"}
    if any(8 + n + v["data_offsets"][1] > size for v in told.values()):
        raise ValueError(f"{path} is torn")
    return 8 + n, told


@dataclass
class Pieces(InputPartition):
    """(file, name, dtype, shape, piece, first byte, bytes) of what one task reads."""

    rows: tuple[tuple, ...]

    def __post_init__(self):
        super().__init__(self.rows)


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("name",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.options["path"])
        piece, share = int(self.options.get("piece", 1 << 24)), int(self.options.get("share", 1 << 26))
        found = fs.get_file_info(root)
        files = [root] if found.type == pyarrow.fs.FileType.File else sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.path.endswith(".tensors"))
        parts, now, held = [], [], 0
        for path in files:
            begin, arrays = header(fs, path)
            for name, v in arrays.items():
                if self.only is not None and name not in self.only:
                    continue
                a, b = v["data_offsets"]
                for i, at in enumerate(range(a, max(b, a + 1), piece)):
                    n = min(piece, b - at)
                    now.append((path, name, v["dtype"], tuple(v["shape"]), i, begin + at, n))
                    held += n + 256
                    if held >= share:
                        parts.append(Pieces(tuple(now)))
                        now, held = [], 0
        return [*parts, Pieces(tuple(now))] if now or not parts else parts

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.options["path"])
        opened, at = None, None
        for path, name, dtype, shape, i, begin, n in partition.rows:
            if path != at:
                opened, at = fs.open_input_file(path), path
            yield pa.RecordBatch.from_arrays(
                [pa.array([posixpath.basename(path)]), pa.array([name]), pa.array([dtype]), pa.array([list(shape)], pa.list_(pa.int64())), pa.array([i], pa.int32()), pa.array([opened.read_at(n, begin)], pa.binary())],
                names=["file", "name", "dtype", "shape", "piece", "data"],
            )


class Tensors(DataSource):
    """Options: path (a file, or a folder of `.tensors` files), piece (bytes of a row at most), share (bytes of a partition, about)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tensors)


def container(arrays: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """The bytes of a file of (name, dtype, shape, bytes)."""
    told, at = {}, 0
    for name, dtype, shape, data in arrays:
        told[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    head = json.dumps(told).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(d for _, _, _, d in arrays)


def write_containers(rows: DataFrame, path: str, group: Column, name: str, data: str) -> None:
    """A file of byte arrays for each value of `group`, whose rows fit in a task (a model's shard)."""

    def each(key, table):
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root)
        arrays = [(n, "U8", [len(d)], d) for n, d in zip(table.column("name").to_pylist(), table.column("data").to_pylist(), strict=True)]
        part = f"{root}/.{key[0].as_py()}"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(container(arrays))
        fs.move(part, f"{root}/{key[0].as_py()}.tensors")  # whole or not at all
        return pa.table({"group": pa.array([str(key[0].as_py())])})

    given = rows.select(group.cast("string").alias("group"), F.col(name).cast("string").alias("name"), F.col(data).cast("binary").alias("data"))
    given.groupBy("group").applyInArrow(each, "group string").write.format("noop").mode("overwrite").save()


def _chains(pieces: DataFrame, group: list[str], names: bool) -> DataFrame:
    """(group, digest, arrays, bytes) of the chain of each group's pieces in order of name and piece."""
    kinds = ", ".join(f"{c} string" for c in group)

    def each(batches):
        now, sha, arrays, size, last = None, None, 0, 0, None

        def told():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in now), pa.array([sha.hexdigest()]), pa.array([arrays], pa.int64()), pa.array([size], pa.int64())], names=[*group, "digest", "arrays", "bytes"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group), strict=True))
            for key, name, data in zip(keys, batch.column("array").to_pylist(), batch.column("data"), strict=True):
                if key != now:
                    if now is not None:
                        yield told()
                    now, sha, arrays, size, last = key, hashlib.sha256(), 0, 0, None
                if name != last:
                    arrays, last = arrays + 1, name
                    if names:
                        sha.update(name.encode())
                sha.update(data.as_buffer())
                size += len(data.as_buffer())
        if now is not None:
            yield told()

    ordered = pieces.select(*group, F.col("name").alias("array"), "piece", "data").repartition(*group).sortWithinPartitions(*group, "array", "piece")
    return ordered.mapInArrow(each, f"{kinds}, digest string, arrays long, bytes long")


def array_digests(pieces: DataFrame) -> DataFrame:
    """(file, name, digest, arrays, bytes) of every array."""
    return _chains(pieces, ["file", "name"], names=False)


def parameter_digest(pieces: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, digest, arrays, bytes) of all arrays of each group, a file if not given."""
    return _chains(pieces, group or ["file"], names=True)
