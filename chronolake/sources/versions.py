"""Tables that change while they are read, runs that can be taken up again, and trees of digests.

`Snapshots`: each write is a folder of its own and a manifest that names its files with their sizes; a reader takes the
newest manifest whose files are all there, so a torn write is never read, and a reader keeps a version for `ttl`
seconds before it looks for a newer one.  `Ledger`: a run over days that notes each finished day, and does only what
isn't noted.  `merkle`: digests of files folded level by level by the hex digits of their names' digests, so no level
has a list of all of them, and two trees are compared from the root down to the files that differ.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _files(fs: pyarrow.fs.FileSystem, root: str, deep: bool = False) -> list[pyarrow.fs.FileInfo]:
    return [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=deep, allow_not_found=True)) if f.type == pyarrow.fs.FileType.File]


class Snapshots:
    """A table at `path` as whole versions."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.ttl, self.clock = spark, path, ttl, clock
        self.held: tuple[float, int, list[str], str] | None = None  # when it was found, version, files, schema

    def publish(self, df: DataFrame) -> int:
        """Write `df` as the next version; one writer at a time, any number of readers."""
        fs, root = _open(self.path)
        data = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{data}")
        files = [[f.path.removeprefix(f"{root}/"), f.size] for f in _files(fs, f"{root}/data/{data}", deep=True) if not f.base_name.startswith(("_", "."))]
        fs.create_dir(f"{root}/manifests")
        version = max(self.versions(), default=-1) + 1
        name = f"{root}/manifests/{version:012d}.json"
        with fs.open_output_stream(f"{name}.{data}", compression=None) as f:
            f.write(json.dumps({"schema": df.schema.json(), "files": files, "whole": True}).encode())
        fs.move(f"{name}.{data}", name)  # readers see it from here on
        return version

    def versions(self) -> list[int]:
        fs, root = _open(self.path)
        return sorted(int(f.base_name[:12]) for f in _files(fs, f"{root}/manifests") if f.base_name.endswith(".json"))

    def _whole(self, version: int) -> tuple[list[str], str] | None:
        """Files and schema of a version, None if its manifest or a file of it is torn or missing."""
        fs, root = _open(self.path)
        try:
            told = json.loads(fs.open_input_stream(f"{root}/manifests/{version:012d}.json").read())
            found = fs.get_file_info([f"{root}/{p}" for p, _ in told["files"]])
            if told["whole"] and all(f.size == size for f, (_, size) in zip(found, told["files"], strict=True)):
                return [p for p, _ in told["files"]], told["schema"]
        except (OSError, ValueError, KeyError, TypeError):
            pass
        return None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The version asked for, or the newest whole one, looked for again after `ttl`; None where there is none."""
        if version is not None:
            whole = self._whole(version)
            return None if whole is None else self._frame(*whole)
        now = self.clock()
        if self.held is None or now - self.held[0] >= self.ttl:
            for v in reversed(self.versions()):
                if self.held is not None and v == self.held[1]:
                    self.held = (now, *self.held[1:])  # nothing newer
                    break
                if (whole := self._whole(v)) is not None:
                    self.held = (now, v, *whole)
                    break
        return None if self.held is None else self._frame(*self.held[2:])

    def _frame(self, files: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], kind)


class Ledger:
    """A run over days whose results and finished days are tables under `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def finished(self) -> DataFrame:
        """(day, rows) of the days that are done."""
        fs, root = _open(self.path)
        kind = "day DATE, rows BIGINT"
        return self.spark.read.schema(kind).json(f"{self.path}/ledger").dropDuplicates(["day"]) if _files(fs, f"{root}/ledger") else self.spark.createDataFrame([], kind)

    def run(self, days: DataFrame, work: Callable[[DataFrame], DataFrame], most: int = 30) -> int:
        """Do `work` (a frame of days to rows with a `day`) for the days that aren't done, `most` at a time in order; how many were done.

        Each batch's partitions are written over what an interrupted run may have left of them, then its days are noted:
        whenever the run stops, a later one ends with the same table as a run that didn't.
        """
        done = 0
        while True:
            left = days.select("day").distinct().join(self.finished(), "day", "left_anti")
            batch = [r.day for r in left.orderBy("day").limit(most).collect()]
            if not batch:
                return done
            asked = self.spark.createDataFrame([(d,) for d in batch], "day DATE")
            rows = work(asked).join(F.broadcast(asked), "day", "left_semi")
            rows.withColumn("part", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")
            written = self.spark.read.parquet(f"{self.path}/rows").drop("part")
            counted = written.join(F.broadcast(asked), "day").groupBy("day").agg(F.count("*").alias("rows"))
            asked.join(counted, "day", "left").select("day", F.coalesce("rows", F.lit(0)).alias("rows")).coalesce(1).write.mode("append").json(f"{self.path}/ledger")
            done += len(batch)

    def rows(self) -> DataFrame:
        """What the finished days gave."""
        return self.spark.read.parquet(f"{self.path}/rows").drop("part").join(F.broadcast(self.finished().select("day")), "day", "left_semi")


def merkle(files: DataFrame, fan: int = 16) -> DataFrame:
    """(level, node, digest, leaves) of a tree over files (name, digest), the root last (level 0, node '').

    A leaf lies at the hex digest of its name; a node is a prefix of it, one digit shorter a level, from the shortest
    that leaves about `fan` files a node.  A node's digest is that of its children's names and digests in order.
    """
    n = max(1, files.count())
    depth = 1
    while fan**depth < n:
        depth += 1
    leaf = files.select(F.sha2("name", 256).alias("place"), "name", "digest")
    rows = F.sort_array(F.collect_list(F.struct("name", "digest")))  # about `fan`, by digests of names
    told = lambda r: F.sha2(F.array_join(F.transform(r, lambda x: F.concat_ws(":", x["name"], x["digest"])), "\n"), 256)
    level = leaf.groupBy(F.substring("place", 1, depth).alias("node")).agg(told(rows).alias("digest"), F.count("*").alias("leaves"))
    out = level.select(F.lit(depth).alias("level"), "node", "digest", "leaves")
    for d in range(depth - 1, -1, -1):
        up = level.withColumn("up", F.substring("node", 1, d)) if d else level.withColumn("up", F.lit(""))
        rows = F.sort_array(F.collect_list(F.struct(F.col("node").alias("name"), "digest")))  # 16 at most
        level = up.groupBy(F.col("up").alias("node")).agg(told(rows).alias("digest"), F.sum("leaves").alias("leaves"))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "node", "digest", "leaves"))
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, change) of files that are added, gone or changed from `a` to `b`: only leaves below nodes that differ are compared."""
    x, y = merkle(a), merkle(b)
    deep = min(x.agg(F.max("level")).first()[0], y.agg(F.max("level")).first()[0])
    same = x.where(F.col("level") == deep).select("node", "digest").intersect(y.where(F.col("level") == deep).select("node", "digest")).select("node")
    below = lambda f: f.withColumn("node", F.substring(F.sha2("name", 256), 1, deep)).join(same, "node", "left_anti")
    old, new = below(a).select("name", F.col("digest").alias("old")), below(b).select("name", F.col("digest").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").otherwise("changed")
    return old.join(new, "name", "full").where("NOT (old <=> new)").select("name", change.alias("change"))


def provenance(spark: SparkSession, root: str, patterns: list[str]) -> tuple[DataFrame, str]:
    """(name, digest) of the controlled files under `root`, in any of the glob patterns, line ends apart, and the root of their tree."""
    read = [spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", True).load(root) for p in patterns]
    every = read[0]
    for r in read[1:]:
        every = every.unionByName(r)
    fs, at = _open(root)
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), f"^\\Q{at}\\E/", "")
    lf = F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))
    files = every.select(name.alias("name"), F.sha2(lf.cast("binary"), 256).alias("digest")).where("name NOT LIKE '%__pycache__%'").dropDuplicates(["name"])
    return files, merkle(files).where("level = 0").first().digest


def lock(spark: SparkSession, files: DataFrame, path: str) -> None:
    """Keep the digests of controlled files as the state that a study is bound to."""
    files.select("name", "digest").write.mode("errorifexists").parquet(path)


def verify(spark: SparkSession, files: DataFrame, path: str) -> dict:
    """Whether the files are those of the lock, and which aren't (the first hundred by name)."""
    locked = spark.read.parquet(path)
    now, then = (merkle(f).where("level = 0").first() for f in (files, locked))
    same = (now and now.digest) == (then and then.digest)
    bad = [] if same else [tuple(r) for r in differences(locked, files).orderBy("name").limit(100).collect()]
    return {"locked": same, "digest": now and now.digest, "expected": then and then.digest, "changes": bad}
