"""Containers of arrays against plain reads."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.sources import tensors as T


@pytest.fixture
def folder(spark, tmp_path):
    T.register(spark)
    rng = np.random.default_rng(2)
    held = {}
    for k in range(3):
        arrays = [(f"layer.{i}.w", "F32", [n, 3], rng.normal(size=(n, 3)).astype("<f4").tobytes()) for i, n in enumerate((0, 1, 50, 700 * (k + 1)))]
        arrays.append(("é", "U8", [2], b"ab"))
        (tmp_path / f"m{k}.tensors").write_bytes(T.container(arrays))
        held[f"m{k}.tensors"] = arrays
    (tmp_path / "readme.txt").write_text("no")
    return str(tmp_path), held


@pytest.mark.parametrize(("piece", "share"), [(1 << 24, 1 << 26), (997, 5000), (7, 40_000)])
def test_digests_against_whole_files(spark, folder, piece, share):
    path, held = folder
    held = held if piece > 7 else {k: v for k, v in held.items() if k == "m0.tensors"}
    at = path if piece > 7 else f"{path}/m0.tensors"
    pieces = spark.read.format("tensors").options(path=at, piece=piece, share=share).load()
    own = {(r.file, r.name): (r.digest, r.bytes) for r in T.array_digests(pieces).collect()}
    assert own == {(f, n): (hashlib.sha256(d).hexdigest(), len(d)) for f, arrays in held.items() for n, _, _, d in arrays}
    chain = {r.file: (r.digest, r.arrays) for r in T.parameter_digest(pieces).collect()}
    assert chain == {f: (hashlib.sha256(b"".join(n.encode() + d for n, _, _, d in sorted(arrays))).hexdigest(), len(arrays)) for f, arrays in held.items()}


def test_names_reach_the_reader(spark, folder):
    path, held = folder
    reader = T.TensorReader({"path": path, "piece": "97"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    late = GreaterThan(("piece",), 0)
    assert list(reader.pushFilters([EqualTo(("name",), "layer.2.w"), late])) == [late]
    assert {r[1] for p in reader.partitions() for r in p.rows} == {"layer.2.w"}
    got = spark.read.format("tensors").options(path=path, piece=97).load().where("name = 'layer.2.w' AND file = 'm1.tensors'").orderBy("piece").collect()
    want = next(d for n, _, _, d in held["m1.tensors"] if n == "layer.2.w")
    assert b"".join(bytes(r.data) for r in got) == want and got[0]["shape"] == [50, 3] and got[0].dtype == "F32" and len(got) == -(-len(want) // 97)


def test_torn_files(spark, tmp_path):
    whole = T.container([("a", "U8", [100], b"x" * 100)])
    for name, data in (("short", b"\x01\x02"), ("header", struct.pack("<Q", 10**6) + b"{}"), ("body", whole[:-1])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="torn"):
            T.TensorReader({"path": str(tmp_path / name)}).partitions()
    (tmp_path / "none.tensors").write_bytes(struct.pack("<Q", 2) + json.dumps({}).encode())
    T.register(spark)
    assert spark.read.format("tensors").option("path", str(tmp_path / "none.tensors")).load().count() == 0


def test_containers_written_by_groups(spark, tmp_path):
    T.register(spark)
    d = spark.range(25).select("id", F.repeat(F.lit("é"), F.col("id").cast("int")).alias("text"))
    T.write_containers(d, str(tmp_path / "out"), F.floor(F.col("id") / 10), "id", "text")
    pieces = spark.read.format("tensors").option("path", str(tmp_path / "out")).load()
    assert {(r.file, r.name, r["shape"][0]) for r in pieces.collect()} == {(f"{i // 10}.tensors", str(i), 2 * i) for i in range(25)}
