"""Binary influence matrices."""

import struct

import numpy as np
import pytest

from raysheaf.sources import influence


def matrix(spark, rows):
    return spark.createDataFrame(rows, "voxel long, bixel long, value double")


def csr(path):
    """Pointers, bixels and values, read plainly."""
    data = open(path, "rb").read()
    magic, version, voxels, bixels, n = struct.unpack("<4sIQQQ", data[:32])
    assert (magic, version) == (b"ODIJ", 2)
    words = np.frombuffer(data[32:], "<u8")
    assert len(words) == voxels + 1 + 2 * n
    return (voxels, bixels, n), words[: voxels + 1].tolist(), words[voxels + 1 : voxels + 1 + n].tolist(), words[voxels + 1 + n :].view("<f8").tolist()


def test_layout(spark, tmp_path):
    path = str(tmp_path / "deep" / "m.dij")
    rows = [(9, 4, 4.5), (0, 3, 2.5), (3, 1, 3.5), (0, 0, 1.5)]
    influence.save_binary(matrix(spark, rows), path, 10, 5, 3)
    assert csr(path) == ((10, 5, 4), [0, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4], [0, 3, 1, 4], [1.5, 2.5, 3.5, 4.5])
    assert influence.shape(path) == (10, 5, 4)
    assert sorted(map(tuple, influence.load_binary(spark, path, 1).collect())) == sorted(rows)


def test_empty_and_bounds(spark, tmp_path):
    path = str(tmp_path / "m.dij")
    influence.save_binary(matrix(spark, []), path, 100, 50)
    assert csr(path) == ((100, 50, 0), [0] * 101, [], []) and influence.load_binary(spark, path).count() == 0
    influence.save_binary(matrix(spark, [(2, 1, None)]), path, 4, 2)
    assert csr(path)[1:] == ([0, 0, 0, 1, 1], [1], [0.0])
    for row in ((4, 0, 1.0), (0, 2, 1.0), (-1, 0, 1.0), (None, 0, 1.0)):
        with pytest.raises(ValueError):
            influence.save_binary(matrix(spark, [row]), path, 4, 2)
    with pytest.raises(ValueError):
        influence.save_binary(matrix(spark, []), "s3://bucket/m.dij", 4, 2)


def test_other_files_are_refused(spark, tmp_path):
    good = np.array([(b"ODIJ", 2, 1, 1, 0)], influence.HEAD).tobytes() + bytes(16)
    for name, data in (("magic", b"XXXX" + good[4:]), ("version", good[:4] + b"\1" + good[5:]), ("short", good[:20]), ("cut", good[:-1])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            influence.shape(str(tmp_path / name))
        with pytest.raises(Exception, match="influence matrix"):
            influence.load_binary(spark, str(tmp_path / name)).count()
    with pytest.raises(FileNotFoundError):
        influence.shape(str(tmp_path / "none"))


def test_large_round_trip(spark, tmp_path, monkeypatch):
    """Voxels without entries, a voxel with many, parts of any size; then a range of voxels reads its own bytes."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

    path = str(tmp_path / "m.dij")
    rng = np.random.default_rng(3)
    keys = {(int(v), int(b)) for v, b in zip(rng.integers(0, 900, 3000) * 3 + 11, rng.integers(0, 400, 3000))} | {(500, b) for b in range(400)}
    rows = [(v, b, v + b / 1000) for v, b in keys]
    influence.save_binary(matrix(spark, rows).repartition(7), path, 3000, 400, 5)
    _, pointers, bixels, values = csr(path)
    want = sorted(rows)
    assert pointers == np.searchsorted([r[0] for r in want], np.arange(3001)).tolist()
    assert list(zip(bixels, values)) == [r[1:] for r in want]
    assert sorted(map(tuple, influence.load_binary(spark, path, 700).collect())) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = influence.load_binary(spark, path, 700).where("voxel >= 490 and voxel < 520 and bixel % 2 = 0")
        assert sorted(map(tuple, part.collect())) == [r for r in want if 490 <= r[0] < 520 and r[1] % 2 == 0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    monkeypatch.setattr(influence, "PIECE", 16)
    words = []
    plain = influence._File.read
    monkeypatch.setattr(influence._File, "read", lambda self, at, count, kind: words.append(count) or plain(self, at, count, kind))
    for filters, kept in (([EqualTo(("voxel",), 500)], lambda v: v == 500), ([GreaterThan(("voxel",), 2000), LessThan(("voxel",), 2020)], lambda v: 2000 < v < 2020), ([GreaterThanOrEqual(("voxel",), 2600), LessThanOrEqual(("voxel",), 2610), EqualTo(("bixel",), 1)], lambda v: 2600 <= v <= 2610), ([EqualTo(("voxel",), 5000)], lambda v: False)):
        words.clear()
        reader = influence._FilteredReader({"path": path, "rows_per_partition": "90"})
        assert all(f.attribute == ("bixel",) for f in reader.pushFilters(filters))
        got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == [r for r in want if kept(r[0])]
        assert sum(words) <= 2 * len(got) + 2 + 40 * len(reader.partitions()) + 40


def test_repeated_tasks_write_the_same(spark, tmp_path):
    """A writer's tasks run twice, in any order, and the target appears at the commit only."""
    import json

    import pyarrow as pa

    batch = lambda part, *rows: pa.RecordBatch.from_pydict({"voxel": [r[0] for r in rows], "bixel": [r[1] for r in rows], "value": [r[2] for r in rows], "part": [part] * len(rows)})
    path = tmp_path / "m.dij"
    w = influence._Writer({"path": str(path), "voxels": "6", "bixels": "3", "entries": "4", "parts": json.dumps([(0, 0, 0), (4, 2, 2)]), "last_voxel": "4"})
    parts = {0: [batch(0, (1, 0, 1.0)), batch(0, (1, 2, 2.0))], 4: [batch(4), batch(4, (3, 1, 3.0), (4, 1, 4.0))]}
    messages = [w.write(iter(parts[p])) for p in (4, 0, 4)][1:]
    assert not path.exists()
    with pytest.raises(ValueError):
        w.commit(messages[:1])
    w.commit(messages)
    assert csr(path)[1:] == ([0, 0, 2, 2, 3, 4, 4], [0, 2, 1, 1], [1.0, 2.0, 3.0, 4.0])
    w = influence._Writer({"path": str(path), "voxels": "6", "bixels": "3", "entries": "0", "parts": "[]", "last_voxel": "-1"})
    w.abort([])
    assert csr(path)[0] == (6, 3, 4) and not (tmp_path / "m.dij.partial").exists()
