"""Many patients in one plan give what each gives alone."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from raysheaf.sources import dicom
from raysheaf.sources import patients as pt

from .test_sources import contour, dicom_file, element, sequence


def image(patient, z, samples, spacing="2\\1", implicit=False, syntax=None):
    e = lambda *a: element(*a, implicit)
    icon = sequence(0x00880200, [element(0x7FE00010, "OW", b"\1\2\3\4")]) if not implicit else b""
    shape = [e(0x00280010, "US", struct.pack("<H", samples.shape[0])), e(0x00280011, "US", struct.pack("<H", samples.shape[1])), e(0x00280030, "DS", spacing), e(0x00280103, "US", struct.pack("<H", 0)), e(0x00281052, "DS", "-1024"), e(0x00281053, "DS", "2")]
    return dicom_file([e(0x00080016, "UI", dicom.CT), e(0x00100010, "PN", f"Name {patient}"), e(0x00100020, "LO", patient), e(0x00200032, "DS", f"10\\20\\{z}"), *shape, icon, e(0x7FE00010, "OW", samples.astype("<u2").tobytes())], implicit, syntax)


def dose(patient, frames, bits, step, seed):
    samples = np.random.default_rng(seed).integers(0, 60_000, (frames, 2, 3)).astype("<u4" if bits == 32 else "<u2")
    head = [element(0x00080016, "UI", dicom.DOSE), element(0x00100020, "LO", patient), element(0x00200032, "DS", "10\\20\\9"), element(0x00280008, "IS", str(frames)), element(0x00280010, "US", struct.pack("<H", 2)), element(0x00280011, "US", struct.pack("<H", 3)), element(0x00280030, "DS", "2\\1"), element(0x00280100, "US", struct.pack("<H", bits)), element(0x3004000C, "DS", f"0\\{step}"), element(0x3004000E, "DS", "0.5")]
    return dicom_file([*head, element(0x7FE00010, "OW", samples.tobytes())])


def structures(patient, name, points):
    names = [element(0x30060022, "IS", "1") + element(0x30060026, "LO", name)]
    items = [sequence(0x30060040, [contour(points)]) + element(0x30060084, "IS", "1")]
    return dicom_file([element(0x00080016, "UI", dicom.STRUCTURES), element(0x00100020, "LO", patient), sequence(0x30060020, names), sequence(0x30060039, items)])


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    for p, shape, spacing, n in (("a", (5, 4), "2\\1", 3), ("b", (3, 6), "1\\1.5", 2), ("c", (4, 4), "2\\2", 1)):
        (tmp_path / p).mkdir()
        for z in range(n):
            (tmp_path / p / f"s{9 - z}.dcm").write_bytes(image(p, 2.5 * z, rng.integers(100, 1400, shape), spacing, z == 1))
    (tmp_path / "a" / "packed.dcm").write_bytes(image("a", 7.5, np.zeros((5, 4)), syntax="1.2.840.10008.1.2.4.70"))
    (tmp_path / "a" / "broken.dcm").write_bytes(b"\0" * 128 + b"DICM" + b"xx")
    (tmp_path / "a" / "rs.dcm").write_bytes(structures("a", "PTV", [(10, 20, 2.5), (12, 20, 2.5), (12, 24.5, 2.5), (10, 24.5, 2.5)]))
    (tmp_path / "b" / "rs.dcm").write_bytes(structures("b", "External", [(9, 19, 0), (15, 19, 0), (15, 21.5, 0), (9, 21.5, 0)]))
    (tmp_path / "a" / "dose.dcm").write_bytes(dose("a", 4, 32, -3, 2))
    (tmp_path / "b" / "dose1.dcm").write_bytes(dose("b", 2, 16, 2, 3))
    (tmp_path / "b" / "dose2.dcm").write_bytes(dose("b", 3, 16, 2, 4))
    return tmp_path


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_three_patients_in_one_plan(spark, folder):
    together = pt.imported(spark, f"file://{folder}", part_bytes=16)
    grids = {r.patient_id: r for r in together["patients"].collect()}
    doses = {r.patient_id: r for r in together["dose_grids"].collect()}
    assert set(grids) == {"a", "b", "c"} and set(doses) == {"a", "b"}
    for p in "abc":
        alone = dicom.imported(spark, f"file://{folder}/{p}")
        mine = {name: df.where(f"patient_id = '{p}'") for name, df in together.items()}
        g = grids[p]
        assert g.patient_name == f"Name {p}"
        assert ((g.ni, g.nj, g.nk), (g.si, g.sj, g.sk), (g.oi, g.oj, g.ok)) == (alone["grid"].dims, alone["grid"].spacing, alone["grid"].origin)
        for name, columns in (("ct", ("k", "i", "j", "hu", "rho")), ("structures", ("ordinal", "roi", "name", "kind", "priority", "red", "green", "blue")), ("voxels", ("ordinal", "k", "i", "j"))):
            assert rows(mine[name], *columns) == rows(alone[name], *columns), (p, name)
        assert rows(mine["voxels"], "k")
        if alone["dose"] is None:
            assert not rows(mine["dose"], "k")
        else:
            assert rows(mine["dose"], "k", "i", "j", "dose") == rows(alone["dose"], "k", "i", "j", "dose")
            d = doses[p]
            assert ((d.ni, d.nj, d.nk), (d.si, d.sj, d.sk), (d.oi, d.oj, d.ok)) == (alone["dose_grid"].dims, alone["dose_grid"].spacing, alone["dose_grid"].origin)


def test_a_dose_file_is_read_by_several_tasks_and_only_where_asked(spark, folder, monkeypatch):
    frames = pt.dose_frames(pt.last_of(pt.places(spark, f"file://{folder}/a"), dicom.DOSE))
    read = pt.dose_voxels(frames, part_bytes=24)
    assert read.rdd.getNumPartitions() == 4
    assert {r.k: r.n for r in read.groupBy("k").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 6)
    asked = []
    at = pt.read_at
    monkeypatch.setattr(pt, "read_at", lambda path, offset, size: asked.append(size) or at(path, offset, size))
    batches = list(pt._doses(iter(frames.where("k = 1").toArrow().to_batches())))
    assert sum(b.num_rows for b in batches) == 6 and asked == [24]


def test_header_reads_only_first_bytes(folder, monkeypatch):
    """Pixel data stay unread, however long; a header beyond the first bytes is read on."""
    big = folder / "big.dcm"
    big.write_bytes(image("a", 0.0, np.zeros((1000, 1000))))
    ds, (offset, size) = pt._header(f"file:{big}")
    assert size == 2_000_000 and offset + size == big.stat().st_size and dicom.text(ds, 0x00100020) == "a"
    monkeypatch.setattr(pt, "FIRST", 140 + 64)
    assert pt._header(f"file:{big}")[1] == (offset, size)
    with pytest.raises(ValueError):
        pt._header(f"file:{folder}/a/broken.dcm")


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "notes.bin").write_bytes(b"no")
    got = pt.imported(spark, f"file://{tmp_path}")
    assert all(df.count() == 0 for df in got.values())


def test_folders_with_odd_names(spark, tmp_path):
    odd = tmp_path / "Doe Jo 50%20"
    odd.mkdir()
    (odd / "a b.dcm").write_bytes(image("a", 0.0, np.full((2, 2), 700)))
    found = pt.places(spark, str(tmp_path))
    assert [(r.patient_id, r.size) for r in found.collect()] == [("a", 8)]
    slices = pt.ct_slices(found)
    assert [r.hu for r in pt.ct_voxels(slices, pt.patients(slices)).collect()] == [376] * 4
