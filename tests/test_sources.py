import json
import struct

import numpy as np
import pytest

from raysheaf.sources import dicom, iaea
from raysheaf.sources import tables as so

HEADER = """$RECORD_CONTENTS:
1 // X
1 // Y
1 // Z
1 // U
1 // V
1 // W
0 // Weight
0
0
$RECORD_CONSTANT:
 1.0 // weight
$RECORD_LENGTH:
25
$BYTE_ORDER:
1234
$PARTICLES:
3
"""


def test_phase_space_round_trip(spark, tmp_path):
    records = [(-1, 6.0, 1.0, 2.0, 27.0, 0.0, 0.6), (2, -1.5, 0.5, 0.0, 27.0, 0.0, 0.0), (9, 2.0, 0.0, 0.0, 27.0, 1.0, 1.0)]
    (tmp_path / "beam.IAEAheader").write_text(HEADER)
    (tmp_path / "beam.IAEAphsp").write_bytes(b"".join(struct.pack("<b6f", *r) for r in records))
    header = iaea.parse_header(HEADER)
    assert header.record_length() == 25 and header.particles == 3
    spark.dataSource.register(iaea.PhaseSpaceSource)
    got = spark.read.format("phase_space").option("rows_per_partition", "2").load(str(tmp_path / "beam")).orderBy("rec").collect()
    assert [r.type for r in got] == [1, -1, 1]
    assert abs(got[0].w - 0.8) < 1e-6 and got[1].w == -1.0 and got[2].w == 0.0
    assert got[1].energy == 1.5 and got[0].x == 10.0 and got[0].weight == 1.0
    assert [r.base.rsplit("/", 1)[1] for r in so.phase_space_files(spark, str(tmp_path)).collect()] == ["beam"]


@pytest.fixture
def beam_files(tmp_path):
    """Three files of 1000, 10 and 0 records; x in cm is the record's number."""
    bases = []
    for file, n in enumerate((1000, 10, 0)):
        base = tmp_path / f"b{file}"
        base.with_suffix(".IAEAheader").write_text(HEADER + "$STATISTICAL_INFORMATION_GEOMETRY:\n-5 5\n-4 4\n26 28\n")
        base.with_suffix(".IAEAphsp").write_bytes(b"".join(struct.pack("<b6f", 1, 1.0, i, file, 27.0, 0.0, 0.0) for i in range(n)))
        bases.append(str(base))
    return bases


def records(df):
    return sorted((r.file, r.rec) for r in df.collect() if r.x == 10.0 * r.rec and r.y == 10.0 * r.file)


@pytest.mark.parametrize("gap", (0, 4096))
def test_phase_space_quotas(spark, beam_files, gap):
    """A strided file, a head, an empty file; the same through single reads and through read-over strides."""
    assert records(iaea.phase_space(spark, beam_files)) == [(0, i) for i in range(1000)] + [(1, i) for i in range(10)]
    got = records(iaea.phase_space(spark, beam_files, particles=20, gap=gap, rows_per_partition=3))
    assert got == [(0, 142 * i) for i in range(7)] + [(1, i) for i in range(7)]
    assert records(iaea.phase_space(spark, beam_files, particles=2, gap=gap)) == [(0, 0), (1, 0)]
    assert records(iaea.phase_space(spark, beam_files, particles=0)) == []
    with pytest.raises(ValueError):
        iaea.phase_space(spark, [])
    assert iaea.scoring_plane(beam_files[0]) == 27.0


def test_phase_space_reads_what_is_asked(beam_files, monkeypatch):
    """Bytes read follow the sample and the filters."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

    read = []
    at = iaea._Reader._at
    monkeypatch.setattr(iaea._Reader, "_at", staticmethod(lambda f, place, size: read.append(size) or at(f, place, size)))

    def got(filters=(), **options):
        read.clear()
        reader = iaea._FilteredReader({"files": json.dumps(beam_files), **options})
        left = list(reader.pushFilters(list(filters)))
        rows = [(r["file"], r["rec"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return rows, sum(read) // 25, left

    rows, n, _ = got(particles="20", gap="0")
    assert len(rows) == n == 14
    assert got()[1] == 1010
    rows, n, left = got([IsNotNull(("rec",)), EqualTo(("file",), 0), GreaterThan(("rec",), 99), LessThanOrEqual(("rec",), 104), GreaterThan(("x",), 0.0)])
    assert rows == [(0, i) for i in range(100, 105)] and n == 5 and left == [GreaterThan(("x",), 0.0)]
    rows, n, left = got([In(("file",), (1, 2, 7)), GreaterThanOrEqual(("rec",), 4), LessThan(("rec",), 6)])
    assert rows == [(1, 4), (1, 5)] and n == 2 and not left
    rows, n, _ = got([GreaterThanOrEqual(("rec",), 143), LessThan(("rec",), 500), EqualTo(("file",), 0)], particles="20", gap="0")
    assert rows == [(0, 284), (0, 426)] and n == 2
    assert got([EqualTo(("rec",), -1)])[:2] == ([], 0)


def test_phase_space_filters_are_pushed(spark, beam_files):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = iaea.phase_space(spark, beam_files).where("file = 0 and rec between 10 and 12 and x > 105")
        assert records(df) == [(0, 11), (0, 12)]
        assert "PushedFilters: []" not in df._jdf.queryExecution().toString()
        assert df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_beam_source(spark, beam_files):
    """AK-21: records 0 to 13 lie within a field whose half width at the isocentre is 500 mm."""
    from raysheaf.operators import particles as ps

    rows = iaea.phase_space(spark, beam_files)
    got = ps.beam_source(rows, (1000.0, 1000.0), iaea.scoring_plane(beam_files[0]), 0.0, 0.0, 0.0, 1000.0, (1.0, 2.0, 3.0))
    assert records_of(got) == [(0, i) for i in range(14)] + [(1, i) for i in range(10)]
    first = got.where("file = 0 and rec = 1").first()
    assert (first.x, first.y, first.z) == pytest.approx((11.0, 270.0 - 1000.0 + 2.0, 3.0)) and (first.u, first.v, first.w) == pytest.approx((0.0, 1.0, 0.0))


def records_of(df):
    return sorted((r.file, r.rec) for r in df.select("file", "rec").collect())


def test_matrix_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.25)], "voxel long, bixel long, value double")
    so.save_matrix(d, str(tmp_path / "m"), 2)
    assert sorted(so.load_matrix(spark, str(tmp_path / "m")).collect()) == sorted(d.collect())
    assert so.cache_key("p", 4, 7, 2.5, angles=[0]) != so.cache_key("p", 4, 7, 2.5, angles=[90])
    r = spark.createDataFrame([(1, [2, 3], [0.5, 0.1])], "voxel long, bixels array<long>, values array<double>")
    assert so.from_rows(r).count() == 2


def test_phase_space_layouts():
    """Without z and energy in the records, and with the sign of w on the type."""
    text = HEADER.replace("1 // X", "0 // Ek", 1).replace("1 // U", "1 // U").replace("25\n", "21\n") + "$STATISTICAL_INFORMATION_PARTICLES:\n// w\n 1 1 1 1.25 0.1 6 PHOTONS\n 1 1 1 0.5 0.1 6 ELECTRONS\n$STATISTICAL_INFORMATION_GEOMETRY:\n-5 5\n-4 4\n27 27\n$NOMINAL_SSD:\n100 cm\n$PHOTONS:\n2\n"
    header = iaea.parse_header(text)
    assert header.floats() == ["x", "y", "z", "u", "v"] and header.record_length() == 21
    assert header.mean_energy == {"PHOTONS": 1.25, "ELECTRONS": 0.5} and header.ranges[2] == (27.0, 27.0) and header.nominal_ssd == 100.0 and header.counts == {"PHOTONS": 2}
    got = iaea.decode(struct.pack("<b5f", 1, 1, 2, 3, 0, 0) + struct.pack("<b5f", -2, 1, 2, 3, 0, 0), header, 0).to_pylist()
    assert [r["energy"] for r in got] == [1.25, 0.5] and [r["w"] for r in got] == [1.0, 1.0] and got[0]["z"] == 30.0
    standard = iaea.parse_header(HEADER.replace("1 // Z", "0 // Z").replace("25\n", "21\n").replace("1.0 // weight", "27.0 // z"), "standard")
    assert standard.floats() == ["energy", "x", "y", "u", "v"]
    got = iaea.decode(struct.pack("<b5f", -1, 6, 1, 2, 0, 0.6), standard, 0).to_pylist()[0]
    assert got["z"] == 270.0 and got["w"] == pytest.approx(-0.8) and got["energy"] == 6.0
    with pytest.warns(UserWarning, match="declared"):
        iaea.parse_header(HEADER.replace("25\n", "29\n"))


def test_matrix_is_computed_once(spark, tmp_path):
    d, calls = spark.createDataFrame([(1, 2, 0.5)], "voxel long, bixel long, value double"), []

    def compute():
        calls.append(1)
        return d

    for _ in range(2):
        assert so.matrix_for(spark, f"file://{tmp_path}", "key", compute).collect() == d.collect()
    assert calls == [1]
    (tmp_path / "half").mkdir()
    assert so.matrix_for(spark, f"file://{tmp_path}", "half", compute).count() == 1 and calls == [1, 1]


def test_machine_dialects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"name": "G", "SAD": 1000, "radiationMode": "photons"}, "data": {"energy": 6, "betas": [0.3, 0.2, 0.1, 0.05], "kernel": [{"SSD": 500, "kernel1": [1.0]}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"machine": {"name": "P", "type": "photon", "source_to_isocenter_distance_cm": 100}}))
    a, b = so.machines(spark, str(tmp_path)).orderBy("name").collect()
    assert (a.dialect, a.sad, a.scd, list(a.betas), a.kernels[0].SSD) == ("generic", 1000.0, 500.0, [0.3, 0.2, 0.1], 500.0)
    assert (b.dialect, b.radiation_mode, b.sad, list(b.betas)) == ("phase_space", "photons", 1000.0, [])
    assert (a.mu, a.fwhm, list(a.leaf_widths), a.leaf_resolution, a.field_size, a.dose_rate) == (0.0051, 5.0, [], 0.5, None, 600.0)


def test_whole_machines(spark, tmp_path):
    mlc = {"type": "M120", "num_leaves": 120, "leaf_width_mm": [10.0, 5.0], "interdigitation": True, "leaf_position_resolution_mm": 0.25}
    flat, folder = tmp_path / "machines", tmp_path / "machines" / "P"
    folder.mkdir(parents=True)
    (flat / "machine_photons_G.json").write_text(json.dumps({"meta": {"name": "G"}, "data": {"m": 0.005, "penumbraFWHMatIso": 4, "kernelPos": [0, 1], "primaryFluence": [[0, 1], [5]]}, "constraints": {"leafSpeed": [0, 60]}, "MLC": mlc}))
    (folder / "P.json").write_text(json.dumps({"machine": {"name": "P", "jaws": {"X1_max_cm": 15, "default_field_size_cm": [10, 10]}, "max_field_size_cm": [40, 30], "collimator": {"min_deg": -90, "max_deg": 90, "default_deg": 5}, "MLC": mlc}}))
    g = so.machines(spark, so.machine_file(spark, f"file://{tmp_path}", "photons", "G")).first()
    assert (g.mu, g.fwhm, list(g.kernel_positions), [list(e) for e in g.primary_fluence], list(g.leaf_speed), g.gantry_speed) == (0.005, 4.0, [0.0, 1.0], [[0.0, 1.0]], [0.0, 60.0], None)
    assert (g.mlc_type, g.leaves, list(g.leaf_widths), g.interdigitation, g.leaf_resolution) == ("M120", 120, [10.0, 5.0], True, 0.25)
    p = so.machines(spark, so.machine_file(spark, f"file://{tmp_path}", "photons", "P")).first()
    assert (p.jaws.x1_max, p.jaws.x2_max, list(p.field_size), list(p.collimator_range), p.collimator, p.couch_range) == (150.0, 200.0, [400.0, 300.0], [-90.0, 90.0], 5.0, None)
    with pytest.raises(FileNotFoundError):
        so.machine_file(spark, f"file://{tmp_path}", "photons", "none")


# DICOM files, written here


def element(tag, kind, value, implicit=False):
    value = value.encode() if isinstance(value, str) else value
    value += b"\0" * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if implicit:
        return head + struct.pack("<I", len(value)) + value
    long = kind.encode() in dicom.LONG
    return head + kind.encode() + (b"\0\0" + struct.pack("<I", len(value)) if long else struct.pack("<H", len(value))) + value


def sequence(tag, items, implicit=False, open_=False):
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + (b"" if implicit else b"SQ\0\0")
    n = dicom.OPEN if open_ else sum(8 + len(x) for x in items)
    body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, dicom.OPEN if open_ else len(x)) + x + (struct.pack("<HHI", 0xFFFE, 0xE00D, 0) if open_ else b"") for x in items)
    return head + struct.pack("<I", n) + body + (struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) if open_ else b"")


def dicom_file(elements, implicit=False, syntax=None):
    meta = element(0x00020010, "UI", syntax or dicom.LITTLE[0 if implicit else 1])
    return b"\0" * 128 + b"DICM" + element(0x00020000, "UL", struct.pack("<I", len(meta))) + meta + b"".join(elements)


def ct_slice(z, samples, implicit=False, **more):
    e = lambda *a: element(*a, implicit)
    out = [e(0x00080016, "UI", dicom.CT), e(0x00100010, "PN", "Doe^Jo"), e(0x00100020, "LO", "p1"), e(0x00200032, "DS", f"10\\20\\{z}"), e(0x00280010, "US", struct.pack("<H", 3)), e(0x00280011, "US", struct.pack("<H", 4)), e(0x00280030, "DS", "2\\1"), e(0x00280103, "US", struct.pack("<H", 0)), e(0x00281052, "DS", "-1024"), e(0x00281053, "DS", "2"), e(0x7FE00010, "OW", samples.astype("<u2").tobytes())]
    return dicom_file(out, implicit, **more)


def contour(points, implicit=False):
    return element(0x30060050, "DS", "\\".join(str(c) for p in points for c in p), implicit)


@pytest.fixture
def patient_folder(tmp_path):
    rng = np.random.default_rng(0)
    slices = [rng.integers(600, 1400, 12) for _ in range(3)]
    for n, (z, implicit) in enumerate(((5.0, False), (0.0, True), (2.5, False))):
        (tmp_path / f"s{n}.dcm").write_bytes(ct_slice(z, slices[n], implicit))
    (tmp_path / "packed.dcm").write_bytes(ct_slice(7.5, slices[0], syntax="1.2.840.10008.1.2.4.70"))
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "DICOMDIR").write_text("no")
    (tmp_path / "broken.dcm").write_bytes(b"\0" * 128 + b"DICM" + b"xx")
    square = [(10, 20, 2.5), (13, 20, 2.5), (13, 22.5, 2.5), (10, 22.5, 2.5)]
    for implicit, name in ((False, "a_old"), (True, "rs")):
        names = [element(0x30060022, "IS", str(n), implicit) + element(0x30060026, "LO", x, implicit) for n, x in ((1, "PTV 1"), (2, "Lung"), (1, "PTV late"))]
        items = [element(0x3006002A, "IS", "1\\2\\3", implicit) + sequence(0x30060040, [contour(square, implicit), contour(square[:1] + [(1, 2)], implicit)], implicit, True) + element(0x30060084, "IS", "1", implicit), element(0x30060084, "IS", "9", implicit)]
        (tmp_path / f"{name}.dcm").write_bytes(dicom_file([element(0x00080016, "UI", dicom.STRUCTURES, implicit), sequence(0x30060020, names, implicit, implicit), sequence(0x30060039, items, implicit, not implicit)], implicit))
    dose = np.arange(2 * 2 * 3, dtype="<u4")
    head = [element(0x00080016, "UI", dicom.DOSE), element(0x00200032, "DS", "10\\20\\9"), element(0x00280008, "IS", "2"), element(0x00280010, "US", struct.pack("<H", 2)), element(0x00280011, "US", struct.pack("<H", 3)), element(0x00280030, "DS", "2\\1"), element(0x00280100, "US", struct.pack("<H", 32)), element(0x3004000C, "DS", "0\\-3"), element(0x3004000E, "DS", "0.5"), element(0x7FE00010, "OW", dose.tobytes())]
    (tmp_path / "dose.dcm").write_bytes(dicom_file(head))
    return f"file://{tmp_path}", slices, dose


def test_dicom_import(spark, patient_folder):
    folder, slices, dose = patient_folder
    got = dicom.imported(spark, folder)
    assert [tuple(r) for r in got["patient"].collect()] == [("p1", "Doe^Jo")]
    assert got["grid"].dims == (3, 4, 4) and got["grid"].spacing == (2.0, 1.0, 2.5) and got["grid"].origin == (20.0, 10.0, 0.0)
    hu = {(r.k, r.i, r.j): r.hu for r in got["ct"].collect()}
    for k, n in ((0, 1), (1, 2), (2, 0), (3, None)):
        for p in range(12):
            assert hu[k, p // 4, p % 4] == (0 if n is None else slices[n][p] * 2 - 1024)
    structures = [tuple(r) for r in got["structures"].orderBy("ordinal").collect()]
    assert structures == [(0, 1, "PTV late", "PTV", 1, 1, 2, 3), (1, 9, "Unknown", "OAR", 3, 0, 255, 0), (2, -1, "BODY", "EXTERNAL", 5, 139, 90, 43)]
    voxels = {(r.i, r.j, r.k) for r in got["voxels"].where("ordinal = 0").collect()}
    assert voxels == {(i, j, 1) for i in (0, 1) for j in range(4)}
    assert got["voxels"].where("ordinal = 2").count() > 0
    assert got["dose_grid"].dims == (2, 3, 2) and got["dose_grid"].origin == (20.0, 10.0, 6.0) and got["dose_grid"].spacing[2] == 3.0
    assert {(r.i, r.j, r.k): r.dose for r in got["dose"].collect()} == {(i, j, 1 - f): 0.5 * dose[f * 6 + i * 3 + j] for f in (0, 1) for i in (0, 1) for j in (0, 1, 2)}


def test_dicom_parser_refuses(tmp_path):
    for data in (b"", b"\0" * 200, b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, 999)):
        with pytest.raises(ValueError):
            dicom.parse(data)
    with pytest.raises(ValueError):
        dicom.parse(dicom_file([element(0x00100020, "LO", "abcdef")[:-4]]))


def test_kept_matrix_skips_files_by_voxel_and_by_bixel(spark, tmp_path):
    """Files whose ranges hold a voxel, or a bixel: about the root of all."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "matrix")
    dij = spark.range(0, 40_000).selectExpr("id % 500 * 3 as voxel", "id div 500 + 7 as bixel", "double(id) as value")
    so.save_matrix(dij, path, 64)
    assert sorted(so.load_matrix(spark, path).collect()) == sorted(dij.collect())
    ranges = {"voxel": [], "bixel": []}
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                if (name := meta.row_group(g).column(c).path_in_schema) in ranges:
                    stats = meta.row_group(g).column(c).statistics
                    ranges[name].append((stats.min, stats.max))
    assert len(ranges["voxel"]) >= 32
    for name, values in (("voxel", (0, 300, 747, 1497)), ("bixel", (7, 30, 47, 86))):
        for v in values:
            assert 0 < sum(low <= v <= high for low, high in ranges[name]) <= len(ranges[name]) / 3
    so.save_matrix(dij.limit(0), f"{path}-none", 4)
    assert so.load_matrix(spark, f"{path}-none").count() == 0
