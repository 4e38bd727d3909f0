"""Phase-space files: header parser, record layout, and a source that reads byte ranges in parallel."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: The optional floats of a record, in the order of the header's flags: with the energy's own flag first and the sign of w on the energy, or as the format's publication has it, energy always stored and the sign of w on the type.
LAYOUTS = {"energy_first": ("energy", "x", "y", "z", "u", "v", "weight"), "standard": ("x", "y", "z", "u", "v", "w", "weight")}
KINDS = ("PHOTONS", "ELECTRONS", "POSITRONS")


@dataclass
class Header:
    """IO-20: what a record holds and how many there are."""

    length: int = 0
    big_endian: bool = False
    flags: tuple[int, ...] = (1, 1, 1, 1, 1, 1, 1)
    extra_floats: int = 0
    extra_longs: int = 0
    particles: int = 0
    constants: dict[str, float] = field(default_factory=dict)
    layout: str = "energy_first"
    counts: dict[str, int] = field(default_factory=dict)
    histories: int = 0
    mean_energy: dict[str, float] = field(default_factory=dict)
    ranges: list[tuple[float, float]] = field(default_factory=list)
    nominal_ssd: float = 0.0
    description: str = ""

    def floats(self) -> list[str]:
        """The stored fields in order; w follows from u and v."""
        stored = [f for f, flag in zip(LAYOUTS[self.layout], self.flags, strict=True) if flag and f != "w"]
        return ["energy", *stored] if self.layout == "standard" else stored

    def record_length(self) -> int:
        """IO-21."""
        return 1 + 4 * (len(self.floats()) + self.extra_floats) + 4 * self.extra_longs

    def dtype(self) -> np.dtype:
        """IO-22: byte order by the header."""
        f, i = (">f4", ">i4") if self.big_endian else ("<f4", "<i4")
        return np.dtype([("type", "i1"), *((n, f) for n in self.floats()), *((f"xf{k}", f) for k in range(self.extra_floats)), *((f"xl{k}", i) for k in range(self.extra_longs))])


def parse_header(text: str, layout: str = "energy_first") -> Header:
    """IO-20, SF-26: sections begin with a ``$KEY:`` line; ``//`` starts a comment; an empty number is 0. A record length unlike that of the contents is warned of."""
    sections: dict[str, list[str]] = {}
    key = None
    for line in text.splitlines():
        if m := re.match(r"\s*\$(\w+):\s*(.*)", line):
            key = m[1].upper()
            sections[key] = []
            line = m[2]
        body = line.split("//")[0].strip()
        if key and body:
            sections[key].append(body)

    def numbers(name: str) -> list[float]:
        return [float(x) for row in sections.get(name, []) for x in row.replace(",", " ").replace("cm", " ").split() if re.fullmatch(r"[-+.\deE]*\d[-+.\deE]*", x)]

    def first(name: str, default: float = 0.0) -> float:
        return (numbers(name) or [default])[0]

    contents = [int(x) for x in numbers("RECORD_CONTENTS")]
    header = Header(length=int(first("RECORD_LENGTH")), big_endian=int(first("BYTE_ORDER", 1234)) != 1234, particles=int(first("PARTICLES")), layout=layout, histories=int(first("ORIG_HISTORIES")), nominal_ssd=first("NOMINAL_SSD"))
    if contents:
        header.flags = tuple((contents + [1] * 7)[:7])
        header.extra_floats, header.extra_longs = (contents[7:9] + [0, 0])[:2] if len(contents) > 7 else (0, 0)
    if layout == "standard":
        constants = iter(numbers("RECORD_CONSTANT"))
        header.constants = {f: next(constants, 0.0) for f, flag in zip(LAYOUTS[layout], header.flags, strict=True) if not flag}
    else:
        header.constants = {"weight": first("RECORD_CONSTANT", 1.0)}
    header.counts = {k: int(first(k)) for k in KINDS if k in sections}
    for row in sections.get("STATISTICAL_INFORMATION_PARTICLES", []):
        words = row.split()
        if len(words) >= 7 and words[6] in KINDS:
            header.mean_energy[words[6]] = float(words[3])
    header.ranges = [tuple(float(x) for x in row.split()[:2]) for row in sections.get("STATISTICAL_INFORMATION_GEOMETRY", [])[:3]]
    header.description = "\n".join(sections.get("COORDINATE_SYSTEM_DESCRIPTION", []))
    if header.length and header.length != header.record_length():
        warnings.warn(f"records of {header.length} bytes are declared, the contents make {header.record_length()}", stacklevel=2)
    return header


def decode(data: bytes, header: Header, first: int, stride: int = 1, file: int = 0) -> pa.RecordBatch:
    """IO-23: centimetres to millimetres; w has the sign of the energy (or of the type, by layout), which is then dropped; unknown types are photons; an energy that is not stored is the type's mean."""
    raw = np.frombuffer(data, header.dtype())
    n = len(raw)
    column = lambda f: raw[f].astype(float) if f in raw.dtype.names else np.full(n, header.constants.get(f, 0.0))
    kind = np.abs(raw["type"].astype(int))
    energy = column("energy")
    if "energy" not in raw.dtype.names:
        photons, electrons, positrons = (header.mean_energy.get(k, 0.0) for k in KINDS)
        energy = np.select([kind == 2, kind == 3], [electrons, positrons], photons)
    down = energy < 0 if header.layout == "energy_first" else raw["type"] < 0
    u, v = column("u"), column("v")
    w = np.sqrt(np.maximum(0.0, 1 - u * u - v * v)) * np.where(down, -1.0, 1.0)
    weight = column("weight") if header.flags[6] else np.full(n, header.constants.get("weight", 1.0) or 1.0)
    arrays = [first + stride * np.arange(n), np.select([kind == 2, kind == 3], [-1, 2], 1).astype(np.int32), column("x") * 10, column("y") * 10, column("z") * 10, u, v, w, np.abs(energy), weight, np.full(n, file, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["rec", "type", "x", "y", "z", "u", "v", "w", "energy", "weight", "file"])


#: Strides of fewer bytes than this are read through; over longer ones each record is read alone.
GAP = 4096


class _Range(InputPartition):
    """The records ``first``, ``first + stride`` and so on, below ``end``, of one file."""

    def __init__(self, file: int, first: int, end: int, stride: int) -> None:
        self.file, self.first, self.end, self.stride = file, first, end, stride


def chosen(total: int, share: int | None) -> tuple[int, int]:
    """IO-25, IO-27: (end, stride) of a file of ``total`` records that gives ``share``: all of them without a share, strided records if it is under half of them, else the head."""
    if share is None:
        return total, 1
    if 2 * share < total:
        stride = max(1, total // max(share, 1))
        return min(total, stride * share), stride
    return min(total, share), 1


def shares(total: int, files: int) -> list[int]:
    """IO-27: equal parts, the remainder to the first files."""
    return [total // files + (i < total % files) for i in range(files)]


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.bases = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.rows, self.gap = int(options.get("rows_per_partition", 1_000_000)), int(options.get("gap", GAP))
        self.quota = int(options["particles"]) if "particles" in options else None
        self.headers, self.totals = [], []
        for base in self.bases:
            system, path = _opened(base)
            with system.open_input_stream(path + ".IAEAheader") as f:
                self.headers.append(parse_header(f.read().decode("latin-1"), options.get("layout", "energy_first")))
            self.totals.append(system.get_file_info(path + ".IAEAphsp").size // self.headers[-1].record_length())
        self.files, self.low, self.high = set(range(len(self.bases))), 0, None

    def partitions(self) -> list[InputPartition]:
        """Records are chosen here, so that a task reads its own only."""
        quota = [None] * len(self.bases) if self.quota is None else shares(self.quota, len(self.bases))
        found: list[InputPartition] = []
        for file in sorted(self.files):
            end, stride = chosen(self.totals[file], quota[file])
            first = -(-max(self.low, 0) // stride) * stride
            end = end if self.high is None else min(end, self.high + 1)
            step = self.rows * stride
            found += [_Range(file, i, min(i + step, end), stride) for i in range(first, end, step)]
        return found

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        """IO-24: one range of records, in pieces; Spark asks for None where there are no partitions."""
        if partition is None:
            return
        header, stride = self.headers[partition.file], partition.stride
        size = header.record_length()
        system, path = _opened(self.bases[partition.file])
        alone = stride > 1 and stride * size >= self.gap
        piece = 10_000 * stride if alone else max(1, 100_000 // stride) * stride
        with system.open_input_file(path + ".IAEAphsp") as f:
            for first in range(partition.first, partition.end, piece):
                end = min(first + piece, partition.end)
                if alone:
                    data = b"".join(self._at(f, i * size, size) for i in range(first, end, stride))
                else:
                    data = self._at(f, first * size, (end - first) * size)
                    if stride > 1:
                        data = np.frombuffer(data, np.uint8).reshape(-1, size)[::stride].tobytes()
                yield decode(data, header, first, stride, partition.file)

    @staticmethod
    def _at(f, at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)


class _FilteredReader(_Reader):
    """Takes over what a filter says of ``rec`` and ``file``; Spark applies the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        if name == ("file",) and isinstance(f, EqualTo | In):
            self.files &= set(value) if isinstance(f, In) else {value}
        elif name in (("rec",), ("file",)) and isinstance(f, IsNotNull):
            pass  # they never are
        elif name == ("rec",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)
        else:
            return False
        return True


class PhaseSpaceSource(DataSource):
    """``spark.dataSource.register(PhaseSpaceSource)``, then ``spark.read.format("phase_space").load(base)``: a base path without extension that all executors reach; or ``phase_space``.

    Options: ``files``, a JSON list of base paths instead; ``particles``, how many all files give together (IO-27);
    ``layout``; ``rows_per_partition``; ``gap`` in bytes (``GAP``); ``push``, to take filters on rec and file.
    rec numbers a file's records from 0; an empty file gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "phase_space"

    def schema(self) -> str:
        return "rec long, type int, x double, y double, z double, u double, v double, w double, energy double, weight double, file int"

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredReader if self.options.get("push", "").lower() == "true" else _Reader)(self.options)


def phase_space(spark: SparkSession, bases: list[str], particles: int | None = None, layout: str = "energy_first", **options) -> DataFrame:
    """IO-24 to IO-27: records of files of one kind; with ``particles``, so many in equal parts. Filters on rec and file choose what is read where spark.sql.python.filterPushdown.enabled is set."""
    if not bases:
        raise ValueError("no phase-space files")
    spark.dataSource.register(PhaseSpaceSource)
    options |= {"files": json.dumps(list(bases)), "layout": layout, "push": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    if particles is not None:
        options["particles"] = particles
    return spark.read.format("phase_space").options(**options).load()


def scoring_plane(base: str, layout: str = "energy_first") -> float:
    """The middle of the header's range of z, in cm."""
    system, path = _opened(base)
    with system.open_input_stream(path + ".IAEAheader") as f:
        ranges = parse_header(f.read().decode("latin-1"), layout).ranges
    if len(ranges) < 3:
        raise ValueError(f"no range of z in the header of {base}")
    return sum(ranges[2]) / 2
