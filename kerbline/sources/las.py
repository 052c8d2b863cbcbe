"""LAS point clouds as a Spark data source: ``spark.read.format("las").load(path)``.

Reads formats 0 to 3 of versions 1.2 to 1.4 (others raise); each file is cut into ranges of records, so
a large tile is read by many tasks. Writing gives a folder with one valid LAS 1.2 file for each
partition. Options: ``records`` (records in a range), ``rgb_scale`` (256 or 257, for 16-bit colours),
``scale`` (metres of a step, default 0.001), ``max_points`` (the first so many of each file).

``las_header`` reads headers only: bounds, counts, scales. Paths must be reachable by all executors.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "tile string, pid long, x double, y double, z double, intensity int, return_number byte, num_returns byte, classification byte, scan_angle byte, gps_time double, r int, g int, b int"
HEADER = "tile string, path string, version string, format int, n_points long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double"
_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_RGB = [("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
FORMATS = {0: _BASE, 1: [*_BASE, ("gps_time", "<f8")], 2: [*_BASE, *_RGB], 3: [*_BASE, ("gps_time", "<f8"), *_RGB]}


@dataclass
class Header:
    path: str
    version: tuple[int, int]
    offset: int
    format: int
    length: int
    n: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    bounds: tuple[float, ...]

    @property
    def tile(self) -> str:
        return os.path.splitext(os.path.basename(self.path))[0]


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    version = h[24], h[25]
    offset, _, kind, length, n = struct.unpack_from("<IIBHI", h, 96)
    kind &= 0x3F
    if version >= (1, 4) and len(h) >= 255:
        n = n or struct.unpack_from("<Q", h, 247)[0]
    if kind not in FORMATS:
        raise ValueError(f"{path}: point format {kind} is not read")
    v = struct.unpack_from("<12d", h, 131)
    return Header(path, version, offset, kind, length, n, v[0:3], v[3:6], v[6:12])


def _files(options: dict) -> list[str]:
    path = options.get("path", "")
    return sorted(glob.glob(os.path.join(path, "*.las"))) if os.path.isdir(path) else sorted(glob.glob(path))


@dataclass
class Records(InputPartition):
    header: Header
    first: int
    n: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Records]:
        step, most = int(self.options.get("records", 2_000_000)), int(self.options.get("max_points", 1 << 62))
        out = []
        for h in map(read_header, _files(self.options)):
            n = min(h.n, most)
            out += [Records(h, a, min(step, n - a)) for a in range(0, n, step)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        h, scale = partition.header, int(self.options.get("rgb_scale", 256))
        names = FORMATS[h.format]
        size = np.dtype(names).itemsize
        dtype = np.dtype([*names, ("rest", f"V{h.length - size}")] if h.length > size else names)
        with open(h.path, "rb") as f:
            f.seek(h.offset + partition.first * h.length)
            for a in range(0, partition.n, 200_000):
                m = min(200_000, partition.n - a)
                p = np.frombuffer(f.read(m * h.length), dtype)
                nothing = lambda kind: pa.nulls(m, kind)  # noqa: E731, B023
                colour = [pa.array((p[c] // scale).astype(np.int32)) if c in p.dtype.names else nothing(pa.int32()) for c in "rgb"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h.tile] * m),
                        pa.array(np.arange(partition.first + a, partition.first + a + m)),
                        *(pa.array(p[c].astype(np.float64) * s + o) for c, s, o in zip("XYZ", h.scale, h.shift, strict=True)),
                        pa.array(p["intensity"].astype(np.int32)),
                        pa.array((p["flags"] & 7).astype(np.int8)),
                        pa.array((p["flags"] >> 3 & 7).astype(np.int8)),
                        pa.array((p["classification"] & 31).astype(np.int8)),
                        pa.array(p["angle"].astype(np.int8)),
                        pa.array(p["gps_time"].astype(np.float64)) if "gps_time" in p.dtype.names else nothing(pa.float64()),
                        *colour,
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _files(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        h = read_header(partition.value)
        b = h.bounds  # max x, min x, max y, min y, max z, min z
        yield h.tile, h.path, f"{h.version[0]}.{h.version[1]}", h.format, h.n, b[1], b[0], b[3], b[2], b[5], b[4]


@dataclass
class Written(WriterCommitMessage):
    own: str
    path: str
    n: int


class LasWriter(DataSourceArrowWriter):
    """One file for each task, in a folder that driver and executors share. A task writes under the name of its attempt;
    the driver gives the files of successful tasks their names, which are new in every job, and removes those of a
    failed job. Coordinates that do not fit the format's 32 bits at the scale are an error."""

    def __init__(self, options: dict):
        self.options, self.job = options, uuid.uuid4().hex[:12]

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.own, m.path)

    def abort(self, messages: list[Written | None]) -> None:
        for path in glob.glob(os.path.join(glob.escape(self.options["path"]), f".part-{self.job}-*")):
            os.remove(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        folder, step, rgb = self.options["path"], float(self.options.get("scale", 0.001)), int(self.options.get("rgb_scale", 256))
        os.makedirs(folder, exist_ok=True)
        name = f"part-{self.job}-{context.partitionId():05d}.las"
        path, own = os.path.join(folder, name), os.path.join(folder, f".{name}.{context.taskAttemptId()}")
        shift, low, high, n = None, np.full(3, np.inf), np.full(3, -np.inf), 0
        with open(own, "wb") as f:
            f.write(bytes(227))
            for b in batches:
                if not b.num_rows:
                    continue
                xyz = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
                if shift is None:
                    shift = np.floor(xyz.min(0))
                get = lambda c, kind: np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)).astype(kind) if c in b.schema.names else np.zeros(b.num_rows, kind)  # noqa: E731, B023
                p = np.zeros(b.num_rows, FORMATS[3])
                for i, c in enumerate("XYZ"):
                    units = np.rint((xyz[:, i] - shift[i]) / step)
                    if not (np.abs(units) < 1 << 31).all():
                        raise ValueError(f"{c.lower()} does not fit 32 bits at a scale of {step}")
                    p[c] = units
                p["intensity"], p["classification"], p["angle"], p["gps_time"] = get("intensity", "<u2"), get("classification", "u1"), get("scan_angle", "i1"), get("gps_time", "<f8")
                p["flags"] = get("return_number", "u1") & 7 | (get("num_returns", "u1") & 7) << 3
                for c in "rgb":
                    p[c] = np.minimum(get(c, np.int64) * rgb, 65535)
                f.write(p.tobytes())
                n += len(p)
                low, high = np.minimum(low, xyz.min(0)), np.maximum(high, xyz.max(0))
            shift = np.zeros(3) if shift is None else shift
            low, high = (np.zeros(3), np.zeros(3)) if not n else (low, high)
            head = bytearray(227)
            head[:4] = b"LASF"
            head[24:26] = 1, 2
            head[58:66] = b"kerbline"
            struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 3, np.dtype(FORMATS[3]).itemsize, n)
            struct.pack_into("<I", head, 111, n)
            struct.pack_into("<12d", head, 131, *[step] * 3, *shift, *(v for i in range(3) for v in (high[i], low[i])))
            f.seek(0)
            f.write(head)
        return Written(own, path, n)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options))


class LasHeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_header"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
    spark.dataSource.register(LasHeaderSource)


def read_las(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format("las").options(**options).load(path)


def write_las(points: DataFrame, path: str, **options: str | int) -> None:
    register(points.sparkSession)
    points.write.format("las").options(**options).mode("append").save(path)
