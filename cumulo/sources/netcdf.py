"""Classic NetCDF day files: a decoder of their bytes, and a data source that plans one partition a day file.

    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("rain_days").option("path", folder).load().where("day >= '2020-06-01' AND lat > -5")

Filters on ``day`` choose the files, filters on ``lat`` and ``lon`` the cells that leave a file; Spark refuses the source without the
setting that hands them over.  Folders are reached by pyarrow's file systems (local, HDFS, S3, ...), from the driver and from the executors.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cumulo.functions.constants import STEPS_PER_DAY

# Fixed values of the classic format: tags of the header's lists, and types by number.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8"}
DAY_FILE = re.compile(r"_(\d{8})_\d{7}_halfhourly\.nc4?$")
FILL_BELOW = -100.0


@dataclass
class Variable:
    """Names of the dimensions, attributes and values of a variable."""

    dims: tuple[str, ...]
    attributes: dict
    values: np.ndarray


class _Header:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4

    def number(self, kind: str = ">i") -> int:
        (value,) = struct.unpack_from(kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return value

    def text(self) -> str:
        n = self.number()
        value = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return value

    def entries(self, tag: int) -> range:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ValueError("not a classic NetCDF header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.entries(ATTRIBUTES):
            name, kind, n = self.text(), TYPES[self.number()], self.number()
            raw = self.data[self.at : self.at + n * np.dtype(kind).itemsize]
            self.at += -(-len(raw) // 4) * 4
            values = np.frombuffer(raw, f">{kind}" if kind != "S1" else kind)
            out[name] = raw.decode(errors="replace") if kind == "S1" else values.astype(kind).tolist()
        return out


def decode(data: bytes) -> dict[str, Variable]:
    """Variables of a classic NetCDF file (32- or 64-bit offsets) by name."""
    if data[:4] not in (b"CDF\x01", b"CDF\x02"):
        raise ValueError("not a classic NetCDF file; other formats need a decoder of their own")
    h = _Header(data)
    records = h.number()
    dims = [(h.text(), h.number()) for _ in h.entries(DIMENSIONS)]
    h.attributes()
    found = []
    for _ in h.entries(VARIABLES):
        name = h.text()
        own = [h.number() for _ in range(h.number())]
        attributes, kind = h.attributes(), np.dtype(f">{TYPES[h.number()]}")
        size = h.number()
        begin = h.number(">q" if data[3] == 2 else ">i")
        found.append((name, own, attributes, kind, size, begin))
    moving = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
    step = sum(v[4] for v in moving) if len(moving) > 1 else sum(int(np.prod([dims[d][1] for d in v[1][1:]])) * v[3].itemsize for v in moving)
    out = {}
    for name, own, attributes, kind, _, begin in found:
        shape = [dims[d][1] for d in own]
        if own and shape[0] == 0:
            shape[0] = records
            row = int(np.prod(shape[1:]))
            values = np.stack([np.frombuffer(data, kind, row, begin + k * step).reshape(shape[1:]) for k in range(records)]) if records else np.zeros(shape, kind)
        else:
            values = np.frombuffer(data, kind, int(np.prod(shape)), begin).reshape(shape)
        out[name] = Variable(tuple(dims[d][0] for d in own), attributes, values.astype(kind.newbyteorder("=")) if kind.kind != "S" else values)
    return out


def rain(data: bytes, variable: str = "precipitation") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates by time, latitude and longitude, latitudes, longitudes) of a day file; fill values are NaN, latitudes rise."""
    held = decode(data)
    v = held[variable]
    rates = np.transpose(v.values, [v.dims.index(d) for d in ("time", "lat", "lon")]).astype(float)
    for fill in v.attributes.get("_FillValue", []):
        rates[rates == fill] = np.nan
    rates[rates < FILL_BELOW] = np.nan
    lat, lon = held["lat"].values.astype(float), held["lon"].values.astype(float)
    order = np.argsort(lat, kind="stable")
    return rates[:, order], lat[order], lon


@dataclass
class DayFile(InputPartition):
    day: date
    path: str


class DayReader(DataSourceReader):
    def __init__(self, path: str, variable: str) -> None:
        self.path, self.variable = path, variable
        self.days, self.area = [date.min, date.max], {"lat": [], "lon": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Days choose files; what is asked of coordinates is kept for reading.  Filters of coordinates and open ends of days are checked by Spark again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            bound = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if name == "day" and bound:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.days[0] = max(self.days[0], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.days[1] = min(self.days[1], f.value)
            elif name in self.area and bound:
                self.area[name].append((type(f).__name__, float(f.value)))
            yield f

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system, system.get_file_info(fs.FileSelector(root, recursive=True))

    def partitions(self) -> list[DayFile]:
        """One partition a day file; an error if the folder holds none at all."""
        named = [(f.path, m[1]) for f in self._files()[1] if (m := DAY_FILE.search(f.path))]
        if not named:
            raise FileNotFoundError(f"no day file in {self.path}")
        chosen = [DayFile(date(int(d[:4]), int(d[4:6]), int(d[6:])), p) for p, d in sorted(named)]
        return [f for f in chosen if self.days[0] <= f.day <= self.days[1]]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        with self._files()[0].open_input_stream(partition.path) as f:
            rates, lat, lon = rain(f.read(), self.variable)
        tests = {"EqualTo": np.equal, "GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal, "LessThan": np.less, "LessThanOrEqual": np.less_equal}
        keep = {n: np.logical_and.reduce([np.ones(len(v), bool), *(tests[t](v, x) for t, x in self.area[n])]) for n, v in (("lat", lat), ("lon", lon))}
        ys, xs = np.flatnonzero(keep["lat"]), np.flatnonzero(keep["lon"])
        first = (partition.day - date(1970, 1, 1)).days * STEPS_PER_DAY
        for t, frame in enumerate(rates):
            y, x = (a.ravel() for a in np.meshgrid(ys, xs, indexing="ij"))
            columns = [pa.array(np.full(len(y), first + t, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(lat[y]), pa.array(lon[x]), pa.array(frame[y, x]), pa.array([partition.day] * len(y), pa.date32())]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "y", "x", "lat", "lon", "r", "day"])


class DayFiles(DataSource):
    """``rain_days``: (t, y, x, lat, lon, r, day) of the day files under ``path``, NaN where a rate is missing; ``variable`` names the rates."""

    @classmethod
    def name(cls) -> str:
        return "rain_days"

    def schema(self) -> str:
        return "t int, y int, x int, lat double, lon double, r double, day date"

    def reader(self, schema) -> DayReader:
        return DayReader(self.options["path"], self.options.get("variable", "precipitation"))
