"""Day files as a data source, and catalogues that grow by committed months."""

import struct
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulo.plans import build as plans
from cumulo.sources import archive, commits, netcdf

LAT, LON = np.array([-0.05, 0.05, 0.15]), np.array([100.05, 100.15])


def classic(rates, lat=LAT, lon=LON, version=1, records=True):
    """Bytes of a classic NetCDF file of rates by (time, lon, lat); with ``records`` time is the record dimension and has a variable too."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    fill = struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iif", 5, 1, -9999.9)
    units = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text("mm/hr")
    none, n = struct.pack(">ii", 0, 0), len(rates)
    variables = [("lat", (2,), none, 6, lat.astype(">f8").tobytes()), ("lon", (1,), none, 6, lon.astype(">f8").tobytes())]
    moving = [("time", (0,), units, 4, [struct.pack(">i", k) for k in range(n)]), ("precipitation", (0, 1, 2), fill, 5, [r.astype(">f4").tobytes() for r in rates])]
    dims = struct.pack(">iii", n if records else 0, 10, 3) + text("time") + struct.pack(">i", 0 if records else n) + text("lon") + struct.pack(">i", len(lon)) + text("lat") + struct.pack(">i", len(lat))
    every = [*variables, *moving]

    def header(begins):
        out = b"CDF" + bytes([version]) + dims + none + struct.pack(">ii", 11, len(every))
        for (name, own, attributes, kind, body), at in zip(every, begins):
            size = len(body[0] if isinstance(body, list) and records else b"".join(body) if isinstance(body, list) else body)
            out += text(name) + struct.pack(f">i{len(own)}i", len(own), *own) + attributes + struct.pack(">ii", kind, -(-size // 4) * 4) + struct.pack(">q" if version == 2 else ">i", at)
        return out

    at, begins, body = len(header([0] * 4)), [], b""
    for _, _, _, _, data in variables:
        begins.append(at + len(body))
        body += data
    if records:
        begins += [at + len(body), at + len(body) + 4]
        body += b"".join(a + b for a, b in zip(*(m[4] for m in moving)))
    else:
        for m in moving:
            begins.append(at + len(body))
            body += b"".join(m[4])
    return header(begins) + body


@pytest.mark.parametrize(("version", "records"), [(1, True), (2, True), (1, False)])
def test_classic_files_are_decoded(version, records):
    rates = np.random.default_rng(1).gamma(1, 3, (4, 2, 3)).astype("f4")
    rates[1, 1, 2] = -9999.9
    got, lat, lon = netcdf.rain(classic(rates, LAT[::-1], version=version, records=records))
    want = np.where(rates < -100, np.nan, rates).transpose(0, 2, 1)[:, ::-1]
    assert np.array_equal(got, want.astype(float), equal_nan=True) and lat.tolist() == LAT.tolist() and lon.tolist() == LON.tolist()
    assert netcdf.decode(classic(rates))["time"].attributes == {"units": "mm/hr"} and netcdf.decode(classic(rates))["time"].values.tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        netcdf.decode(b"\x89HDF\r\n\x1a\n")


@pytest.fixture(scope="module")
def day_files(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("days"), np.random.default_rng(2)
    (folder / "2020").mkdir()
    held = {}
    for k in range(5):
        day = date(2020, 1, 29 + k) if k < 3 else date(2020, 2, k - 2)
        held[day] = rng.gamma(1, 3, (48, 2, 3)).astype("f4")
        (folder / "2020" / f"rain_{day:%Y%m%d}_0000000_halfhourly.nc4").write_bytes(classic(held[day]))
    (folder / "notes.txt").write_text("not a day")
    return folder, held


def test_days_and_areas_reach_the_files(spark, day_files):
    folder, held = day_files
    spark.dataSource.register(netcdf.DayFiles)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("rain_days").load(str(folder))
    assert rows.count() == 5 * 48 * 6 and rows.rdd.getNumPartitions() == 5
    some = rows.where((F.col("day") >= date(2020, 1, 30)) & (F.col("day") < date(2020, 2, 1)) & (F.col("lat") > 0))
    assert some.rdd.getNumPartitions() in (2, 3)  # the open end's file may be planned; its rows aren't there
    got = {(r.day, r.t % 48, r.y, r.x): r.r for r in some.collect()}
    assert got == {(d, t, y, x): float(v) for d in (date(2020, 1, 30), date(2020, 1, 31)) for (t, x, y), v in np.ndenumerate(held[d]) if y > 0}
    one = rows.where(F.col("day") == date(2020, 2, 1))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 48 * 6 and archive.in_area(rows, (-1, 0.1), (100.1, 101)).count() == 5 * 48 * 2
    (folder / "empty").mkdir()
    with pytest.raises(Exception, match="no day file"):
        spark.read.format("rain_days").load(str(folder / "empty")).count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_the_local_source_reads_classic_files(spark, day_files):
    folder, held = day_files
    source = archive.get_source("local", spark, f"file://{folder}/2020")
    rows = archive.load_range(source, date(2020, 1, 29), date(2020, 1, 31))
    assert rows.count() == 3 * 48 * 6
    assert {r.r for r in rows.where("day = '2020-01-30'").collect()} == {float(v) for v in held[date(2020, 1, 30)].ravel()}


@pytest.fixture(scope="module")
def cube(spark):
    step = lambda m, d: (date(2020, m, d) - date(1970, 1, 1)).days * 48
    rows = [(step(m, d) + k, 4, 4 + x, 6.0 + m) for m in (1, 2, 4) for d in (10, 20) for k in range(4) for x in range(3)] + [(step(3, 5), 1, 1, 0.1)]
    return spark.createDataFrame(rows, archive.CUBE).withColumn("day", F.date_from_unix_date(F.floor(F.col("t") / 48).cast("int"))).cache()


PARAMETERS = {"product": "final", "prominence": 4.0}


def key(*months):
    return [("final", 4.0, 2020, m) for m in months]


def test_a_stopped_build_goes_on(spark, cube, tmp_path, monkeypatch):
    path, real, calls = f"file://{tmp_path}/cat", commits.commit, []

    def stops(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return real(*args)

    monkeypatch.setattr(commits, "commit", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        plans.resume(cube, path, PARAMETERS, 2, method="ccl", grid=(20, 20))
    monkeypatch.setattr(commits, "commit", real)
    assert sorted(commits.manifest(spark, path)) == key(1, 2) and commits.read(spark, path).count() == 4
    assert plans.resume(cube, path, PARAMETERS, 2, method="ccl", grid=(20, 20)) == key(3, 4)  # March has no storm and is done
    assert plans.resume(cube, path, PARAMETERS, 2, method="ccl", grid=(20, 20)) == []
    rows = commits.read(spark, path)
    assert {(r.month, r["count"]) for r in rows.groupBy("month").count().collect()} == {(1, 2), (2, 2), (4, 2)} and "param_prominence" in rows.columns


def test_a_broken_month_is_made_again(spark, cube, tmp_path):
    path = f"file://{tmp_path}/cat"
    plans.resume(cube, path, PARAMETERS, method="ccl", grid=(20, 20))
    before = {r.storm_uid for r in commits.read(spark, path).collect()}
    files = {m: list(Path(f"{tmp_path}/cat").glob(f"build=*/**/month={m}/*.parquet")) for m in (1, 2, 4)}
    files[1][0].write_bytes(files[1][0].read_bytes()[:-9])
    (files[1][0].parent / f".{files[1][0].name}.crc").unlink()
    files[4][0].unlink()
    assert commits.broken(spark, path) == key(1, 4)
    assert plans.resume(cube, path, PARAMETERS, method="ccl", grid=(20, 20)) == key(1, 4) and commits.broken(spark, path) == []
    assert {r.storm_uid for r in commits.read(spark, path).collect()} == before


def test_two_builds_cannot_write_one_manifest(spark, cube, tmp_path):
    path = f"file://{tmp_path}/cat"
    assert commits.manifest(spark, path) == {} and commits.read(spark, path) is None and commits.broken(spark, path) == []
    commits._publish(spark, path, {}, 1)
    with pytest.raises(RuntimeError, match="another build"):
        commits._publish(spark, path, {}, 1)
