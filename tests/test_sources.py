"""Sources, sinks, the monthly build and the streams."""

import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulo.operators import checks
from cumulo.plans.build import build, event
from cumulo.sources import archive
from cumulo.streaming import rain

STEP0 = (date(2020, 1, 25) - date(1970, 1, 1)).days * 48


@pytest.fixture(scope="module")
def cube(spark):
    """Ten days over a month's end, one storm across midnight on the 1st and one early."""
    rows = [(STEP0 + 48 * d + 12, 0, 0, 0.2) for d in range(10)]
    midnight = STEP0 + 7 * 48
    rows += [(midnight + k, 5 + y, 5 + x, 8.0) for k in range(-4, 8) for y in range(3) for x in range(3)]
    rows += [(STEP0 + 60 + k, 12, 12, 5.0) for k in range(6)]
    df = spark.createDataFrame(rows, archive.CUBE)
    return df.withColumn("day", F.date_from_unix_date(F.floor(F.col("t") / 48).cast("int")))


@pytest.mark.parametrize("method", ["mergetree", "ccl"])
def test_a_storm_over_midnight_has_one_owner(cube, method):
    found = {r.storm_uid: r for r in build(cube, method, grid=(20, 20)).collect()}
    assert len(found) == 2
    by_month = {r.month: r for r in found.values()}
    assert by_month[2].start_time == datetime(2020, 1, 31, 22, 0) and by_month[2].n_timesteps == 12 and by_month[2].end_time == datetime(2020, 2, 1, 3, 30)
    assert by_month[1].start_time == datetime(2020, 1, 26, 6, 0) and by_month[1].n_voxels == 6
    assert not any(r.truncated_time or r.truncated_space for r in found.values())


def test_unknown_names(spark, cube):
    with pytest.raises(ValueError):
        build(cube, "guess")
    with pytest.raises(ValueError):
        archive.get_source("guess", spark)
    with pytest.raises(NotImplementedError):
        archive.get_source("gee", spark).days(date(2020, 1, 1), date(2020, 1, 1))


def test_days_are_kept_and_missing_ones_are_errors(spark, cube, tmp_path):
    path = f"file://{tmp_path}/cube"
    archive.keep_days(cube, path)
    archive.keep_days(cube.where("day = '2020-01-26'").withColumn("r", F.lit(9.0)), path)
    source = archive.get_source("parquet", spark, path)
    assert archive.kept_days(spark, path).count() == 10
    rows = archive.load_range(source, date(2020, 1, 25), date(2020, 1, 27))
    assert rows.where("day = '2020-01-26'").select("r").distinct().collect()[0][0] == 9.0
    assert rows.where("day = '2020-01-25'").count() == 1
    with pytest.raises(FileNotFoundError):
        archive.load_range(source, date(2020, 1, 25), date(2020, 2, 9))


def test_catalogue_round_trip(spark, cube, tmp_path):
    storms = build(cube, "ccl").cache()
    path = f"file://{tmp_path}/catalogue"
    archive.write_catalogue(storms, path, {"product": "final", "prominence": 4.0, "method": "ccl"})
    archive.write_catalogue(storms.where("month = 2"), path, {"product": "final", "prominence": 4.0, "method": "ccl"})
    back = archive.read_catalogue(spark, path, columns=["storm_uid", "param_method", "year"])
    assert back.count() == 2 and archive.months_built(spark, path).count() == 2
    assert archive.read_catalogue(spark, path, exclude_years=(2020,)).count() == 0
    checks.same_parameters(archive.read_catalogue(spark, path), ["param_method"])


def test_archive_files(spark, tmp_path):
    for name, head in (("p_20200101_0000000_halfhourly.nc4", b"\x89HDF\r\n\x1a\n"), ("p_20200102_0000000_halfhourly.nc4", b"<html>  "), ("notes.nc4", b"CDF\x01....")):
        (tmp_path / name).write_bytes(head + np.arange(8, dtype="f4").tobytes())
    source = archive.get_source("local", spark, str(tmp_path), decode=lambda b: np.frombuffer(b, "f4", offset=8).reshape(2, 2, 2))
    assert sorted(r.day for r in source.index().collect()) == [date(2020, 1, 1), date(2020, 1, 2)]
    assert archive.bad_files(spark, str(tmp_path)).count() == 1
    rows = source.days(date(2020, 1, 1), date(2020, 1, 1)).collect()
    assert len(rows) == 8 and max(r.r for r in rows) == 7.0 and {r.t % 48 for r in rows} == {0, 1}


def test_streams(spark, tmp_path):
    rows = [(datetime(2020, 1, d, h, m), 3, 4, 2.0) for d in (1, 2, 5) for h in (0, 1, 9) for m in (0, 30)]
    table = spark.createDataFrame(rows, "ts timestamp, y int, x int, r double")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make in (("totals", rain.daily_totals), ("spells", rain.wet_spells)):
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "totals" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("totals").count() == 3
    assert {r.steps for r in spark.table("spells").collect()} <= {2, 4} and rain.wet_spells(table).count() == 6


def test_months_that_are_built_are_left_out(spark, cube):
    first = spark.createDataFrame([(2020, 1)], "year int, month int")
    assert [r.month for r in build(cube, "ccl", built=first).collect()] == [2]


def test_an_event_is_segmented_once_with_its_ends_padded(spark, cube):
    found = event(cube, "2020-01-31", "2020-02-01", (0.0, 5.0, 90.0, 110.0), min_voxels=2).collect()
    assert [(r.n_timesteps, r.in_box) for r in found] == [(12, False)]
    assert event(cube, "2020-01-26", "2020-01-26", min_voxels=2).first().in_box and event(cube, "2020-01-28", "2020-01-29", min_voxels=2).count() == 0


def test_sidecars_tables_and_places(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/catalogue"
    archive.write_meta(spark, path, {"prominence": np.float64(4.0), "min_voxels": np.int64(6), "method": "ccl"})
    told = json.loads(spark.read.text(f"{path}.meta.json").first()[0])
    assert told["meta"] == {"prominence": 4.0, "min_voxels": 6, "method": "ccl"} and told["rows"] == []
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    archive.write_table(rows, f"file://{tmp_path}/table", ("k",))
    archive.write_csv(rows, f"file://{tmp_path}/csv")
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == 2 and spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["n", "k"]
    for name, n in (("few", 1), ("many", 3)):
        (tmp_path / name).mkdir()
        for k in range(n):
            (tmp_path / name / f"{k}.nc4").write_bytes(b"")
    monkeypatch.delenv("CUMULO_ARCHIVE", raising=False)
    assert archive.archive_folder([str(tmp_path / "few"), str(tmp_path / "many"), str(tmp_path / "none")]).endswith("many")
    with pytest.raises(FileNotFoundError):
        archive.archive_folder([str(tmp_path / "none")])
    monkeypatch.setenv("CUMULO_ARCHIVE", "/elsewhere")
    assert archive.archive_folder([]) == "/elsewhere"
    assert archive.revision(str(tmp_path)) == "unknown"


def test_tables_between_steps_can_be_cleared(spark, tmp_path, monkeypatch):
    from cumulo.plans import shared

    monkeypatch.setattr(shared, "_written", set())
    monkeypatch.setattr(shared, "shared_root", lambda spark: f"file://{tmp_path}")
    shared.materialize(spark.range(3), "one")
    assert shared.materialize(spark.range(4), "two").count() == 4 and len(list(tmp_path.iterdir())) == 2
    assert shared.clear(spark) == 2 and not list(tmp_path.iterdir()) and shared.clear(spark) == 0
