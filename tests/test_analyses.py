"""Rank correlation, lags, matched labellings and panels against plain versions; quantiles of many columns; scan lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulo.operators import analyses, climatology, cubes, events, export, geo, panels, segment
from cumulo.plans.selection import select_quantiles


def mid(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_correlation_with_many_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 700).astype(float)
    x[:250] = 3.0
    y = np.round(x + rng.normal(scale=4, size=700), 0)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (2.0, None)], "x double, y double").repartition(7)
    got = analyses.rank_correlation(df, "y", "x").first()
    assert got.n == 700 and got.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and got.spearman == pytest.approx(np.corrcoef(mid(x), mid(y))[0, 1])
    flat = analyses.rank_correlation(df.withColumn("x", F.lit(1.0)), "y", "x").first()
    assert (flat.pearson, flat.spearman) == (None, None) and analyses.rank_correlation(df.where("false"), "y", "x").first().n == 0


def test_lag_scan_finds_the_shift(spark):
    rng = np.random.default_rng(2)
    v = rng.gamma(1, 3, 400)
    a = spark.createDataFrame([(t, float(x)) for t, x in enumerate(v)], "t int, v double")
    b = spark.createDataFrame([(t + 15, float(x + rng.normal(scale=0.5))) for t, x in enumerate(v) if t % 7], "t int, v double")
    rows = {r.lag: r for r in analyses.lag_scan(a, b, list(range(-20, 21)) + [5000]).collect()}
    assert [k for k, r in rows.items() if r.best] == [15] and rows[5000].n == 0 and rows[5000].r is None
    held = {t: x for t, x in b.collect()}
    both = np.array([(v[t], held[t + 4]) for t in range(400) if t + 4 in held])
    assert rows[4].r == pytest.approx(np.corrcoef(both.T)[0, 1]) and rows[4].n == len(both)


def labels(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values) if v is not None], "id long, label long")


def test_labellings_are_matched(spark):
    a = labels(spark, [0, 0, 0, 0, 5, 5, 7, 7, 9, None, 11])
    b = labels(spark, [0, 0, 2, 2, 4, 4, 8, 8, 8, 8, None])
    pairs = analyses.overlaps(a, b)
    got = {(r.a, r.b): (r.n, round(r.share, 3), r.best_for_a, r.best_for_b) for r in pairs.collect()}
    assert got == {(0, 0): (2, 0.5, True, True), (0, 2): (2, 0.5, False, True), (5, 4): (2, 1.0, True, True), (7, 8): (2, 0.5, True, True), (9, 8): (1, 0.25, True, False)}
    assert tuple(analyses.matching(pairs).first()) == (1, 1, 1, 0)
    mixed = analyses.overlaps(labels(spark, [1, 1, 2, 2]), labels(spark, [3, 4, 4, 5]))
    assert tuple(analyses.matching(mixed).first()) == (0, 0, 0, 1)


def test_chunks_cut_what_crosses_them(spark):
    rows = [(t, 1, 1, 5.0) for t in range(40, 60)] + [(t, 4, 4, 5.0) for t in range(10, 14)]
    vox = segment.voxels(spark.createDataFrame(rows, "t int, y int, x int, r double")).cache()
    back = analyses.unchunked(analyses.chunked(vox, 14), 14)
    assert {(r.id, r.t) for r in back.collect()} == {(r.id, r.t) for r in vox.collect()} and back.where("at_edge").count() == 0
    got = {r.chunking: r for r in analyses.chunk_alignment(vox, lambda v: segment.label_ccl(v, 1), {"UTC": 0, "UTC+7": 14}).collect()}
    assert (got["continuous"].storms, got["UTC"].storms, got["UTC+7"].storms) == (2, 3, 2)
    assert (got["UTC"].one_to_one, got["UTC"].split, got["UTC+7"].one_to_one) == (1, 1, 2)
    assert got["UTC"].truncated_share == pytest.approx(2 / 3) and got["UTC+7"].truncated_share == 0.0
    assert got["UTC"].max_duration_h == 6.0 and got["continuous"].max_duration_h == 10.0


def test_quantiles_of_many_columns_are_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in ("a", "b", None):
        n = 900 if g == "a" else 60
        rows += [(g, float(x), float(y), float(z)) for x, y, z in zip(rng.gamma(0.3, 50, n), np.round(rng.normal(size=n), 1), np.repeat([1e300, -1e300, 5.0], n // 3))]
    rows += [("c", 1.5, None, 2.0), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(6)
    wanted = {"x50": ("x", 0.5), "x99": ("x", 0.99), "y37": ("y", 0.37), "z0": ("z", 0.0), "z100": ("z", 1.0), "x95": ("x", 0.95)}
    exact = df.groupBy("g").agg(*[F.expr(f"percentile({c}, {q})").alias(n) for n, (c, q) in wanted.items()])
    want = {r.g: tuple(r)[1:] for r in exact.collect() if r.g != "d"}
    for bins, few in ((4, 3), (1024, 4096)):
        got = {r.g: tuple(r)[1:] for r in select_quantiles(df, wanted, ["g"], bins, few).collect()}
        assert got == want
        whole = select_quantiles(df, wanted, None, bins, few).collect()
        assert [tuple(r) for r in whole] == [tuple(r) for r in df.agg(*[F.expr(f"percentile({c}, {q})").alias(n) for n, (c, q) in wanted.items()]).collect()]


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = np.random.default_rng(5)
    rows = [(2000 + int(y), int(m), float(a), float(o), 0.5 * int(d), float(v), float(i), bool(t), bool(s)) for y, m, a, o, d, v, i, t, s in zip(rng.integers(0, 3, 800), rng.integers(1, 13, 800), rng.uniform(-5, 5, 800), rng.uniform(100, 106, 800), rng.integers(1, 40, 800), rng.gamma(1, 2, 800), rng.gamma(2, 9, 800), rng.random(800) < 0.1, rng.random(800) < 0.1)]
    rows.append((2000, 1, None, None, 1.0, 1.0, 1.0, False, False))
    return spark.createDataFrame(rows, "year int, month int, wcentroid_lat double, wcentroid_lon double, duration_h double, total_volume_km3 double, max_intensity_mm_hr double, truncated_time boolean, truncated_space boolean")


def test_panels_are_the_separate_queries(spark, catalogue, tmp_path):
    catalogue.write.parquet(f"file://{tmp_path}/cat")
    table = panels.panels(spark.read.parquet(f"file://{tmp_path}/cat"))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand [") == 1 and plan.count("Relation [") == 1
    table = table.cache()
    years = {r.year: (r.untruncated, r.untruncated_km3) for r in panels.panel(table, "year").collect()}
    assert years == {r.year: (r.storms, r.volume_km3) for r in climatology.by_year(catalogue).collect()}
    months = panels.panel(table, "year_month")
    assert months.columns[:2] == ["year", "month"] and months.count() == catalogue.select("year", "month").distinct().count()
    assert {(r.glat, r.glon, r.month, r.storms) for r in panels.panel(table, "cell_month").collect()} == {tuple(r) for r in catalogue.where("wcentroid_lat IS NOT NULL").groupBy(F.floor("wcentroid_lat").cast("double"), F.floor("wcentroid_lon").cast("double"), "month").count().collect()}
    whole = panels.panel(table, "all").first()
    assert whole.storms == 801 and whole.months == 12


def test_scan_lines_are_the_even_odd_rule(spark):
    rng = np.random.default_rng(6)
    cells = [(y, x, -2.0 + 0.25 * y, 100.0 + 0.5 * x) for y in range(24) for x in range(20)]
    shapes = [(k, f"s{k % 5}", [(float(a), float(o)) for a, o in zip(rng.uniform(-3, 5, n), rng.uniform(98, 112, n))]) for k, n in enumerate([3, 4, 5, 7, 9, 12])]
    shapes += [(20, "line", [(0.0, 101.0), (0.0, 105.0)]), (21, "far", [(50.0, 1.0), (51.0, 2.0), (50.0, 3.0)]), (22, "grid", [(0.0, 102.0), (0.0, 104.0), (1.0, 104.0), (1.0, 102.0)])]

    def held(lat, lon, ring):
        return sum((p[0] > lat) != (q[0] > lat) and lon < p[1] + (lat - p[0]) / (q[0] - p[0]) * (q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1])) % 2

    want = {(y, x): next((n for _, n, ring in sorted(shapes, reverse=True) if len(ring) > 2 and held(a, o, ring)), None) for y, x, a, o in cells}
    grid = spark.createDataFrame(cells, "y int, x int, lat double, lon double").repartition(3)
    made = spark.createDataFrame(shapes, "order int, name string, ring array<struct<lat:double,lon:double>>")
    assert {(r.y, r.x): r.name for r in geo.rasterise(grid, made).collect()} == want
    assert geo.rasterise(grid, made.where("false")).where("name IS NOT NULL").count() == 0 and geo.rasterise(grid.where("false"), made).count() == 0


def test_extremes_displacement_in_a_box_and_bands(spark):
    steps = spark.createDataFrame([(1, 3, 5.0, 10.0), (1, 4, 9.0, 8.0), (1, 5, 9.0, 12.0), (1, 6, 1.0, 12.0)], "label long, t int, peak_mm_hr double, area_km2 double")
    assert tuple(export.step_extremes(steps).first()) == (1, 4, 9.0, 5, 12.0)
    values = np.zeros((2, 20, 24))
    values[0, 4:12, 4:14] = np.random.default_rng(1).gamma(1, 6, (8, 10))
    values[1] = np.roll(values[0], (1, 2), (0, 1))
    values[1, 15:, :] = 60.0
    cube = spark.createDataFrame([(int(t), int(y), int(x), float(values[t, y, x])) for t, y, x in np.ndindex(values.shape)], "t int, y int, x int, r double")
    assert [tuple(r) for r in cubes.displacement(cube, 20, 24, box=(2, 15, 2, 18)).collect()] == [(0, 1, 2)]
    fam = spark.createDataFrame([(float(i), float(100 - i)) for i in range(100)] + [(None, 4.0)], "volume_km3 double, max_intensity_mm_hr double")
    got = {r.low_rate: (r.lowest_share, r.highest_share) for r in events.band_sensitivity(fam, 10.0, ((5.0, 1.0), (8.0, 6.0))).collect()}
    for low, high in ((5.0, 1.0), (8.0, 6.0)):
        v, i = sorted(range(100), reverse=True), sorted([*range(1, 101), 4], reverse=True)
        v0, v1, i0, i1 = v[int(low * 10) - 1], v[min(int(high * 10), 100) - 1], i[int(low * 10) - 1], i[int(high * 10) - 1]
        both = [(float(k), float(100 - k)) for k in range(100)]
        assert got[low] == (sum(a < v0 and b < i0 for a, b in both) / 101, sum(a >= v1 and b >= i1 for a, b in both) / 101)


def test_a_range_is_guarded_while_it_is_read(spark, tmp_path):
    from datetime import date

    from cumulo.operators.checks import RangeGuard

    first, begin = date(2020, 1, 1), (date(2020, 1, 1) - date(1970, 1, 1)).days * 48
    whole = spark.createDataFrame([(begin + t, y, x, 0.1 * t, float(y)) for t in range(96) for y in range(2) for x in range(3)], "t int, y int, x int, r double, lat double")
    whole.write.parquet(f"file://{tmp_path}/cube")
    whole = spark.read.parquet(f"file://{tmp_path}/cube")
    guard = RangeGuard(first, date(2020, 1, 2), 2, 3)
    rows = guard.attach(whole)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert rows.agg(F.sum("r")).first()[0] == pytest.approx(0.1 * sum(range(96)) * 6) and guard.verify()["cells"] == 96 * 6

    def broken(df, message, dense=True):
        guard = RangeGuard(first, date(2020, 1, 2), 2, 3)
        guard.attach(df).agg(F.max("r")).collect()
        with pytest.raises(ValueError, match=message):
            guard.verify(dense)

    broken(whole.where(f"t <> {begin + 50}"), "95 steps, expected 96")
    broken(whole.where(f"t <> {begin + 50} OR y = 0"), "573 cells on a grid of 2 x 3")
    broken(whole.where("y = 0"), "grid of 1 x 3")
    broken(whole.withColumn("r", F.when(F.col("x") < 2, F.lit(float("nan"))).otherwise(F.col("r"))), "66.7% of the rates are missing")
    broken(whole.withColumn("lat", -F.col("lat")), "latitudes fall")
    sparse = RangeGuard(first, date(2020, 1, 2), 2, 3)
    sparse.attach(whole.where("x > 0")).count()
    assert sparse.verify(dense=False)["cells"] == 96 * 4
    with pytest.raises(Exception, match="is outside of the range"):
        RangeGuard(first, first, 2, 3).attach(whole).agg(F.max("t")).collect()


def test_edges_of_regions_with_repeated_volumes_and_no_sort_of_the_domain(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a) if a < 3 else None, float(v)) for a, v in zip(rng.integers(0, 4, 4000), rng.integers(0, 900, 4000) ** 2 // 90)] + [(1, None), (2, 5000.0), (2, 5000.0)]
    cat = spark.createDataFrame(rows, "region int, total_volume_km3 double")
    got = {(r.domain, r.region): r[2:] for r in analyses.regional_edges(cat, 2.5, (300.0, 3.0)).collect()}
    held = {(False, g): sorted((v for a, v in rows if a == g and v is not None), reverse=True) for g in (0, 1, 2, None)}
    held[True, None] = sorted((v for _, v in rows if v is not None), reverse=True)
    edge = lambda of, k: held[of][min(k, len(held[of])) - 1]
    assert got == {of: (len(held[of]) / 2.5, edge(of, 750), edge(of, 8), edge(of, 8) / edge((True, None), 8)) for of in held}
    assert analyses.regional_edges(cat.where("false"), 1.0).count() == 0
    plan = analyses.regional_edges(cat, 2.5, (300.0, 3.0))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan  # before, every row went to its region and to the domain, which one task sorted


def test_speeds_are_made_once(spark):
    landed = spark.range(1, 41).selectExpr("double(20 * id) AS offshore_km_at_start", "0.5D * (id % 4) AS hours_at_sea")
    got = analyses.propagation_speed(landed)
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    speeds = [20 * i / (0.5 * (i % 4)) for i in range(1, 41) if i % 4]
    assert tuple(got.first()) == pytest.approx((len(speeds), *np.quantile(speeds, [0.25, 0.5, 0.75])))
