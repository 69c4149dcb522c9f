"""Known answers and plain versions for the object operators."""

import heapq

import numpy as np
import pytest

from cumulo.operators import cubes, families, geo, mergetree, regions, segment, severity, storms, sweep
from cumulo.plans.graph import connected_components
from cumulo.plans.ranking import kth_largest, quantiles, ranked


def cube_of(spark, values):
    rows = [(int(t), int(y), int(x), float(values[t, y, x])) for t, y, x in np.ndindex(values.shape)]
    return spark.createDataFrame(rows, "t int, y int, x int, r double")


def swept(values, wet):
    """Merge tree by a sweep of the voxels in falling order."""
    flat, found, root, birth, death, parent = values.ravel(), {}, {}, {}, {}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in np.lexsort((np.arange(flat.size), -flat)):
        if flat[i] < wet:
            break
        place = np.array(np.unravel_index(i, values.shape))
        near = set()
        for step in np.ndindex(3, 3, 3):
            p = place + step - 1
            if (p >= 0).all() and (p < values.shape).all() and (j := int(np.ravel_multi_index(p, values.shape))) in found:
                near.add(find(found[j]))
        if not near:
            root[i], birth[i], found[i] = int(i), flat[i], int(i)
            continue
        best = min(near, key=lambda k: (-birth[k], k))
        found[i] = best
        for k in near - {best}:
            root[k], death[k], parent[k] = best, flat[i], best
    return {(int(k), birth[k], death.get(k, wet), parent.get(k, -1)) for k in birth}


@pytest.mark.parametrize("seed", [0, 1])
def test_merge_tree_is_the_sweeps(spark, seed):
    values = np.random.default_rng(seed).gamma(1.2, 2.5, (5, 6, 6))
    values = np.round(values) if seed else values
    components, _ = mergetree.build(segment.voxels(cube_of(spark, values)))
    assert {(r.comp_id, r.birth, r.death, r.parent) for r in components.collect()} == swept(values, 1.0)


def near(place, shape, steps):
    for step in steps:
        p = place + step
        if (p >= 0).all() and (p < shape).all():
            yield int(np.ravel_multi_index(p, shape))


SIDES = [np.array(s) - 1 for s in np.ndindex(3, 3, 3) if np.abs(np.array(s) - 1).sum() == 1]
AROUND = [np.array(s) - 1 for s in np.ndindex(3, 3, 3) if s != (1, 1, 1)]


def flooded(values, markers, wet):
    """Labels by a queue ordered by rate, then place: who leaves it labels its neighbours, which enter it."""
    flat, labels = values.ravel(), dict(markers)
    queue = [(-flat[i], i) for i in markers]
    heapq.heapify(queue)
    while queue:
        _, i = heapq.heappop(queue)
        for j in near(np.array(np.unravel_index(i, values.shape)), values.shape, SIDES):
            if flat[j] >= wet and j not in labels:
                labels[j] = labels[i]
                heapq.heappush(queue, (-flat[j], j))
    return labels


def reconstructed(values, h):
    """Grey reconstruction by dilation of the field lowered by h, under the field."""
    flat, out = values.ravel(), values.ravel() - h
    while True:
        new = np.array([min(flat[i], max([out[i], *(out[j] for j in near(np.array(np.unravel_index(i, values.shape)), values.shape, AROUND))])) for i in range(flat.size)])
        if np.array_equal(new, out):
            return out
        out = new


def rains(seed, cubes=10):
    """Cubes end to end, a dry step between them; every second one on a coarse scale with many equal neighbours, one a plateau, drizzle between."""
    rng, parts = np.random.default_rng(seed), []
    for k in range(10 - cubes, 10):
        one = rng.gamma(1.2, 2.5, (3, 6, 5))
        one = np.round(one) if k % 2 else one
        one = np.where(rng.random(one.shape) < 0.3, 0.4, one) if k > 5 else one
        if k == 9:
            one[:, 1:4, 1:4] = 7
        parts += [one, np.zeros((1, 6, 5))]
    return np.concatenate(parts)


@pytest.mark.parametrize(("chunk", "cubes"), [(60, 2), (500_000, 10)])
def test_flood_is_the_queues(spark, monkeypatch, chunk, cubes):
    from cumulo.plans import local

    monkeypatch.setattr(local, "CHUNK", chunk)
    values = rains(chunk, cubes)
    vox = segment.voxels(cube_of(spark, values)).cache()
    components = mergetree.build(vox)[0].cache()
    assert {(r.comp_id, r.birth, r.death, r.parent) for r in components.collect()} == swept(values, 1.0)
    found = mergetree.Flood(vox).cuts(components, [1.0, 4.0], 1).collect()
    for h in (1.0, 4.0):
        peaks = {r.comp_id: r.comp_id for r in mergetree.survivors(components, h).collect()}
        mine = {r.id: r.label for r in found if r.h == h}
        assert mine == flooded(values, peaks, 1.0) and sum(r.h == h for r in found) == len(mine)


def test_watershed_is_the_reconstructions(spark):
    values = np.round(rains(4), 1)
    field = segment.voxels(cube_of(spark, values), segment.ANY_RAIN).cache()
    for h in (3.0, 30.0):
        seed = (values.ravel() - reconstructed(values, h) >= h - 1e-9) & (values.ravel() >= 1.0)
        labels = {}
        for i in np.flatnonzero(seed):
            todo = [int(i)] if int(i) not in labels else []
            while todo:
                at = todo.pop()
                labels[at] = int(i)
                todo += [j for j in near(np.array(np.unravel_index(at, values.shape)), values.shape, AROUND) if seed[j] and j not in labels]
        if h > 10:  # higher than most peaks: the flood is tested with the other one
            assert {r.id: r.label for r in mergetree.seeds(field, h).collect()} == labels
        else:
            assert {r.id: r.label for r in mergetree.label_watershed(field, h, 1).collect()} == flooded(values, labels, 1.0)


def test_watershed_seeds_storms_on_dry_ground(spark):
    values = np.zeros((1, 3, 12))
    values[0, 1, 1:4] = [4, 10, 3]
    values[0, 1, 7:10] = [2, 4.5, 1.5]
    field = segment.voxels(cube_of(spark, values), segment.ANY_RAIN).cache()
    assert mergetree.label_watershed(field, 4.0, 1).groupBy("label").count().count() == 2
    drizzle = segment.voxels(cube_of(spark, np.where(values == 0, 0.8, values)), segment.ANY_RAIN).cache()
    assert mergetree.label_watershed(drizzle, 4.0, 1).groupBy("label").count().count() == 1
    assert mergetree.label_watershed(field.where("r < 1"), 4.0, 1).count() == 0


def test_cut_partitions_and_counts_fall_with_height(spark):
    values = np.random.default_rng(5).gamma(1.2, 2.5, (4, 6, 6))
    vox = segment.voxels(cube_of(spark, values)).cache()
    table = sweep.sweep(vox, [1.0, 3.0], 1).orderBy("h").collect()
    assert table[0].n_storms >= table[1].n_storms
    labels = mergetree.segment_at(vox, 3.0, 1).collect()
    assert len({r.id for r in labels}) == len(labels)
    kept = {r.comp_id for r in mergetree.survivors(mergetree.build(vox)[0], 3.0).collect()}
    assert {r.label for r in labels} == kept


def test_two_peaks_split_and_fold(spark):
    values = np.zeros((1, 1, 7))
    values[0, 0] = [2, 13.2, 4, 1.205, 5, 9.2, 2]
    vox = segment.voxels(cube_of(spark, values)).cache()
    tree = mergetree.build(vox)[0]
    assert {round(r.persistence, 3) for r in tree.collect()} == {12.2, 7.995}
    assert mergetree.segment_at(vox, 5.0, 1).select("label").distinct().count() == 2
    assert mergetree.segment_at(vox, 9.0, 1).select("label").distinct().count() == 1
    assert segment.label_ccl(vox, 1).select("label").distinct().count() == 1
    assert mergetree.hierarchy(tree, 9.0).first().birth == 9.2


def test_corner_neighbours(spark):
    values = np.zeros((2, 2, 2))
    values[0, 0, 0] = values[1, 1, 1] = 3
    vox = segment.voxels(cube_of(spark, values)).cache()
    assert segment.label_ccl(vox, 1).select("label").distinct().count() == 1
    assert segment.label_ccl(vox, 1, 6).select("label").distinct().count() == 2
    assert segment.label_ccl(vox, 3).count() == 0


def test_drifting_blob(spark):
    values = np.zeros((7, 9, 12))
    for t in range(5):
        values[t + 1, 3:6, 2 + t : 5 + t] = 10
    one = storms.storm_table(segment.label_ccl(segment.voxels(cube_of(spark, values)), 6), extent=values.shape).collect()
    assert len(one) == 1
    row = one[0]
    assert (row.n_voxels, row.n_timesteps, row.duration_h, row.max_intensity_mm_hr) == (45, 5, 2.5, 10)
    assert not row.truncated_time and not row.truncated_space
    assert (round(row.start_lon, 6), round(row.end_lon, 6)) == (94.75, 95.15)
    area = sum(6371008.8**2 * np.radians(0.1) * (np.sin(np.radians(a + 0.05)) - np.sin(np.radians(a - 0.05))) for a in (-11.25, -11.15, -11.05))
    assert row.total_volume_km3 == pytest.approx(15 * 10 * 0.5 / 1000 * area / 1e9, rel=1e-9)
    assert row.track_wkt.startswith("LINESTRING (94.7500 -11.1500, 94.8500 -11.1500")


def test_nothing_wet(spark):
    vox = segment.voxels(cube_of(spark, np.zeros((2, 2, 2)))).cache()
    assert mergetree.build(vox)[0].count() == 0
    assert segment.percolation_share(segment.label_ccl(vox, 1)).first()[0] == 0.0


def test_components_of_chain_star_and_loop(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()))
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 150)}}


def test_ranks_and_quantiles(spark):
    values = np.round(np.random.default_rng(3).gamma(2, 5, 500), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double").repartition(7)
    got = {r.level: r.value for r in quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1]).collect()}
    assert got == pytest.approx({q: np.quantile(values, q) for q in got})
    from pyspark.sql import functions as F

    rows = ranked(df, [F.desc("v"), F.col("id")], running="v").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501))
    assert rows[-1].running == pytest.approx(values.sum()) and rows[9].running == pytest.approx(np.sort(values)[::-1][:10].sum())
    assert dict(map(tuple, kth_largest(df, "v", [1, 7]).collect())) == {1: np.sort(values)[-1], 7: np.sort(values)[-7]}


def test_quantiles_of_groups(spark):
    from cumulo.plans.ranking import group_quantiles

    rng = np.random.default_rng(8)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 600), np.round(rng.gamma(2, 5, 600), 1))] + [(9, 2.0), (9, None), (10, None)]
    got = {r.g: (r.a, r.b, r.c) for r in group_quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), "g", "v", {"a": 0.0, "b": 0.37, "c": 0.95}).collect()}
    wanted = {g: tuple(np.quantile([v for k, v in rows if k == g and v is not None], q) for q in (0, 0.37, 0.95)) for g in (0, 1, 2, 3, 9)}
    assert got.keys() == wanted.keys() and all(got[g] == pytest.approx(wanted[g]) for g in got)


def test_percentile_sides_and_return_years(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    own = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "w double")
    right = {r.w: (r.percentile, r.larger, r.return_years) for r in severity.percentile_of(own, ref, "w", "v", 12.0).collect()}
    left = {r.w: (r.percentile, r.larger) for r in severity.percentile_of(own, ref, "w", "v", side="left").collect()}
    assert right == {0.5: (0.0, 4, 3.0), 2.0: (75.0, 1, 12.0), 9.0: (100.0, 0, 12.0)}
    assert left == {0.5: (0.0, 4), 2.0: (25.0, 1), 9.0: (100.0, 0)}


def test_rate_edges_from_ten_years_on(spark):
    ref = spark.createDataFrame([(float(i), float(i)) for i in range(1, 101)], "total_volume_km3 double, max_intensity_mm_hr double")
    scale = severity.fit(ref, 10.0, rate_bands=(5.0, 1.0))
    assert (scale.volume, scale.by_rate) == ((51.0, 91.0), True)
    top = severity.classify(ref, scale).where("total_volume_km3 = 91").first()
    assert (top.severity_index, top.severity) == (8, "extreme")


def test_family_pairs_are_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(s), int(s + d), float(a), float(o)) for i, (s, d, a, o) in enumerate(zip(rng.integers(0, 200_000, 400), rng.integers(0, 20_000, 400), rng.uniform(-5, 5, 400), rng.uniform(100, 106, 400)))]
    df = spark.createDataFrame(rows, "storm_uid long, s long, e long, lat double, lon double").selectExpr("storm_uid", "CAST(timestamp_seconds(s) AS timestamp_ntz) start_time", "CAST(timestamp_seconds(e) AS timestamp_ntz) end_time", "lat", "lon")
    wanted = set()
    for a in rows:
        for b in rows:
            if (a[1], a[0]) < (b[1], b[0]) and a[2] // 60 >= b[1] // 60 - 180 and (b[3] - a[3]) ** 2 + ((b[4] - a[4]) * np.cos(np.radians(b[3]))) ** 2 <= (50 / 111.32) ** 2:
                wanted.add((a[0], b[0]))
    found = [tuple(r) for r in families.pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and wanted


def test_coast_distance_is_brute_force(spark):
    land = np.random.default_rng(4).random((12, 15)) < 0.1
    grid = spark.createDataFrame([(int(y), int(x), bool(land[y, x])) for y, x in np.ndindex(land.shape)], "y int, x int, is_land boolean")
    places = np.argwhere(land)
    for r in geo.coast_distance(grid).collect():
        assert r.coast_km == pytest.approx(np.sqrt(((places - [r.y, r.x]) ** 2).sum(axis=1).min()) * 11.132)


def test_rasterise_last_polygon_wins(spark):
    cells = spark.createDataFrame([(y, x, y + 0.5, x + 0.5) for y in range(4) for x in range(4)], "y int, x int, lat double, lon double")
    box = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    shapes = spark.createDataFrame([(1, "big", box(0.0, 3.0)), (2, "small", box(1.0, 2.0))], "order int, name string, ring array<struct<lat:double,lon:double>>")
    got = {(r.y, r.x): r.name for r in geo.rasterise(cells, shapes).collect()}
    assert got[1, 1] == "small" and got[0, 0] == "big" and got[3, 3] is None


def test_displacement_of_a_moved_field(spark):
    values = np.zeros((2, 16, 20))
    values[0] = np.random.default_rng(1).gamma(1, 6, (16, 20))
    values[1] = np.roll(values[0], (2, -3), (0, 1))
    assert [tuple(r) for r in cubes.displacement(cube_of(spark, values), 16, 20).collect()] == [(0, 2, -3)]


def test_rolling_needs_a_whole_day(spark):
    values = np.ones((47, 1, 1))
    assert cubes.rolling_24h(cube_of(spark, values)).first().max_24h_mm is None
    assert cubes.rolling_24h(cube_of(spark, np.ones((60, 1, 1)))).first().max_24h_mm == 24.0


def test_tracks_round_trip(spark):
    from pyspark.sql import functions as F

    rows = spark.sql("SELECT stack(4, 'POINT (100.0000 -2.5000)', 'LINESTRING (100.0000 -2.5000, 101.2500 -3.0000)', 'LINESTRING EMPTY', 'junk') AS wkt")
    got = [r.p for r in rows.select(storms.parse_track(F.col("wkt")).alias("p")).collect()]
    assert [None if p is None else [tuple(v) for v in p] for p in got] == [[(-2.5, 100.0)], [(-2.5, 100.0), (-3.0, 101.25)], None, None]
    again = rows.select(storms.track_wkt(storms.parse_track(F.col("wkt"))).alias("w")).where("w IS NOT NULL").collect()
    assert again[1].w == "LINESTRING (100.0000 -2.5000, 101.2500 -3.0000)"


def test_regions_follow_the_shapes(spark):
    rows = []
    for k in range(12):
        shape = [0.02] * 12
        shape[1 if k % 2 else 6] = 0.78
        rows.append((float(k), float(k), 300, *shape))
    grid = spark.createDataFrame(rows, "glat double, glon double, storms long, " + ", ".join(f"m{m} double" for m in range(1, 13)))
    got = regions.label_regions(regions.cluster(grid, 2, 2)).collect()
    assert {(r.glat % 2, r.region, r.peak_month) for r in got} == {(1.0, 0, 2), (0.0, 1, 7)}
    assert max(regions.choose_k(grid, 2, 3, 1), key=lambda x: x[1])[0] == 2


def test_severity_without_a_reference(spark):
    none = spark.createDataFrame([], "total_volume_km3 double, max_intensity_mm_hr double")
    some = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], none.schema)
    for years in (2.0, 12.0):
        scale = severity.fit(none, years)
        assert scale.volume == (None, None) and scale.storms == 0 and "no km3" in scale.describe()
        assert [r.severity for r in severity.classify(some, scale).collect()] == [None, None]
        assert severity.edges(spark, scale).where("volume_km3 IS NULL").count() == 2
    fewer = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (None, 4.0)], none.schema)
    assert severity.fit(fewer, 12.0, rate_bands=(1.0, 0.1)).volume == (1.0, 1.0)


def test_percentiles_of_null_and_repeated_values(spark):
    own = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, 9.0)], "id int, w double").repartition(3)
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (3.0,)], "v double")
    found = {r.id: (r.percentile, r.larger) for r in severity.percentile_of(own, ref, "w", "v").collect()}
    assert found == {1: (75.0, 1), 2: (75.0, 1), 3: (None, None), 4: (100.0, 0)}
    assert {r.id: r.percentile for r in severity.percentile_of(own, ref, "w", "v", side="left").collect()} == {1: 25.0, 2: 25.0, 3: None, 4: 100.0}


def test_months_claims_and_percolation(spark):
    from datetime import date

    from cumulo.operators import climatology, sweep

    assert sweep.month_bounds(2020, 2) == (date(2020, 2, 1), date(2020, 2, 29))
    fam = spark.createDataFrame([(7, 2020, 12), (9, 2021, 1)], "fam long, year int, month int")
    assert [r.family_uid for r in families.claimed(fam, 2020).collect()] == ["2020-12-7"] and families.claimed(fam).count() == 2
    built = spark.createDataFrame([(0.1,), (0.1,), (0.3,), (0.6,), (None,)], "param_percolation_share double")
    assert tuple(climatology.percolation_range(built).first()) == (0.1, 0.3, 0.6)


@pytest.mark.parametrize("chunk", [7, 500_000])
def test_local_passes_change_nothing(spark, monkeypatch, chunk):
    from cumulo.plans import local
    from cumulo.plans.graph import connected_components
    from cumulo.plans.pointers import follow

    monkeypatch.setattr(local, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)]
    edges = spark.createDataFrame([*pairs, (3, None)], "a long, b long").repartition(3)
    want = dict(map(tuple, connected_components(edges, "a", "b").collect()))
    assert dict(map(tuple, connected_components(edges, "a", "b", near=True).collect())) == want and want[260] == 200
    named = edges.selectExpr("'n' || lpad(a, 4, '0') a", "'n' || lpad(b, 4, '0') b")
    assert dict(map(tuple, connected_components(named, "a", "b", near=True).collect())) == {f"n{k:04}": f"n{v:04}" for k, v in want.items()}
    next_of = {k: int(rng.integers(0, k)) for k in range(1, 150) if k % 17}
    ends = {}
    for k in next_of:
        at = k
        while at in next_of:
            at = next_of[at]
        ends[k] = at
    table = spark.createDataFrame(list(next_of.items()), "node long, next long")
    assert dict(map(tuple, follow(table.repartition(4)).collect())) == ends
    assert follow(table.where("false")).count() == 0 and connected_components(edges.where("false"), "a", "b", near=True).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_of_families_are_merged_not_broadcast(spark):
    df = spark.range(60).selectExpr("id AS storm_uid", "timestamp_micros(id * 420000000) AS start_time", "timestamp_micros(id * 420000000) AS end_time", "-3 + 0.3D * (id % 9) AS lat", "100 + 0.3D * (id % 5) AS lon")
    plan = plan_of(families.pairs(df))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rasterise_broadcasts_cells_only(spark):
    cells = spark.range(36).selectExpr("int(id DIV 6) AS y", "int(id % 6) AS x", "id DIV 6 + 0.5D AS lat", "id % 6 + 0.5D AS lon")
    ring = "array(named_struct('lat', 0.2D, 'lon', 0.3D), named_struct('lat', 5.1D, 'lon', 0.4D), named_struct('lat', 5.2D, 'lon', {east}D), named_struct('lat', 0.3D, 'lon', {east}D))"
    shapes = spark.range(1, 4).selectExpr("id AS order", "IF(id = 2, NULL, concat('s', id)) AS name", f"IF(id = 3, {ring.format(east=2.0)}, {ring.format(east=4.8)}) AS ring")
    got = geo.rasterise(cells, shapes)
    assert "BuildLeft" not in plan_of(got)
    assert {r.name for r in got.where("x < 2 AND y BETWEEN 1 AND 4").collect()} == {"s3"} and {r.name for r in got.where("x > 2").collect()} == {None}


def test_neighbours_meet_in_blocks_without_a_join(spark, monkeypatch):
    from cumulo.plans import local

    rng = np.random.default_rng(11)
    places = sorted({tuple(p) for p in rng.integers((-20, 28, 0), (20, 70, 36), (9000, 3)).tolist()})
    at = {p: i for i, p in enumerate(places)}
    vox = spark.createDataFrame([(i, *p, float(i % 7)) for p, i in at.items()], "id long, t int, y int, x int, r double")
    monkeypatch.setattr(local, "CHUNK", 3000)  # blocks are cut off where they end
    for connectivity, shifts in ((26, [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]), (6, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])):
        found = segment.edges(vox, connectivity)
        assert "Join" not in plan_of(found)
        wanted = sorted((i, at[q], i % 7.0, at[q] % 7.0) for (t, y, x), i in at.items() for a, b, c in shifts if (a, b, c) > (0, 0, 0) and (q := (t + a, y + b, x + c)) in at)
        assert sorted(map(tuple, found.collect())) == wanted
    assert segment.edges(vox.where("false")).count() == 0
    assert segment.edges(vox.withColumn("r", vox["r"].cast("float"))).schema["ru"].dataType.simpleString() == "float"
