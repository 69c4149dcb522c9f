"""Registered queries of the storm operators over the adapters, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.functions.columns import cell, inside, untruncated
from cumulo.operators import analyses, checks, climatology, cubes, events, export, families, geo, mergetree, panels, regions, segment, severity, storms, sweep
from cumulo.plans.shared import materialize
from cumulo.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOX = (-6.0, 2.0, 100.0, 120.0)
SQL_BOX = "{lat} BETWEEN -6e0 AND 2e0 AND {lon} BETWEEN 100e0 AND 120e0"
EVENT = ("1996-03-01", "1996-03-07")
FAMILY_EVENT = ("2024-01-10", "2024-01-12")

CAT = """cat AS (SELECT o_orderkey AS storm_uid, o_orderdate AS start_time, o_orderdate + to_minutes(30 * (n_timesteps - 1)) AS end_time, n_timesteps,
  0.5e0 * n_timesteps AS duration_h, vol AS total_volume_km3, inten AS max_intensity_mm_hr, area AS max_area_km2, n_voxels,
  -11.55e0 + 0.1e0 * ((o_custkey * 37) % 182) AS wcentroid_lat, 94.45e0 + 0.1e0 * ((o_custkey * 91) % 472) AS wcentroid_lon, o_orderdate AS wcentroid_time,
  o_orderstatus = 'P' AS truncated_time, o_orderpriority = '5-LOW' AS truncated_space, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month
  FROM orders JOIN (SELECT l_orderkey, CAST(max(l_quantity) AS INT) AS n_timesteps, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / 1e6 AS vol,
    max(l_quantity) AS inten, count(*) AS n_voxels, max(l_extendedprice) / 1e3 AS area FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
whole AS (SELECT * FROM cat WHERE NOT (truncated_time OR truncated_space))"""
TRK = """trk AS (SELECT l_orderkey AS storm_uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS t,
  -11.55e0 + 0.1e0 * ((l_partkey * 37) % 182) AS lat, 94.45e0 + 0.1e0 * ((l_partkey * 91) % 472) AS lon, l_extendedprice / 1e6 AS volume_km3 FROM lineitem)"""
CUBE = """cube AS (SELECT CAST(floor(epoch_us(ts) / 1.8e9) AS INT) AS t, CAST(floor(user_id / 15e0) AS INT) AS y, CAST(user_id % 15 AS INT) AS x, max(value) / 10 AS r FROM events GROUP BY 1, 2, 3)"""
GRID = """grid AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, (y // 8 + x // 8) % 2 = 0 AS is_land, 'P-' || (y // 46) || '-' || (x // 59) AS province FROM range(182) a(y), range(472) b(x))"""
AREA = "(6371008.8e0 * 6371008.8e0 * radians(0.1e0) * (sin(radians(-11.55e0 + 0.1e0 * y + 0.05e0)) - sin(radians(-11.55e0 + 0.1e0 * y - 0.05e0))))"
VOL = f"(r * 0.5e0 / 1000e0 * {AREA} / 1e9)"
ES = "CAST(sum(CAST({} AS DECIMAL(30,10))) AS DOUBLE)"
VOLSUM = ES.format("total_volume_km3")


def cellsql(v: str, first: str, n: int) -> str:
    return f"CAST(least(greatest(round_even(({v} - ({first})) / 0.1e0, 0), 0), {n - 1}) AS INT)"


def latsql(v: str) -> str:
    return cellsql(v, "-11.55e0", 182)


def lonsql(v: str) -> str:
    return cellsql(v, "94.45e0", 472)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cat(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(adapters.catalogue(spark, sf))


# --- climatology -----------------------------------------------------------------------------------------------------

query("q_record_years", f"WITH {CAT} SELECT count(DISTINCT year * 100 + month) / 12e0 AS record_years FROM cat")(_cat(climatology.record_years))
query("q_headline", f"""WITH {CAT} SELECT count(*) AS storms, sum((NOT (truncated_time OR truncated_space))::BIGINT) / count(*) AS untruncated_share, {VOLSUM} AS volume_km3,
  count(*) / (count(DISTINCT year * 100 + month) / 12e0) AS storms_per_year, sum((NOT (truncated_time OR truncated_space))::BIGINT) / (count(DISTINCT year * 100 + month) / 12e0) AS untruncated_per_year FROM cat""")(_cat(climatology.headline))
_YEARS = f"y AS (SELECT year, count(*) AS storms, {VOLSUM} AS volume_km3, count(DISTINCT month) AS months FROM whole GROUP BY year)"
query("q_by_year", f"WITH {CAT}, {_YEARS} SELECT *, volume_km3 / months AS volume_per_month, months = 12 AS \"full\" FROM y")(_cat(climatology.by_year))
query("q_interannual", f"""WITH {CAT}, {_YEARS}, f AS (SELECT * FROM y WHERE months = 12)
  SELECT max_by(year, volume_km3) AS wettest_year, max(volume_km3) AS wettest_km3, min_by(year, volume_km3) AS driest_year, min(volume_km3) AS driest_km3, max(volume_km3) / min(volume_km3) AS ratio FROM f""")(_cat(climatology.interannual))
query("q_seasonal_pooled", f"""WITH {CAT}, m AS (SELECT month, count(*) AS storms, {VOLSUM} AS volume_km3 FROM whole GROUP BY month)
  SELECT *, volume_km3 / (SELECT {ES.format('volume_km3')} FROM m) AS share FROM m""")(_cat(climatology.by_month))


def _kth(cat: DataFrame) -> DataFrame:
    return climatology.threshold_table(cat, climatology.years_of(cat))


query("q_kth_largest", f"""WITH {CAT}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat),
  k AS (SELECT period, CAST(greatest(round_even(years / period, 0), 1) AS INT) AS k FROM n, (VALUES (1), (2), (5), (10), (25)) p(period)),
  v AS (SELECT total_volume_km3 AS v, row_number() OVER (ORDER BY total_volume_km3 DESC) AS k FROM whole), i AS (SELECT max_intensity_mm_hr AS i, row_number() OVER (ORDER BY max_intensity_mm_hr DESC) AS k FROM whole)
  SELECT period, k.k, v AS volume_km3, i AS intensity_mm_hr FROM k JOIN v USING (k) JOIN i USING (k)""")(_cat(_kth))
query("q_cmt_filter", f"""WITH {CAT} SELECT CAST(sum(h::BIGINT) AS BIGINT) AS storms, sum(h::BIGINT) / count(*) AS share, {ES.format('CASE WHEN h THEN total_volume_km3 ELSE 0 END')} / {VOLSUM} AS volume_share
  FROM (SELECT *, total_volume_km3 >= 0.1e0 AND max_intensity_mm_hr >= 40e0 AS h FROM whole)""")(_cat(lambda c: climatology.critical_mass(c, 0.1, 40.0)))
query("q_annual_summary", f"""WITH {CAT} SELECT year, count(*) AS storms, {ES.format('CASE WHEN ok THEN total_volume_km3 END')} AS volume_km3, round(quantile_cont(total_volume_km3, 0.5) FILTER (ok), 9) AS median_volume_km3,
  round(quantile_cont(duration_h, 0.95) FILTER (ok), 6) AS p95_duration_h, sum((NOT ok)::BIGINT) / count(*) AS truncated_share, count(DISTINCT month) AS months
  FROM (SELECT *, NOT (truncated_time OR truncated_space) AS ok FROM cat) GROUP BY year""")(_cat(climatology.annual_summary))
_SEASON = f"""WITH {CAT}, m AS (SELECT year, month, {VOLSUM} AS v FROM whole GROUP BY 1, 2),
  r AS (SELECT *, count(*) OVER (PARTITION BY year) = 12 AS complete, v / CAST(sum(CAST(v AS DECIMAL(30,10))) OVER (PARTITION BY year) AS DOUBLE) * 100 AS share FROM m),
  a AS (SELECT month, {ES.format('v')} AS all_v, {ES.format('CASE WHEN complete THEN v END')} AS complete_v, avg(share) FILTER (complete) AS mos, quantile_cont(share, 0.1) FILTER (complete) AS p10,
    quantile_cont(share, 0.9) FILTER (complete) AS p90, min(share) FILTER (complete) AS mn, max(share) FILTER (complete) AS mx FROM r GROUP BY month),
  s AS (SELECT month, round(all_v / CAST(sum(CAST(all_v AS DECIMAL(30,10))) OVER () AS DOUBLE) * 100, 6) AS pooled_all_pct, round(complete_v / CAST(sum(CAST(complete_v AS DECIMAL(30,10))) OVER () AS DOUBLE) * 100, 6) AS pooled_complete_pct,
    round(mos, 6) AS mean_of_shares_pct, round(p10, 6) AS p10_share_pct, round(p90, 6) AS p90_share_pct, round(mn, 6) AS min_share_pct, round(mx, 6) AS max_share_pct FROM a)"""
query("q_seasonal_estimators", _SEASON + " SELECT * FROM s")(_cat(climatology.seasonal_estimators))
query("q_season_ratio", _SEASON + """ SELECT max(pooled_all_pct) FILTER (month = 12) / max(pooled_all_pct) FILTER (month = 8) AS pooled_all,
  max(pooled_complete_pct) FILTER (month = 12) / max(pooled_complete_pct) FILTER (month = 8) AS pooled_complete, max(mean_of_shares_pct) FILTER (month = 12) / max(mean_of_shares_pct) FILTER (month = 8) AS mean_of_shares FROM s""")(_cat(lambda c: climatology.season_ratio(climatology.seasonal_estimators(c))))
query("q_month_rank", f"WITH {CAT}, m AS (SELECT year, month, {VOLSUM} AS volume_km3 FROM cat GROUP BY 1, 2) SELECT *, CAST(rank() OVER (ORDER BY volume_km3 DESC) AS INT) AS rank FROM m")(_cat(climatology.month_rank))

# --- regions ---------------------------------------------------------------------------------------------------------

_CELLS = f"""g AS (SELECT *, floor(wcentroid_lat / 2e0) * 2e0 AS glat, floor(wcentroid_lon / 2e0) * 2e0 AS glon FROM cat),
  c AS (SELECT glat, glon, count(*) AS storms, {', '.join(f"coalesce({ES.format(f'CASE WHEN month = {m} THEN total_volume_km3 END')}, 0) AS v{m}" for m in range(1, 13))} FROM g GROUP BY 1, 2)"""
_TOTAL = "(" + " + ".join(f"v{m}" for m in range(1, 13)) + ")"
query("q_seasonal_grid", f"WITH {CAT}, {_CELLS} SELECT glat, glon, storms, {', '.join(f'v{m} / {_TOTAL} AS m{m}' for m in range(1, 13))} FROM c WHERE storms >= 40")(_cat(lambda c: regions.seasonal_grid(c, 2.0, 40)))


def _by_land(cat: DataFrame) -> DataFrame:
    """Cells of the coarse grid in three fixed regions, in place of a clustering, which has no SQL."""
    return regions.contrast(regions.on_grid(cat, 2.0).withColumn("region", (F.pmod(F.floor(F.col("glat") / 2) + F.floor(F.col("glon") / 2), F.lit(3))).cast("int")))


_V = ", ".join(f"{ES.format(f'v{m}')} " for m in range(1, 13))
_S = ", ".join(f"round(avg(v{m} / {_TOTAL}), 9)" for m in range(1, 13))
query("q_regional_contrast", f"""WITH {CAT}, {_CELLS}, r AS (SELECT CAST(((CAST(floor(glat / 2) + floor(glon / 2) AS INT) % 3) + 3) % 3 AS INT) AS region, count(*) AS cells, {ES.format(_TOTAL)} AS v, [{_V}] AS vs, [{_S}] AS ss FROM c GROUP BY 1)
  SELECT region, cells, v / CAST(sum(CAST(v AS DECIMAL(30,10))) OVER () AS DOUBLE) * 100 AS volume_share_pct, list_max(vs) / list_min(vs) AS volume_contrast, CAST(list_position(vs, list_max(vs)) AS INT) AS volume_peak_month,
  CAST(list_position(vs, list_min(vs)) AS INT) AS volume_trough_month, round(list_max(ss) / list_min(ss), 3) AS cell_contrast, CAST(list_position(ss, list_max(ss)) AS INT) AS cell_peak_month, CAST(list_position(ss, list_min(ss)) AS INT) AS cell_trough_month FROM r""")(_cat(_by_land))


@query("q_regions")
def q_regions(spark: SparkSession, sf: str) -> DataFrame:
    grid = materialize(regions.seasonal_grid(adapters.catalogue(spark, sf), 2.0, 40), "seasonal-grid")
    return regions.label_regions(regions.cluster(grid, 3, 3))


# --- severity --------------------------------------------------------------------------------------------------------


def _scale(cat: DataFrame) -> severity.Scale:
    return severity.fit(cat, climatology.years_of(cat))


_EDGES = f"e AS (SELECT quantile_cont(total_volume_km3, 0.9) AS v0, quantile_cont(total_volume_km3, 0.99) AS v1, quantile_cont(max_intensity_mm_hr, 0.9) AS i0, quantile_cont(max_intensity_mm_hr, 0.99) AS i1 FROM whole)"
query("q_severity_fit", f"WITH {CAT}, {_EDGES} SELECT 90e0 AS band, round(v0, 9) AS volume_km3, round(i0, 9) AS intensity_mm_hr FROM e UNION ALL SELECT 99e0, round(v1, 9), round(i1, 9) FROM e")(
    lambda spark, sf: severity.edges(spark, _scale(adapters.catalogue(spark, sf))).select("band", F.round("volume_km3", 9).alias("volume_km3"), F.round("intensity_mm_hr", 9).alias("intensity_mm_hr"))
)
_NAMES = "['very low', 'low', 'moderate', 'medium', 'heavy', 'very heavy', 'intense', 'severe', 'extreme']"
_CLASS = f"""{_EDGES}, k AS (SELECT cat.*, (total_volume_km3 >= v0)::INT + (total_volume_km3 >= v1)::INT AS vol_band, (max_intensity_mm_hr >= i0)::INT + (max_intensity_mm_hr >= i1)::INT AS int_band FROM cat, e),
  s AS (SELECT *, vol_band * 3 + int_band AS severity_index, {_NAMES}[vol_band * 3 + int_band + 1] AS severity FROM k)"""
query("q_severity_classify", f"WITH {CAT}, {_CLASS} SELECT storm_uid, vol_band, int_band, severity_index, severity, 'percentile' AS severity_basis FROM s")(
    _cat(lambda c: severity.classify(c, _scale(c)).select("storm_uid", "vol_band", "int_band", "severity_index", "severity", "severity_basis"))
)


def _grid9(cat: DataFrame) -> DataFrame:
    return severity.occupancy(severity.classify(cat.where(untruncated()), _scale(cat)), climatology.years_of(cat))


query("q_severity_grid", f"""WITH {CAT}, {_CLASS}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat), u AS (SELECT * FROM s WHERE NOT (truncated_time OR truncated_space)),
  o AS (SELECT i AS severity_index, {_NAMES}[i + 1] AS severity, (SELECT count(*) FROM u WHERE u.severity_index = i) AS storms FROM range(9) r(i))
  SELECT CAST(severity_index AS INT) AS severity_index, severity, storms, storms / years AS per_year, storms / (SELECT count(*) FROM u) AS share FROM o, n""")(_cat(_grid9))
query("q_percentile_of", f"""WITH {CAT}, ref AS (SELECT total_volume_km3 AS v FROM whole), n AS (SELECT count(*) AS n FROM ref),
  d AS (SELECT v, count(*) AS c FROM ref GROUP BY v), cum AS (SELECT v, sum(c) OVER (ORDER BY v) AS below FROM d)
  SELECT storm_uid, coalesce(below, 0) / n * 100 AS percentile, CAST(n - coalesce(below, 0) AS BIGINT) AS larger FROM (SELECT storm_uid, total_volume_km3 AS v FROM cat ORDER BY v) a ASOF LEFT JOIN cum ON a.v >= cum.v, n""")(
    _cat(lambda c: severity.percentile_of(c.select("storm_uid", "total_volume_km3"), c.where(untruncated()), "total_volume_km3", "total_volume_km3").select("storm_uid", "percentile", "larger"))
)
query("q_contribution", f"""WITH {CAT}, r AS (SELECT row_number() OVER w AS k, CAST(sum(CAST(total_volume_km3 AS DECIMAL(30,10))) OVER w AS DOUBLE) AS c FROM whole WINDOW w AS (ORDER BY total_volume_km3 DESC, storm_uid ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT count(*) AS n, {VOLSUM} AS total FROM whole), f AS (SELECT f AS top_frac, CAST(round_even(f * n, 0) AS BIGINT) AS n_storms, total FROM t, (VALUES (0.01e0), (0.05e0), (0.1e0), (0.13e0), (0.2e0), (0.5e0)) x(f))
  SELECT top_frac, n_storms, c / total AS volume_share FROM f JOIN r ON k = greatest(n_storms, 1)""")(_cat(lambda c: severity.contribution(c.where(untruncated()))))
query("q_concentration", f"""WITH {CAT}, r AS (SELECT row_number() OVER w AS k, CAST(sum(CAST(total_volume_km3 AS DECIMAL(30,10))) OVER w AS DOUBLE) AS c FROM whole WINDOW w AS (ORDER BY total_volume_km3 DESC, storm_uid ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT count(*) AS n, {VOLSUM} AS total FROM whole), i AS (SELECT DISTINCT CAST(round(pow(CAST(n AS DOUBLE), j / 399e0)) AS BIGINT) AS k FROM t, range(400) x(j))
  SELECT CAST(k AS INT) AS rank, k / n AS storm_frac, c / total AS volume_frac FROM i JOIN r USING (k), t""")(_cat(lambda c: severity.concentration_curve(c.where(untruncated())).withColumn("rank", F.col("rank").cast("int"))))
query("q_rank_context", f"""WITH {CAT}, q AS (SELECT unnest([50e0, 90e0, 99e0, 99.9e0, 99.99e0]) AS p, unnest(quantile_cont(total_volume_km3, [0.5, 0.9, 0.99, 0.999, 0.9999])) AS v FROM whole),
  e AS (SELECT * FROM whole WHERE start_time <= TIMESTAMP '{EVENT[1]}' AND end_time >= TIMESTAMP '{EVENT[0]}')
  SELECT p AS quantile, round(v, 9) AS threshold_km3, (SELECT count(*) FROM e WHERE total_volume_km3 > v) AS n, (SELECT count(*) FROM e WHERE total_volume_km3 > v) / (SELECT count(*) FROM e) * 100 AS share_pct FROM q""")(
    _cat(lambda c: severity.rank_context(events.storms_in_window(c.where(untruncated()), *EVENT), c.where(untruncated())).withColumn("threshold_km3", F.round("threshold_km3", 9)))
)

# --- events ----------------------------------------------------------------------------------------------------------

query("q_tracks_in_window", f"""WITH {CAT} SELECT storm_uid, start_time, end_time, total_volume_km3 FROM cat WHERE start_time <= TIMESTAMP '{EVENT[1]}' AND end_time >= TIMESTAMP '{EVENT[0]}'
  AND {SQL_BOX.format(lat='wcentroid_lat', lon='wcentroid_lon')} ORDER BY total_volume_km3 DESC, storm_uid LIMIT 50""")(_cat(lambda c: events.storms_in_window(c, *EVENT, BOX, 50).select("storm_uid", "start_time", "end_time", "total_volume_km3")))
_DAILY = f"""d AS (SELECT CAST(wcentroid_time AS DATE) AS day, {VOLSUM} AS v FROM cat WHERE {SQL_BOX.format(lat='wcentroid_lat', lon='wcentroid_lon')} GROUP BY 1),
  s AS (SELECT CAST(x AS DATE) AS day, coalesce(v, 0e0) AS volume_km3 FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM d) LEFT JOIN d ON d.day = CAST(x AS DATE))"""
query("q_area_daily", f"WITH {CAT}, {_DAILY} SELECT * FROM s")(_cat(lambda c: events.area_daily(c, BOX)))
query("q_area_rank", f"""WITH {CAT}, {_DAILY}, w AS (SELECT day, CAST(sum(CAST(volume_km3 AS DECIMAL(30,10))) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS roll FROM s),
  a AS (SELECT max(roll) AS m FROM w GROUP BY year(day) HAVING count(*) >= 364), v AS (SELECT {ES.format('volume_km3')} AS v FROM s WHERE day BETWEEN DATE '{EVENT[0]}' AND DATE '{EVENT[1]}'),
  o AS (SELECT v, count(*) AS n, sum((m > v)::BIGINT) + 1 AS rank, quantile_cont(m, 0.5) AS med FROM a, v GROUP BY v)
  SELECT 7 AS window_days, v AS value_km3, n AS n_years, CAST(rank AS BIGINT) AS rank, (n + 1) / rank AS return_years, CASE WHEN rank = 1 THEN 'highest in the record' WHEN rank > n / 2 THEN 'below the typical annual maximum'
  ELSE 'about 1 in ' || CAST(round_even((n + 1) / rank, 0) AS INT) || ' years' END AS verdict, round(med, 9) AS median_km3, round(v / med, 9) AS ratio_to_median FROM o""")(_cat(lambda c: events.area_rank(events.area_daily(c, BOX), *EVENT)))

_LINKS = f"""ev AS (SELECT event_id AS id, epoch_us(ts) AS s, ts, -11.55e0 + 0.45e0 * floor(user_id / 15e0) AS lat, 94.45e0 + 0.45e0 * (user_id % 15) AS lon, value FROM events),
  pr AS (SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON a.s // 60000000 >= b.s // 60000000 - 180 AND a.s <= b.s AND (a.s < b.s OR a.id < b.id)
    AND (b.lat - a.lat) * (b.lat - a.lat) + ((b.lon - a.lon) * cos(radians(b.lat))) * ((b.lon - a.lon) * cos(radians(b.lat))) <= (50e0 / 111.32e0) * (50e0 / 111.32e0)),
  both_ways AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), reach(a, b) AS (SELECT id, id FROM ev UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
  fam AS (SELECT a AS id, min(b) AS fam FROM reach GROUP BY a)"""
_FAMS = f"""{_LINKS}, f0 AS (SELECT fam, count(*) AS n_storms, min(ts) AS "start", max(ts) AS "end", {ES.format('value')} AS volume_km3, max(value / 10) AS max_intensity_mm_hr, max(value) AS max_area_km2,
  round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, (max(s) - min(s)) / 3.6e9 + 0.5e0 AS age_h FROM fam JOIN ev USING (id) GROUP BY fam),
  f AS (SELECT *, CAST(floor(age_h / 24) AS INT) AS age_days, ['under a day', '1 day', '2 days', '3+ days'][least(CAST(floor(age_h / 24) AS INT), 3) + 1] AS age_class, CAST(year("start") AS INT) AS year, CAST(month("start") AS INT) AS month FROM f0)"""


def _families(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(families.summarise(families.link(adapters.links(spark, sf))), "families")


query("q_family_link", f"WITH RECURSIVE {_LINKS} SELECT id AS storm_uid, fam FROM fam")(lambda spark, sf: families.link(adapters.links(spark, sf)).select("storm_uid", "fam"))
query("q_family_summary", f"WITH RECURSIVE {_FAMS} SELECT * FROM f")(lambda spark, sf: families.summarise(families.link(adapters.links(spark, sf))))
query("q_family_age_classes", f"""WITH RECURSIVE {_FAMS}, t AS (SELECT count(*) AS tn, {ES.format('volume_km3')} AS tv FROM f)
  SELECT CAST(i AS INT) AS age_order, c AS age_class, count(fam) AS families, CAST(coalesce(sum(n_storms), 0) AS BIGINT) AS storms, coalesce({ES.format('volume_km3')}, 0) AS volume_km3, count(fam) / any_value(tn) AS share, coalesce({ES.format('volume_km3')}, 0) / any_value(tv) AS volume_share
  FROM (SELECT i, ['under a day', '1 day', '2 days', '3+ days'][i + 1] AS c FROM range(4) r(i)) LEFT JOIN f ON age_class = c, t GROUP BY i, c""")(lambda spark, sf: families.age_classes(_families(spark, sf)))
_IN_EVENT = f"\"start\" <= TIMESTAMP '{FAMILY_EVENT[1]}' AND \"end\" >= TIMESTAMP '{FAMILY_EVENT[0]}'"
query("q_event_families", f"WITH RECURSIVE {_FAMS} SELECT fam, n_storms, volume_km3, age_h FROM f WHERE {_IN_EVENT}")(lambda spark, sf: events.event_families(_families(spark, sf), *FAMILY_EVENT).select("fam", "n_storms", "volume_km3", "age_h"))
_FEDGES = "e AS (SELECT quantile_cont(volume_km3, 0.9) AS v0, quantile_cont(volume_km3, 0.99) AS v1, quantile_cont(max_intensity_mm_hr, 0.9) AS i0, quantile_cont(max_intensity_mm_hr, 0.99) AS i1 FROM f)"
_FCLASS = f"{_FEDGES}, k AS (SELECT f.*, ((volume_km3 >= v0)::INT + (volume_km3 >= v1)::INT) * 3 + (max_intensity_mm_hr >= i0)::INT + (max_intensity_mm_hr >= i1)::INT AS severity_index FROM f, e)"


def _rank(spark: SparkSession, sf: str) -> DataFrame:
    fam = _families(spark, sf)
    return events.rank_event(fam, *FAMILY_EVENT, climatology.years_of(fam))


query("q_rank_event", f"""WITH RECURSIVE {_FAMS}, {_FCLASS}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years, count(*) AS nf FROM f), x AS (SELECT * FROM k WHERE {_IN_EVENT}), t AS (SELECT * FROM x ORDER BY volume_km3 DESC, fam LIMIT 1),
  c AS (SELECT sum((f.volume_km3 >= t.volume_km3)::BIGINT) AS k, sum((f.volume_km3 < t.volume_km3)::BIGINT) AS below FROM f, t)
  SELECT (SELECT count(*) FROM x) AS n_families, (SELECT {ES.format('volume_km3')} FROM x) AS combined_volume_km3, t.fam, t.n_storms, t.volume_km3, t.max_intensity_mm_hr, t.age_h, {_NAMES}[severity_index + 1] AS severity, severity_index,
  below / nf * 100 AS percentile, CAST(greatest(c.k, 1) AS BIGINT) AS rank, years / greatest(c.k, 1) AS return_years, years / greatest(c.k, 1) BETWEEN 1 AND years AS supported FROM t, c, n""")(_rank)


def _family_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    fam = _families(spark, sf)
    years = climatology.years_of(fam)
    return severity.occupancy(severity.classify(fam, events.family_scale(fam, years), "volume_km3"), years)


query("q_family_occupancy", f"""WITH RECURSIVE {_FAMS}, {_FCLASS}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years, count(*) AS nf FROM f),
  o AS (SELECT i, (SELECT count(*) FROM k WHERE severity_index = i) AS storms FROM range(9) r(i)) SELECT CAST(i AS INT) AS severity_index, {_NAMES}[i + 1] AS severity, storms, storms / years AS per_year, storms / nf AS share FROM o, n""")(_family_occupancy)

# --- geography -------------------------------------------------------------------------------------------------------


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    cat = adapters.catalogue(spark, sf).select("storm_uid", "wcentroid_lat", "wcentroid_lon")
    return geo.looked_up(cat, adapters.grid(spark), "wcentroid_lat", "wcentroid_lon", {"is_land": "is_land", "province": "province"}).select("storm_uid", "is_land", "province")


query("q_raster_lookup", f"WITH {CAT}, {GRID} SELECT storm_uid, is_land, province FROM cat JOIN grid ON y = {latsql('wcentroid_lat')} AND x = {lonsql('wcentroid_lon')}")(_lookup)
_OFFSET = "(CASE WHEN {0} < 112.5e0 THEN 7 WHEN {0} < 127.5e0 THEN 8 ELSE 9 END)"
query("q_local_hour", f"SELECT event_id, (hour(ts) + minute(ts) / 60e0 + {_OFFSET.format('lon')}) % 24 AS local_h FROM (SELECT *, 94.45e0 + 2.5e0 * (user_id % 15) AS lon FROM events)")(
    lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").select("event_id", geo.local_hour(F.col("ts"), F.lit(94.45) + F.lit(2.5) * F.pmod("user_id", F.lit(15))).alias("local_h"))
)


def _diurnal(spark: SparkSession, sf: str) -> DataFrame:
    """Storms of events: the day of an order has no hour."""
    ev = adapters.links(spark, sf)
    storms_ = ev.select("storm_uid", F.col("start_time").alias("wcentroid_time"), F.least("lat", F.lit(6.5)).alias("wcentroid_lat"), F.least("lon", F.lit(141.5)).alias("wcentroid_lon"), F.lit(False).alias("truncated_time"), F.lit(False).alias("truncated_space"))
    return geo.diurnal(storms_, adapters.grid(spark))


query("q_diurnal", f"""WITH {GRID}, ev AS (SELECT ts, least(-11.55e0 + 0.45e0 * floor(user_id / 15e0), 6.5e0) AS lat, least(94.45e0 + 0.45e0 * (user_id % 15), 141.5e0) AS lon FROM events),
  h AS (SELECT is_land, CAST(floor(((hour(ts) + minute(ts) / 60e0 + {_OFFSET.format('lon')}) % 24) / 2) AS INT) AS l, CAST(floor((hour(ts) + minute(ts) / 60e0) / 2) AS INT) AS u FROM ev JOIN grid ON y = {latsql('lat')} AND x = {lonsql('lon')})
  SELECT CAST(b AS INT) AS bin, printf('%02d-%02d', b * 2, b * 2 + 2) AS hour, sum((is_land AND l = b)::BIGINT) / sum(is_land::BIGINT) AS land_local, sum((is_land AND u = b)::BIGINT) / sum(is_land::BIGINT) AS land_utc,
  sum((NOT is_land AND l = b)::BIGINT) / sum((NOT is_land)::BIGINT) AS sea_local, sum((NOT is_land AND u = b)::BIGINT) / sum((NOT is_land)::BIGINT) AS sea_utc FROM range(12) r(b), h GROUP BY b""")(_diurnal)


def _with_ends(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda f, c: f(c, "t")
    ends = adapters.tracks(spark, sf).groupBy("storm_uid").agg(at(F.min_by, "lat").alias("start_lat"), at(F.min_by, "lon").alias("start_lon"), at(F.max_by, "lat").alias("end_lat"), at(F.max_by, "lon").alias("end_lon"))
    return adapters.catalogue(spark, sf).join(ends, "storm_uid")


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    return geo.transitions(_with_ends(spark, sf), adapters.grid(spark))


_MOVED = f"""{CAT}, {TRK}, {GRID}, ends AS (SELECT storm_uid, min_by(lat, t) AS start_lat, min_by(lon, t) AS start_lon, max_by(lat, t) AS end_lat, max_by(lon, t) AS end_lon FROM trk GROUP BY 1),
  mv AS (SELECT w.*, start_lat, start_lon, end_lat, end_lon, CASE WHEN NOT a.is_land AND b.is_land THEN 'sea -> land' WHEN NOT a.is_land THEN 'sea -> sea' WHEN b.is_land THEN 'land -> land' ELSE 'land -> sea' END AS transition
    FROM whole w JOIN ends USING (storm_uid) JOIN grid a ON a.y = {latsql('start_lat')} AND a.x = {lonsql('start_lon')} JOIN grid b ON b.y = {latsql('end_lat')} AND b.x = {lonsql('end_lon')})"""


def _transition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return geo.transition_summary(_moved(spark, sf), climatology.years_of(adapters.catalogue(spark, sf)))


query("q_transition_class", f"""WITH {_MOVED}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat), s AS (SELECT transition, count(*) AS storms, {VOLSUM} AS volume_km3, round(quantile_cont(duration_h, 0.5), 6) AS median_duration_h,
  round(quantile_cont(duration_h, 0.99), 6) AS p99_duration_h, round(quantile_cont(total_volume_km3, 0.5), 9) AS median_volume_km3 FROM mv GROUP BY 1)
  SELECT s.*, storms / years AS per_year, storms / sum(storms) OVER () AS share, volume_km3 / CAST(sum(CAST(volume_km3 AS DECIMAL(30,10))) OVER () AS DOUBLE) AS volume_share FROM s, n""")(_transition_summary)
_LAND = f"""fl AS (SELECT storm_uid, count(*) AS n_vertices, min(t) FILTER (is_land) AS landfall_idx, min_by(lat, t) FILTER (is_land) AS landfall_lat, min_by(lon, t) FILTER (is_land) AS landfall_lon
  FROM trk JOIN grid ON y = {latsql('lat')} AND x = {lonsql('lon')} GROUP BY 1)"""
query("q_first_landfall", f"WITH {TRK}, {GRID}, {_LAND} SELECT storm_uid, n_vertices, CAST(landfall_idx AS INT) AS landfall_idx, landfall_lat, landfall_lon, landfall_idx * 0.5e0 AS hours_at_sea, (n_vertices - 1 - landfall_idx) * 0.5e0 AS hours_over_land FROM fl")(
    lambda spark, sf: geo.first_landfall(adapters.tracks(spark, sf), adapters.grid(spark))
)
_QEDGE = "qe AS (SELECT quantile_cont(total_volume_km3, 0.25) AS a, quantile_cont(total_volume_km3, 0.5) AS b, quantile_cont(total_volume_km3, 0.75) AS c FROM whole)"
query("q_volume_quartile", f"WITH {CAT}, {_QEDGE} SELECT storm_uid, 1 + (total_volume_km3 > a)::INT + (total_volume_km3 > b)::INT + (total_volume_km3 > c)::INT AS q FROM whole, qe")(_cat(lambda c: geo.volume_quartile(c.where(untruncated())).select("storm_uid", "q")))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    grid = adapters.grid(spark)
    coast = materialize(geo.coast_distance(grid), "coast")
    moved = _moved(spark, sf).where("transition = 'sea -> land'").join(geo.first_landfall(adapters.tracks(spark, sf), grid), "storm_uid")
    there = geo.looked_up(moved, grid, "landfall_lat", "landfall_lon", {"province": "province"})
    return geo.looked_up(there, coast, "start_lat", "start_lon", {"coast_km": "offshore_km_at_start"})


_COAST = """coast AS (SELECT s.y, s.x, min(sqrt((s.y - l.y) * (s.y - l.y) + (s.x - l.x) * (s.x - l.x))) * (0.1e0 * 111.32e0) AS coast_km FROM grid s JOIN (SELECT s2.y + dy AS y, s2.x + dx AS x, s2.y AS ly, s2.x AS lx FROM grid s2, range(-8, 9) a(dy), range(-8, 9) b(dx) WHERE s2.is_land) n ON n.y = s.y AND n.x = s.x
  JOIN grid l ON l.y = n.ly AND l.x = n.lx GROUP BY 1, 2)"""
_LANDED = f"""{_MOVED}, {_LAND}, {_COAST}, ld AS (SELECT mv.storm_uid, landfall_idx * 0.5e0 AS hours_at_sea, p.province, coast_km AS offshore_km_at_start FROM mv JOIN fl USING (storm_uid) JOIN grid p ON p.y = {latsql('landfall_lat')} AND p.x = {lonsql('landfall_lon')}
  JOIN coast c ON c.y = {latsql('start_lat')} AND c.x = {lonsql('start_lon')} WHERE transition = 'sea -> land')"""
query("q_leadtime", f"WITH {_LANDED} SELECT province, count(*) AS n, round(quantile_cont(hours_at_sea, 0.5), 6) AS median_lead_h, round(quantile_cont(hours_at_sea, 0.9), 6) AS p90_lead_h, round(quantile_cont(offshore_km_at_start, 0.5), 6) AS offshore_km FROM ld GROUP BY 1")(
    lambda spark, sf: geo.lead_times(_landed(spark, sf), "province")
)
query("q_top_provinces", f"WITH {_LANDED} SELECT province, count(*) AS n, round(quantile_cont(hours_at_sea, 0.5), 6) AS median_lead_h, round(quantile_cont(hours_at_sea, 0.9), 6) AS p90_lead_h, round(quantile_cont(offshore_km_at_start, 0.5), 6) AS offshore_km FROM ld WHERE province IS NOT NULL GROUP BY 1 ORDER BY n DESC, province LIMIT 14")(
    lambda spark, sf: geo.top_provinces(_landed(spark, sf))
)
query("q_lead_histogram", f"WITH {_LANDED} SELECT least(hours_at_sea, 24e0) AS hours_at_sea, count(*) AS n FROM ld GROUP BY 1")(lambda spark, sf: geo.lead_histogram(_landed(spark, sf)))
query("q_offshore_bands", f"""WITH {_LANDED} SELECT CASE WHEN offshore_km_at_start <= 15 THEN '(0, 15]' WHEN offshore_km_at_start <= 30 THEN '(15, 30]' WHEN offshore_km_at_start <= 50 THEN '(30, 50]' WHEN offshore_km_at_start <= 100 THEN '(50, 100]' ELSE '(100, 10000]' END AS band,
  count(*) AS n, round(quantile_cont(hours_at_sea, 0.5), 6) AS median_lead_h FROM ld WHERE offshore_km_at_start > 0 GROUP BY 1""")(lambda spark, sf: geo.offshore_bands(_landed(spark, sf)))
query("q_regression", f"WITH {_LANDED} SELECT round(corr(hours_at_sea, offshore_km_at_start), 6) AS r, round(regr_slope(hours_at_sea, offshore_km_at_start), 6) AS slope, round(regr_intercept(hours_at_sea, offshore_km_at_start), 6) AS intercept, count(*) AS n FROM ld")(
    lambda spark, sf: geo.regression(_landed(spark, sf))
)

# --- cube ------------------------------------------------------------------------------------------------------------


def _cube(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(adapters.cube(spark, sf))


query("q_total_volume", f"WITH {CUBE} SELECT round(sum({VOL}), 9) AS volume_km3 FROM cube")(_cube(cubes.total_volume))
query("q_step_volume", f"WITH {CUBE} SELECT t, round(sum({VOL}), 9) AS volume_km3 FROM cube GROUP BY t")(_cube(cubes.step_volume))
_DT = f"dt AS (SELECT CAST(floor(t / 48e0) AS INT) AS day, round(sum({VOL}), 9) AS volume_km3, sum((r >= 1)::BIGINT) / 72000e0 AS wet_frac_1mm, max(r) AS max_mm_hr FROM cube GROUP BY 1)"
query("q_daily_totals", f"WITH {CUBE}, {_DT} SELECT * FROM dt")(_cube(lambda c: cubes.daily_totals(c, 1500)))
query("q_monthly_rollup", f"""WITH {CUBE}, {_DT}, m AS (SELECT CAST(month(DATE '1970-01-01' + day) AS INT) AS month, round(sum(volume_km3), 6) AS volume_km3, round(avg(volume_km3), 9) AS mean_km3, round(avg(wet_frac_1mm), 9) AS mean_wet_frac, max(max_mm_hr) AS max_mm_hr, count(*) AS days,
  max_by(day, volume_km3) AS wettest_day, min_by(day, volume_km3) AS driest_day FROM dt GROUP BY 1) SELECT *, round(volume_km3 / sum(volume_km3) OVER (), 6) AS share FROM m""")(_cube(lambda c: cubes.monthly_rollup(cubes.daily_totals(c, 1500))))
query("q_wet_fractions", f"WITH {CUBE} SELECT l AS level, count(*) FILTER (r >= l) / 2160000e0 AS share FROM cube, (VALUES (0.1e0), (0.5e0), (1e0), (2e0), (5e0), (10e0)) v(l) GROUP BY l")(_cube(lambda c: cubes.wet_fractions(c, 2_160_000)))
query("q_accumulation", f"WITH {CUBE} SELECT y, x, round(CAST(sum(CAST(r * 0.5e0 AS DECIMAL(20,6))) AS DOUBLE), 1) AS depth_mm FROM cube GROUP BY 1, 2")(_cube(cubes.accumulation))
query("q_rolling_24h", f"""WITH {CUBE}, s AS (SELECT max(t) - min(t) + 1 AS span FROM cube), w AS (SELECT y, x, CAST(sum(CAST(r * 0.5e0 AS DECIMAL(20,6))) OVER (PARTITION BY y, x ORDER BY t RANGE BETWEEN 47 PRECEDING AND CURRENT ROW) AS DOUBLE) AS d FROM cube)
  SELECT y, x, CASE WHEN any_value(span) >= 48 THEN max(d) END AS max_24h_mm FROM w, s GROUP BY 1, 2""")(_cube(cubes.rolling_24h))
query("q_hourly_cumulative", f"""WITH {CUBE}, s AS (SELECT t, sum(CAST(r * 0.5e0 AS DECIMAL(20,6))) AS s, CAST(max(r) * 0.5e0 AS DECIMAL(20,6)) AS m FROM cube GROUP BY t), h AS (SELECT CAST(floor(t / 2e0) AS INT) AS hour, sum(s) AS s, sum(m) AS m FROM s GROUP BY 1)
  SELECT hour, CAST(s AS DOUBLE) / 150e0 AS mean_mm, CAST(m AS DOUBLE) AS max_mm, CAST(sum(s) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 150e0 AS cumulative_mm FROM h""")(_cube(lambda c: cubes.hourly_cumulative(c, 150)))
query("q_uniform_step", f"WITH {CUBE}, d AS (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM (SELECT DISTINCT t FROM cube)) SELECT gap, count(*) AS n FROM d WHERE gap IS NOT NULL GROUP BY 1")(_cube(checks.uniform_step))
query("q_days_complete", f"WITH {CUBE} SELECT CAST(floor(t / 48e0) AS INT) AS day, count(DISTINCT t) AS steps, count(DISTINCT t) = 48 AS complete FROM cube GROUP BY 1")(_cube(checks.days_complete))
query("q_calendar_gaps", f"""WITH {CAT}, d AS (SELECT DISTINCT CAST(start_time AS DATE) AS day FROM cat WHERE {SQL_BOX.format(lat='wcentroid_lat', lon='wcentroid_lon')})
  SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM d) WHERE CAST(x AS DATE) NOT IN (SELECT day FROM d)""")(
    _cat(lambda c: checks.calendar_gaps(c.where(inside(F.col("wcentroid_lat"), F.col("wcentroid_lon"), BOX)).select(F.to_date("start_time").alias("day")).distinct()))
)
query("q_cube_diff", f"""WITH {CUBE}, o AS (SELECT t, y, x, CASE WHEN r >= 40 THEN r - 0.5e0 ELSE r END AS r FROM cube WHERE r >= 1), d AS (SELECT abs(coalesce(cube.r, 0) - coalesce(o.r, 0)) AS d FROM cube FULL JOIN o ON cube.t = o.t AND cube.y = o.y AND cube.x = o.x)
  SELECT count(*) AS cells, max(d) AS max_diff, CAST(sum((d > 1e-4)::BIGINT) AS BIGINT) AS differing, max(d) < 1e-3 AS same FROM d""")(_cube(lambda c: checks.cube_diff(c, c.where("r >= 1").withColumn("r", F.when(F.col("r") >= 40, F.col("r") - F.lit(0.5)).otherwise(F.col("r"))))))
query("q_distinct_frames", f"WITH {CUBE}, s AS (SELECT t, round(sum(CAST(r AS DECIMAL(20,6)))::DOUBLE, 3) AS s FROM cube GROUP BY t) SELECT count(*) AS steps, count(DISTINCT s) AS distinct_sums, count(DISTINCT s) >= count(*) / 2 AS ok FROM s")(
    _cube(lambda c: checks.distinct_frames(c.withColumn("r", F.col("r").cast("decimal(20,6)"))).withColumnRenamed("distinct", "distinct_sums"))
)

# --- objects ---------------------------------------------------------------------------------------------------------


def _vox(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(segment.voxels(adapters.cube(spark, sf)), "voxels")


def _labelled(spark: SparkSession, sf: str, least: int = 2) -> DataFrame:
    return segment.label_ccl(_vox(spark, sf), least)


_CCL = f"""{CUBE}, sz AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM cube), vox AS (SELECT (t::BIGINT * ny + y) * nx + x AS id, t, y, x, r FROM cube, sz WHERE r >= 1),
  nb AS (SELECT a.id AS a, b.id AS b FROM vox a JOIN vox b ON b.t BETWEEN a.t - 1 AND a.t + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id),
  reach(a, b) AS (SELECT id, id FROM vox UNION SELECT r.a, e.b FROM reach r JOIN nb e ON r.b = e.a), lb AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a),
  big AS (SELECT label FROM lb GROUP BY label HAVING count(*) >= 2), lab AS (SELECT vox.*, label FROM vox JOIN lb USING (id) WHERE label IN (SELECT label FROM big))"""
query("q_ccl", f"WITH RECURSIVE {_CCL} SELECT id, label FROM lab")(lambda spark, sf: _labelled(spark, sf).select("id", "label"))
query("q_percolation", f"WITH RECURSIVE {_CCL}, s AS (SELECT count(*) AS n FROM lab GROUP BY label) SELECT max(n) / sum(n) AS percolation FROM s")(lambda spark, sf: segment.percolation_share(_labelled(spark, sf)))


def _captured(spark: SparkSession, sf: str) -> DataFrame:
    vox = _vox(spark, sf)
    return segment.captured_share(segment.label_ccl(vox, 2), vox)


query("q_captured", f"WITH RECURSIVE {_CCL} SELECT (SELECT count(*) FROM lab) / (SELECT count(*) FROM vox) AS captured")(_captured)
query("q_label_stats", f"""WITH RECURSIVE {_CCL}, s AS (SELECT label, count(*) AS n, (max(t) - min(t) + 1) * 0.5e0 AS hours, max(y) - min(y) + 1 AS la, max(x) - min(x) + 1 AS lo FROM vox JOIN lb USING (id) GROUP BY label), b AS (SELECT * FROM s ORDER BY n DESC, label LIMIT 1)
  SELECT count(*) AS objects, CAST(sum(s.n) AS BIGINT) AS wet, max(s.n) / sum(s.n) AS largest_share, quantile_cont(s.n, 0.5) AS median_voxels, CAST(sum((s.n < 6)::BIGINT) AS BIGINT) AS under_6, any_value(b.hours) AS largest_hours, any_value(b.la) AS largest_lat_cells, any_value(b.lo) AS largest_lon_cells,
  (SELECT sum(n) FROM (SELECT n FROM s ORDER BY n DESC, label LIMIT 10)) / sum(s.n) AS top10_share FROM s, b""")(lambda spark, sf: segment.label_stats(_vox(spark, sf)))
_STEPS = f"st AS (SELECT label, t, sum({VOL}) AS v, sum({AREA}) / 1e6 AS area, max(r) AS peak, sum({VOL} * y) / sum({VOL}) AS wy, sum({VOL} * x) / sum({VOL}) AS wx FROM lab GROUP BY 1, 2)"


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


query("q_step_series", f"WITH RECURSIVE {_CCL}, {_STEPS} SELECT label, t, round(v, 9) AS volume_km3, round(area, 6) AS area_km2, peak AS peak_mm_hr, round(-11.55e0 + 0.1e0 * wy, 6) AS lat, round(94.45e0 + 0.1e0 * wx, 6) AS lon FROM st")(
    lambda spark, sf: _rounded(storms.step_series(_labelled(spark, sf)), volume_km3=9, area_km2=6, lat=6, lon=6)
)
_STORM_COLUMNS = ("label", "start_time", "end_time", "n_timesteps", "duration_h", "total_volume_km3", "max_intensity_mm_hr", "max_area_km2", "n_voxels", "centroid_lat", "centroid_lon", "wcentroid_lat", "wcentroid_lon", "bbox_lat_min", "bbox_lon_max", "truncated_time", "truncated_space")
query("q_storm_table", f"""WITH RECURSIVE {_CCL}, {_STEPS}, ex AS (SELECT min(t) AS t0, max(t) AS t1, max(y) AS y1, max(x) AS x1 FROM lab), ar AS (SELECT label, max(area) AS area FROM st GROUP BY label)
  SELECT label, TIMESTAMP '1970-01-01' + to_minutes(30 * min(t)) AS start_time, TIMESTAMP '1970-01-01' + to_minutes(30 * max(t)) AS end_time, max(t) - min(t) + 1 AS n_timesteps, (max(t) - min(t) + 1) * 0.5e0 AS duration_h, round(sum({VOL}), 9) AS total_volume_km3, max(r) AS max_intensity_mm_hr,
  round(any_value(ar.area), 6) AS max_area_km2, count(*) AS n_voxels, round(-11.55e0 + 0.1e0 * avg(y), 6) AS centroid_lat, round(94.45e0 + 0.1e0 * avg(x), 6) AS centroid_lon, round(-11.55e0 + 0.1e0 * (sum({VOL} * y) / sum({VOL})), 6) AS wcentroid_lat, round(94.45e0 + 0.1e0 * (sum({VOL} * x) / sum({VOL})), 6) AS wcentroid_lon,
  round(-11.55e0 + 0.1e0 * min(y), 6) AS bbox_lat_min, round(94.45e0 + 0.1e0 * max(x), 6) AS bbox_lon_max, min(t) = any_value(t0) OR max(t) = any_value(t1) AS truncated_time, min(y) = 0 OR max(y) = any_value(y1) OR min(x) = 0 OR max(x) = any_value(x1) AS truncated_space
  FROM lab JOIN ar USING (label), ex GROUP BY label""")(
    lambda spark, sf: _rounded(storms.storm_table(materialize(_labelled(spark, sf), "labels")).select(*_STORM_COLUMNS), total_volume_km3=9, max_area_km2=6, centroid_lat=6, centroid_lon=6, wcentroid_lat=6, wcentroid_lon=6, bbox_lat_min=6, bbox_lon_max=6)
)


_SIZE = "sz AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM cube)"


def _keyed(name: str, least: str) -> str:
    """Voxels ``name`` with k, their place by rate and falling id, and pairs of neighbours ``{name}_n`` of which ``side`` share a side."""
    return f"""{name} AS (SELECT *, row_number() OVER (ORDER BY r, id DESC) AS k FROM (SELECT (t::BIGINT * ny + y) * nx + x AS id, t, y, x, r FROM cube, sz WHERE {least})),
  {name}_n AS (SELECT a.k AS a, b.k AS b, abs(a.t - b.t) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AS side FROM {name} a JOIN {name} b ON b.t BETWEEN a.t - 1 AND a.t + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.k <> b.k)"""


def _flooded(markers: str) -> str:
    """``lab``: voxels of v with h and label, from the markers (h, k, label): best passages, then pointers to whoever passes them on."""
    return f"""m AS ({markers}), f(h, k, l) AS (SELECT h, k, k FROM m UNION SELECT h, e.b, least(f.l, e.b) FROM f JOIN v_n e ON f.k = e.a AND e.side), p AS (SELECT h, k, max(l) AS l FROM f GROUP BY 1, 2),
  up AS (SELECT p.h, p.k, CASE WHEN p.l < p.k THEN p.l ELSE max(q.l) END AS nxt FROM p LEFT JOIN v_n e ON e.a = p.k AND e.side LEFT JOIN p q ON q.h = p.h AND q.k = e.b WHERE (p.h, p.k) NOT IN (SELECT (h, k) FROM m) GROUP BY p.h, p.k, p.l),
  g(h, k, z) AS (SELECT h, k, k FROM p UNION SELECT g.h, g.k, up.nxt FROM g JOIN up ON up.h = g.h AND up.k = g.z), fl AS (SELECT g.h, v.*, label FROM g JOIN m ON m.h = g.h AND m.k = g.z JOIN v ON v.k = g.k),
  lab AS (SELECT * FROM fl QUALIFY count(*) OVER (PARTITION BY h, label) >= 2)"""


_TREE = f"""{CUBE}, {_SIZE}, {_keyed("v", "r >= 1")},
  w(a, b, l) AS (SELECT k, k, k FROM v WHERE k NOT IN (SELECT a FROM v_n WHERE b > a) UNION SELECT w.a, e.b, least(w.l, e.b) FROM w JOIN v_n e ON w.b = e.a), bn AS (SELECT a, b, max(l) AS l FROM w GROUP BY 1, 2),
  sd AS (SELECT a, max(l) FILTER (b > a) AS s FROM bn GROUP BY a), pk AS (SELECT sd.a, max(bn.b) AS p FROM sd JOIN bn ON bn.a = sd.a AND bn.l >= sd.s GROUP BY sd.a),
  tree AS (SELECT v.k, v.id AS comp_id, v.r AS birth, coalesce(d.r, 1e0) AS death, coalesce(q.id, -1) AS parent, v.r - coalesce(d.r, 1e0) AS persistence FROM sd JOIN v ON v.k = sd.a LEFT JOIN v d ON d.k = sd.s LEFT JOIN pk ON pk.a = sd.a LEFT JOIN v q ON q.k = pk.p)"""


def _survivors(heights: str) -> str:
    return _flooded(f"SELECT h, k, comp_id AS label FROM tree, (VALUES {heights}) x(h) WHERE persistence >= h OR parent < 0")


query("q_merge_tree", f"WITH RECURSIVE {_TREE} SELECT comp_id, birth, death, parent, persistence FROM tree")(lambda spark, sf: mergetree.build(_vox(spark, sf))[0])
query("q_segment_at", f"WITH RECURSIVE {_TREE}, {_survivors('(4e0)')} SELECT id, t, y, x, r, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS storm_id FROM lab")(
    lambda spark, sf: segment.numbered(materialize(mergetree.segment_at(_vox(spark, sf), 4.0, 2), "labels")).select("id", "t", "y", "x", "r", "storm_id")
)
query("q_sweep", f"""WITH RECURSIVE {_TREE}, {_survivors('(2e0), (4e0), (8e0)')}, ex AS (SELECT min(t) AS t0, max(t) AS t1, max(y) AS y1, max(x) AS x1 FROM lab), ar AS (SELECT h, label, max(a) AS area FROM (SELECT h, label, t, sum({AREA}) / 1e6 AS a FROM lab GROUP BY 1, 2, 3) GROUP BY 1, 2),
  o AS (SELECT lab.h, lab.label, count(*) AS n, sum({VOL}) AS vol, (max(t) - min(t) + 1) * 0.5e0 AS dur, any_value(area) AS area, (min(t) = any_value(t0) OR max(t) = any_value(t1) OR min(y) = 0 OR max(y) = any_value(y1) OR min(x) = 0 OR max(x) = any_value(x1))::INT AS trunc FROM lab JOIN ar ON ar.h = lab.h AND ar.label = lab.label, ex GROUP BY 1, 2)
  SELECT 'all' AS month, h, 'mergetree' AS method, count(*) AS n_storms, max(n) / sum(n) AS percolation, sum(n) / (SELECT count(*) FROM v) AS captured, round({ES.format('vol')}, 6) AS vol_total_km3, round(quantile_cont(vol, 0.5), 9) AS vol_med_km3, round(quantile_cont(vol, 0.95), 9) AS vol_p95_km3,
  quantile_cont(dur, 0.5) AS dur_med_h, quantile_cont(dur, 0.95) AS dur_p95_h, round(quantile_cont(area, 0.95), 6) AS area_p95_km2, avg(trunc) AS trunc_frac FROM o GROUP BY h""")(
    lambda spark, sf: _rounded(sweep.sweep(_vox(spark, sf), [2.0, 4.0, 8.0], 2), vol_total_km3=6, vol_med_km3=9, vol_p95_km3=9, area_p95_km2=6)
)


_HEIGHTS = (8.0, 16.0, 19.2, 20.0, 24.0, 28.8, 40.0)
_COUNTS = f"""c AS (SELECT year || '-' || month AS month, h, count(*) AS n FROM cat, (VALUES {", ".join(f"({h}e0)" for h in _HEIGHTS)}) v(h) WHERE max_intensity_mm_hr >= h GROUP BY 1, 2)"""


def _counts(cat: DataFrame) -> DataFrame:
    """How many storms of each month reach each peak rate."""
    reached = F.filter(F.array(*map(F.lit, _HEIGHTS)), lambda h: F.col("max_intensity_mm_hr") >= h)
    return cat.select(F.concat_ws("-", "year", "month").alias("month"), F.explode(reached).alias("h")).groupBy("month", "h").agg(F.count("*").alias("n_storms"))


query("q_stability", f"""WITH {CAT}, {_COUNTS}, s AS (SELECT month, lag(h) OVER w AS h_from, h AS h_to, lag(n) OVER w AS n0, n AS n1 FROM c WINDOW w AS (PARTITION BY month ORDER BY h)),
  d AS (SELECT *, (h_to - h_from) / h_from AS dh, (n1 - n0) / n0 AS dn FROM s WHERE h_from IS NOT NULL), p AS (SELECT month, max(n) FILTER (h = 19.2e0) AS n0, max(n) FILTER (h = 28.8e0) AS n1 FROM c GROUP BY 1)
  SELECT month, h_from, h_to, round(dh, 3) AS d_h_frac, round(dn, 3) AS d_count_frac, CASE WHEN abs(dh) > 0.25 THEN 'n/a - step too big' WHEN abs(dn) < 0.1 THEN 'stable' ELSE 'UNSTABLE' END AS verdict FROM d
  UNION ALL SELECT month, 19.2e0, 28.8e0, 0.4e0, round((n1 - n0) / n0, 3), CASE WHEN abs((n1 - n0) / n0) < 0.1 THEN 'STABLE over +/-20%' ELSE 'UNSTABLE over +/-20%' END FROM p WHERE n0 IS NOT NULL AND n1 IS NOT NULL""")(_cat(lambda c: sweep.stability(_counts(c), 24.0)))

# --- catalogue upkeep and display ------------------------------------------------------------------------------------


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    """Every storm as seen from the windows of its own and the next month; one of them owns it."""
    cat = adapters.catalogue(spark, sf).withColumn("label", F.col("storm_uid"))
    windows = F.explode(F.array(F.trunc("start_time", "month"), F.trunc(F.add_months("start_time", 1), "month")))
    return storms.owned(cat.drop("storm_uid").withColumn("window_start", windows)).select("storm_uid", "label", "window_start")


query("q_month_ownership", f"WITH {CAT} SELECT year || '-' || month || '-' || storm_uid AS storm_uid, storm_uid AS label, CAST(date_trunc('month', start_time) AS DATE) AS window_start FROM cat")(_owned)
query("q_storm_cumulative", f"WITH {TRK} SELECT storm_uid, CAST(t AS INT) AS t, volume_km3, CAST(sum(CAST(volume_km3 AS DECIMAL(30,10))) OVER (PARTITION BY storm_uid ORDER BY t ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_km3, volume_km3 / 0.5e0 AS km3_per_h FROM trk")(
    lambda spark, sf: export.storm_cumulative(adapters.tracks(spark, sf))
)
_HAV = "2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))"
query("q_track_speed", f"WITH {TRK}, s AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM trk WINDOW w AS (PARTITION BY storm_uid ORDER BY t)), k AS (SELECT storm_uid, {_HAV} AS km FROM s) SELECT storm_uid, round(coalesce(sum(km), 0), 5) AS km, round(quantile_cont(km / 0.5e0, 0.5), 5) AS median_km_h FROM k GROUP BY 1")(
    lambda spark, sf: export.track_speed(adapters.tracks(spark, sf))
)
query("q_starts_3h", "SELECT CAST(b AS INT) AS bin, count(ts) AS n FROM range(8) r(b) LEFT JOIN events ON hour(ts) // 3 = b GROUP BY b")(lambda spark, sf: export.starts_3h(adapters.links(spark, sf)))

# --- more of the catalogue -------------------------------------------------------------------------------------------

query("q_year_quantiles", f"WITH {CAT} SELECT year, round(quantile_cont(total_volume_km3, 0.5), 9) AS p50_km3, round(quantile_cont(total_volume_km3, 0.99), 9) AS p99_km3, max(total_volume_km3) AS max_km3 FROM whole GROUP BY year")(_cat(climatology.year_quantiles))
query("q_percentile_meaning", f"""WITH {CAT}, n AS (SELECT (SELECT count(*) FROM whole)::DOUBLE AS n, count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat)
  SELECT p AS level, round(n * (1e0 - p / 100) / years, 9) AS per_year, round(1e0 / (n * (1e0 - p / 100) / years), 9) AS years_between FROM n, (VALUES (90e0), (99e0), (99.9e0), (99.99e0)) v(p)""")(_cat(lambda c: climatology.percentile_meaning(c, climatology.years_of(c))))
query("q_full_year_mean", f"WITH {CAT}, {_YEARS} SELECT {ES.format('CASE WHEN months = 12 THEN volume_km3 END')} / count(*) FILTER (months = 12) AS mean_km3, count(*) FILTER (months = 12) AS full_years, count(*) FILTER (months <> 12) AS partial_years FROM y")(_cat(climatology.full_year_mean))
query("q_share_needed", f"""WITH {CAT}, r AS (SELECT row_number() OVER w AS k, CAST(sum(CAST(total_volume_km3 AS DECIMAL(30,10))) OVER w AS DOUBLE) AS c FROM whole WINDOW w AS (ORDER BY total_volume_km3 DESC, storm_uid ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT count(*) AS n, {VOLSUM} AS total FROM whole) SELECT s AS share, min(k) / any_value(n) AS storm_frac FROM r, t, (VALUES (0.5e0), (0.9e0), (0.97e0), (0.99e0)) v(s) WHERE c / total >= s GROUP BY s""")(_cat(lambda c: severity.share_needed(c.where(untruncated()))))


def _regional_bias(cat: DataFrame) -> DataFrame:
    place = F.pmod(F.floor(F.col("glat") / 2) + F.floor(F.col("glon") / 2), F.lit(3)).cast("int")
    return severity.regional_bias(severity.classify(regions.on_grid(cat.where(untruncated()), 2.0).withColumn("region", place), _scale(cat)), climatology.years_of(cat), 4)


query("q_regional_severity", f"""WITH {CAT}, {_CLASS}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat), r AS (SELECT CAST(((CAST(floor(wcentroid_lat / 2e0) + floor(wcentroid_lon / 2e0) AS INT) % 3) + 3) % 3 AS INT) AS region,
  count(*) FILTER (severity_index >= 4) AS notable FROM s WHERE NOT (truncated_time OR truncated_space) GROUP BY 1) SELECT region, notable, notable / years AS per_year, notable / max(notable) OVER () AS of_most FROM r, n""")(_cat(_regional_bias))
_BOXES = {"box": BOX, "west": (-6.0, 2.0, 100.0, 108.0)}


def _area_sql(name: str, bbox: events.Box, days: int) -> str:
    """One area and window length: the window's total against annual maxima of trailing sums."""
    held = f"wcentroid_lat BETWEEN {bbox[0]}e0 AND {bbox[1]}e0 AND wcentroid_lon BETWEEN {bbox[2]}e0 AND {bbox[3]}e0"
    return f"""(WITH d AS (SELECT CAST(wcentroid_time AS DATE) AS day, {VOLSUM} AS v FROM cat WHERE {held} GROUP BY 1),
  s AS (SELECT CAST(x AS DATE) AS day, coalesce(v, 0e0) AS volume_km3 FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM d) LEFT JOIN d ON d.day = CAST(x AS DATE)),
  w AS (SELECT day, CAST(sum(CAST(volume_km3 AS DECIMAL(30,10))) OVER (ORDER BY day RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS roll FROM s), a AS (SELECT max(roll) AS m FROM w GROUP BY year(day) HAVING count(*) >= 364),
  v AS (SELECT coalesce({ES.format("volume_km3")}, 0e0) AS v FROM s WHERE day BETWEEN DATE '{EVENT[1]}' - INTERVAL {days - 1} DAY AND DATE '{EVENT[1]}'), o AS (SELECT v, count(m) AS n, coalesce(sum((m > v)::BIGINT), 0) + 1 AS rank, quantile_cont(m, 0.5) AS med FROM v LEFT JOIN a ON true GROUP BY v)
  SELECT '{name}' AS area, {days} AS window_days, v AS value_km3, n AS n_years, CAST(rank AS BIGINT) AS rank, (n + 1) / rank AS return_years, CASE WHEN rank = 1 THEN 'highest in the record' WHEN rank > n / 2 THEN 'below the typical annual maximum'
  ELSE 'about 1 in ' || CAST(round_even((n + 1) / rank, 0) AS INT) || ' years' END AS verdict, round(med, 9) AS median_km3, round(v / nullif(med, 0), 9) AS ratio_to_median FROM o)"""


query("q_area_windows", f"WITH {CAT} " + " UNION ALL ".join(_area_sql(name, bbox, n) for name, bbox in _BOXES.items() for n in (1, 2, 3, 5, 7)))(_cat(lambda c: events.area_windows(c, _BOXES, EVENT)))


def _band_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    fam = _families(spark, sf)
    return events.band_sensitivity(fam, climatology.years_of(fam))


query("q_band_sensitivity", f"""WITH RECURSIVE {_FAMS}, n AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years, count(*) AS nf FROM f), p(lo, hi) AS (VALUES (500e0, 50e0), (200e0, 20e0), (100e0, 10e0), (50e0, 5e0), (20e0, 2e0)),
  k AS (SELECT lo, hi, least(greatest(CAST(round_even(lo * years, 0) AS BIGINT), 1), nf) AS k0, least(greatest(CAST(round_even(hi * years, 0) AS BIGINT), 1), nf) AS k1 FROM p, n),
  r AS (SELECT volume_km3 AS v, max_intensity_mm_hr AS i, row_number() OVER (ORDER BY volume_km3 DESC) AS rv, row_number() OVER (ORDER BY max_intensity_mm_hr DESC) AS ri FROM f),
  e AS (SELECT lo, hi, max(v) FILTER (rv = k0) AS v0, max(v) FILTER (rv = k1) AS v1, max(i) FILTER (ri = k0) AS i0, max(i) FILTER (ri = k1) AS i1 FROM k, r GROUP BY lo, hi)
  SELECT lo AS low_rate, hi AS high_rate, count(*) FILTER (volume_km3 < v0 AND max_intensity_mm_hr < i0) / count(*) AS lowest_share, count(*) FILTER (volume_km3 >= v1 AND max_intensity_mm_hr >= i1) / count(*) AS highest_share FROM e, f GROUP BY lo, hi""")(_band_sensitivity)


def _top_events(spark: SparkSession, sf: str) -> DataFrame:
    fam = _families(spark, sf)
    return events.top_events(fam, climatology.years_of(fam))


query("q_top_events", f"""WITH RECURSIVE {_FAMS}, {_FCLASS} SELECT fam, volume_km3, {_NAMES}[severity_index + 1] AS severity, (SELECT count(*) FROM f WHERE f.volume_km3 < k.volume_km3) / (SELECT count(*) FROM f) * 100 AS percentile FROM k ORDER BY volume_km3 DESC, fam LIMIT 12""")(_top_events)
query("q_landfall_percentiles", f"WITH {_LANDED.replace('landfall_idx * 0.5e0 AS hours_at_sea, p.province', 'landfall_idx * 0.5e0 AS hours_at_sea, landfall_idx, p.province')} SELECT {', '.join(f'round(quantile_cont(hours_at_sea, {q / 100}), 6) AS p{q}' for q in (10, 25, 50, 75, 90, 99))}, max(hours_at_sea) AS max_h, avg((landfall_idx = 0)::INT) AS first_step_share FROM ld")(
    lambda spark, sf: geo.landfall_percentiles(_landed(spark, sf))
)
query("q_local_days", f"""WITH {CUBE}, n AS (SELECT count(*) AS cells FROM (SELECT DISTINCT y, x FROM cube)), c AS (SELECT CAST(floor((t + 14) / 48e0) AS INT) AS day, y, x, sum(r) * 0.5e0 AS mm FROM cube GROUP BY 1, 2, 3)
  SELECT day, round(sum(mm) / any_value(cells), 9) AS mean_mm, round(max(mm), 9) AS max_mm FROM c, n GROUP BY day""")(_cube(cubes.local_days))


def _density(spark: SparkSession, sf: str) -> DataFrame:
    y, x = cell(F.col("lat"), F.col("lon"))
    points = adapters.tracks(spark, sf).select(y.alias("y"), x.alias("x"))
    return export.relative_density(points, F.col("y").between(60, 99) & F.col("x").between(100, 199), 4000, 85_904)


query("q_relative_density", f"WITH {TRK}, p AS (SELECT {latsql('lat')} AS y, {lonsql('lon')} AS x FROM trk) SELECT (count(*) FILTER (y BETWEEN 60 AND 99 AND x BETWEEN 100 AND 199) / 4000) / (count(*) / 85904) AS relative_density FROM p")(_density)


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    vox = _vox(spark, sf)
    wetter = vox.where("r >= 5")
    rows = segment.method_row("components at 1 mm/h", segment.label_ccl(vox, 2), vox)
    rows = rows.union(segment.method_row("components at 5 mm/h", segment.label_ccl(wetter, 2), vox))
    rows = rows.union(segment.method_row("merge tree at 4 mm/h", materialize(mergetree.segment_at(vox, 4.0, 2), "labels"), vox))
    field = materialize(segment.voxels(adapters.cube(spark, sf), segment.ANY_RAIN), "field")
    return rows.union(segment.method_row("watershed at 4 mm/h", materialize(mergetree.label_watershed(field, 4.0, 2), "labels"), vox))


def _method(name: str, ctes: str) -> str:
    return f"(WITH RECURSIVE {ctes}, s AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT '{name}' AS method, count(*) AS storms, coalesce(max(n) / sum(n), 0e0) AS largest_share, coalesce(sum(n), 0) / (SELECT count(*) FROM cube WHERE r >= 1) AS captured FROM s)"


#: Seeds: wet, and no strictly higher voxel is reached without falling 4 below; any other part of the field is reached at 0.
_SEEDS = f"""{CUBE}, {_SIZE}, {_keyed("u", "r > 0")}, {_keyed("v", "r >= 1")}, w(a, b, l) AS (SELECT k, k, k FROM u WHERE r >= 1 AND k NOT IN (SELECT e.a FROM u_n e JOIN u x ON x.k = e.a JOIN u y ON y.k = e.b WHERE y.r > x.r) UNION SELECT w.a, e.b, least(w.l, e.b) FROM w JOIN u_n e ON w.b = e.a),
  bn AS (SELECT a, b, max(l) AS l FROM w GROUP BY 1, 2), fall AS (SELECT bn.a, any_value(x.r) AS r, coalesce(max(z.r) FILTER (y.r > x.r), 0e0) AS s FROM bn JOIN u x ON x.k = bn.a JOIN u y ON y.k = bn.b JOIN u z ON z.k = bn.l GROUP BY bn.a),
  se AS (SELECT u.id, u.k FROM fall JOIN u ON u.k = fall.a WHERE fall.r - fall.s >= 4 OR fall.r = (SELECT max(r) FROM u)), sg(a, b) AS (SELECT k, k FROM se UNION SELECT sg.a, e.b FROM sg JOIN u_n e ON e.a = sg.b JOIN se ON se.k = e.b),
  sl AS (SELECT sg.a, min(se.id) AS label FROM sg JOIN se ON se.k = sg.b GROUP BY sg.a)"""
query("q_methods", " UNION ALL ".join([
    _method("components at 1 mm/h", _CCL), _method("components at 5 mm/h", _CCL.replace("WHERE r >= 1)", "WHERE r >= 5)")), _method("merge tree at 4 mm/h", f"{_TREE}, {_survivors('(4e0)')}"),
    _method("watershed at 4 mm/h", f"{_SEEDS}, {_flooded('SELECT 4e0 AS h, v.k, sl.label FROM sl JOIN u ON u.k = sl.a JOIN v ON v.id = u.id')}"),
]).replace("(WITH", "SELECT * FROM (WITH"))(_methods)


def _absorbed(spark: SparkSession, sf: str) -> DataFrame:
    components = materialize(mergetree.build(_vox(spark, sf))[0], "components")
    return mergetree.hierarchy(components, 4.0).groupBy("survivor").agg(F.count("*").alias("n_absorbed"))


query("q_hierarchy", f"""WITH RECURSIVE {_TREE}, a(comp_id, z) AS (SELECT comp_id, comp_id FROM tree UNION SELECT a.comp_id, t.parent FROM a JOIN tree t ON t.comp_id = a.z WHERE t.persistence < 4 AND t.parent >= 0)
  SELECT z AS survivor, count(*) AS n_absorbed FROM a JOIN tree t ON t.comp_id = a.z WHERE (t.persistence >= 4 OR t.parent < 0) AND a.comp_id <> z GROUP BY z""")(_absorbed)


query("q_family_uid", f"WITH RECURSIVE {_FAMS} SELECT fam, year || '-' || month || '-' || fam AS family_uid FROM f WHERE year = 2024")(lambda spark, sf: families.claimed(_families(spark, sf), 2024).select("fam", "family_uid"))


def _thirds(cat: DataFrame) -> DataFrame:
    """Storms with the lower corner of their cell and one of three fixed regions."""
    return regions.on_grid(cat, 2.0).withColumn("region", F.pmod(F.floor(F.col("glat") / 2) + F.floor(F.col("glon") / 2), F.lit(3)).cast("int"))


_THIRD = "CAST(((CAST(floor(wcentroid_lat / 2e0) + floor(wcentroid_lon / 2e0) AS INT) % 3) + 3) % 3 AS INT)"
query("q_region_extents", f"""WITH {CAT}, g AS (SELECT *, floor(wcentroid_lat / 2e0) * 2e0 AS glat, floor(wcentroid_lon / 2e0) * 2e0 AS glon, {_THIRD} AS region FROM cat), r AS (SELECT region, count(DISTINCT (glat, glon)) AS cells, count(*) AS storms, {VOLSUM} AS volume_km3,
  min(glat) AS lat_min, max(glat) + 2 AS lat_max, min(glon) AS lon_min, max(glon) + 2 AS lon_max FROM g GROUP BY region) SELECT *, volume_km3 / CAST(sum(CAST(volume_km3 AS DECIMAL(30,10))) OVER () AS DOUBLE) AS volume_share FROM r""")(_cat(lambda c: regions.extents(_thirds(c), 2.0)))
query("q_domain_contrast", SQL["q_regional_contrast"] + " UNION ALL " + "(" + SQL["q_regional_contrast"].replace("CAST(((CAST(floor(glat / 2) + floor(glon / 2) AS INT) % 3) + 3) % 3 AS INT) AS region", "-1 AS region") + ")")(_cat(lambda c: regions.with_domain(_thirds(c))))


def _region_of_storms(cat: DataFrame) -> DataFrame:
    """The region of each storm's place, where only cells with 80 storms belong to one."""
    cells = _thirds(cat).groupBy("glat", "glon").agg(F.count("*").alias("n"), F.first("region").alias("region")).where("n >= 80")
    return regions.region_of(cat.select("storm_uid", "wcentroid_lat", "wcentroid_lon"), cells, "wcentroid_lat", "wcentroid_lon", 2.0).select("storm_uid", "region")


query("q_region_of", f"""WITH {CAT}, g AS (SELECT *, floor(wcentroid_lat / 2e0) * 2e0 AS glat, floor(wcentroid_lon / 2e0) * 2e0 AS glon, {_THIRD} AS region FROM cat),
  c AS (SELECT glat, glon, any_value(region) AS region FROM g GROUP BY 1, 2 HAVING count(*) >= 80) SELECT storm_uid, coalesce(c.region, -1) AS region FROM g LEFT JOIN c USING (glat, glon)""")(_cat(_region_of_storms))


# --- analyses --------------------------------------------------------------------------------------------------------


def _correlated(df: DataFrame, y: str, x: str) -> DataFrame:
    return _rounded(analyses.rank_correlation(df, y, x), pearson=6, spearman=6)


_RANKED = "SELECT count(*) AS n, round(corr(y, x), 6) AS pearson, round(corr(ry, rx), 6) AS spearman FROM (SELECT y, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM xy WHERE x IS NOT NULL AND y IS NOT NULL)"
query("q_rank_correlation", f"WITH {_LANDED}, xy AS (SELECT hours_at_sea AS y, offshore_km_at_start AS x FROM ld) {_RANKED}")(lambda spark, sf: _correlated(_landed(spark, sf), "hours_at_sea", "offshore_km_at_start"))
query("q_province_correlation", f"WITH {_LANDED}, xy AS (SELECT round(quantile_cont(hours_at_sea, 0.5), 6) AS y, round(quantile_cont(offshore_km_at_start, 0.5), 6) AS x FROM ld GROUP BY province) {_RANKED}")(
    lambda spark, sf: _correlated(geo.lead_times(_landed(spark, sf), "province"), "median_lead_h", "offshore_km")
)


def _halves(cube: DataFrame) -> DataFrame:
    """Rain of the western and the eastern half by step, the eastern one against all lags within a day."""
    series = lambda side: cube.where(side).groupBy("t").agg((F.sum(F.col("r").cast("decimal(20,6)"))).cast("double").alias("v"))
    return _rounded(analyses.lag_scan(series(F.col("x") < 8), series(F.col("x") >= 8), list(range(-48, 49))), r=9)


query("q_lag_scan", f"""WITH {CUBE}, s AS (SELECT t, x < 8 AS west, CAST(sum(CAST(r AS DECIMAL(20,6))) AS DOUBLE) AS v FROM cube GROUP BY 1, 2), l AS (SELECT CAST(unnest(range(-48, 49)) AS INT) AS lag),
  c AS (SELECT lag, count(a.t) AS n, CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN round(corr(a.v, b.v), 9) END AS r, CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN corr(a.v, b.v) END AS exact FROM l LEFT JOIN (s a JOIN s b ON a.west AND NOT b.west AND b.t - a.t BETWEEN -48 AND 48) ON b.t - a.t = lag GROUP BY lag)
  SELECT lag, n, r, row_number() OVER (ORDER BY exact DESC NULLS LAST, lag) = 1 AND r IS NOT NULL AS best FROM c""")(_cube(_halves))

_OFFSETS = {"UTC": 0, "UTC+7": 14, "UTC+9": 18}
_CUT = f"""{CUBE}, {_SIZE}, vox AS (SELECT (t::BIGINT * ny + y) * nx + x AS id, t, y, x, r FROM cube, sz WHERE r >= 1), al(o, chunking) AS (VALUES (-1, 'continuous'), (0, 'UTC'), (14, 'UTC+7'), (18, 'UTC+9')),
  nb AS (SELECT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb FROM vox a JOIN vox b ON b.t BETWEEN a.t - 1 AND a.t + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id),
  reach(o, a, b) AS (SELECT o, id, id FROM vox, al UNION SELECT o, r.a, e.b FROM reach r JOIN nb e ON r.b = e.a AND (o < 0 OR (e.ta + o) // 48 = (e.tb + o) // 48)), lb AS (SELECT o, a AS id, min(b) AS label FROM reach GROUP BY 1, 2),
  lab AS (SELECT o, vox.*, label FROM vox JOIN lb USING (id) QUALIFY count(*) OVER (PARTITION BY o, label) >= 2), ov AS (SELECT b.o, a.label AS a, b.label AS b, count(*) AS n FROM lab a JOIN lab b ON a.o = -1 AND b.o >= 0 AND a.id = b.id GROUP BY 1, 2, 3)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analyses.chunk_alignment(_vox(spark, sf), lambda v: segment.label_ccl(v, 2), _OFFSETS), volume_km3=6)


query("q_chunk_alignment", f"""WITH RECURSIVE {_CUT}, ex AS (SELECT min(t) AS t0, max(t) AS t1 FROM vox), one AS (SELECT o, label, max((CASE WHEN o < 0 THEN t = t0 OR t = t1 ELSE (t + o) % 48 IN (0, 47) END)::INT) AS trunc, sum({VOL}) AS vol, (max(t) - min(t) + 1) * 0.5e0 AS dur FROM lab, ex GROUP BY 1, 2),
  k AS (SELECT o, sum((nb = 1)::BIGINT) AS one_to_one, sum((nb > 1)::BIGINT) AS split FROM (SELECT o, a, count(*) AS nb FROM ov GROUP BY 1, 2) GROUP BY o)
  SELECT chunking, count(*) AS storms, avg(trunc) AS truncated_share, round({ES.format('vol')}, 6) AS volume_km3, max(dur) AS max_duration_h, CAST(CASE WHEN o < 0 THEN count(*) ELSE coalesce(any_value(one_to_one), 0) END AS BIGINT) AS one_to_one, CAST(coalesce(any_value(split), 0) AS BIGINT) AS split, 0 AS merged, 0 AS mixed FROM one JOIN al USING (o) LEFT JOIN k USING (o) GROUP BY o, chunking""")(_chunks)


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    vox = _vox(spark, sf)
    cut = analyses.unchunked(segment.label_ccl(materialize(analyses.chunked(vox, 14), "chunks"), 2), 14)
    return analyses.overlaps(materialize(segment.label_ccl(vox, 2), "whole"), materialize(cut, "labels"))


query("q_label_overlaps", f"""WITH RECURSIVE {_CUT}, na AS (SELECT label, count(*) AS n FROM lab WHERE o = -1 GROUP BY 1), nb AS (SELECT label, count(*) AS n FROM lab WHERE o = 14 GROUP BY 1), p AS (SELECT a, b, ov.n, ov.n / (na.n + nb.n - ov.n) AS share FROM ov JOIN na ON na.label = a JOIN nb ON nb.label = b WHERE o = 14)
  SELECT a, b, n, share, row_number() OVER (PARTITION BY a ORDER BY share DESC, b) = 1 AS best_for_a, row_number() OVER (PARTITION BY b ORDER BY share DESC, a) = 1 AS best_for_b FROM p""".replace(", nb AS (SELECT label", ", sb AS (SELECT label").replace("nb.n -", "sb.n -").replace("JOIN nb ON nb.label", "JOIN sb ON sb.label"))(_matches)
query("q_step_extremes", f"WITH RECURSIVE {_CCL}, {_STEPS} SELECT label, arg_min(t, (-peak, t)) AS peak_t, max(peak) AS peak_mm_hr, arg_min(t, (-round(area, 6), t)) AS largest_t, round(max(area), 6) AS largest_km2 FROM st GROUP BY label")(
    lambda spark, sf: export.step_extremes(_rounded(storms.step_series(_labelled(spark, sf)), area_km2=6))
)
query("q_advection")(_cube(lambda c: cubes.advection(cubes.displacement(c, 10, 15, box=(1, 9, 2, 14)))))
query("q_panels", f"""WITH {CAT}, c AS (SELECT *, floor(wcentroid_lat) AS glat, floor(wcentroid_lon) AS glon, NOT (truncated_time OR truncated_space) AS whole FROM cat)
  SELECT CASE WHEN grouping(glat) = 0 THEN 'cell_month' WHEN grouping(month) = 0 THEN 'year_month' WHEN grouping(year) = 0 THEN 'year' ELSE 'all' END AS panel, coalesce(year, 0) AS year, coalesce(month, 0) AS month, glat, glon, count(*) AS storms, CAST(sum(whole::BIGINT) AS BIGINT) AS untruncated, {VOLSUM} AS volume_km3,
  CAST(sum(CAST(CASE WHEN whole THEN total_volume_km3 END AS DECIMAL(30,10))) AS DOUBLE) AS untruncated_km3, max(max_intensity_mm_hr) AS max_intensity_mm_hr, quantile_cont(duration_h, 0.5) AS median_duration_h, round(quantile_cont(duration_h, 0.95), 6) AS p95_duration_h, count(DISTINCT month) AS months FROM c GROUP BY GROUPING SETS ((), (year), (year, month), (glat, glon, month))""")(_cat(lambda c: panels.panels(c).fillna(0, ["year", "month"])))


def _rasterised(spark: SparkSession, sf: str) -> DataFrame:
    cells = adapters.grid(spark).select("y", "x", (F.lit(-11.55) + F.lit(0.1) * F.col("y")).alias("lat"), (F.lit(94.45) + F.lit(0.1) * F.col("x")).alias("lon"))
    return geo.rasterise(cells, adapters.shapes(spark, sf)).groupBy(F.coalesce("name", F.lit("none")).alias("name")).agg(F.count("*").alias("cells"), F.min("y").alias("first_row"), F.max("y").alias("last_row"), F.sum("x").alias("columns"))


query("q_rasterised", f"""WITH {GRID}, c AS (SELECT y, x, -11.55e0 + 0.1e0 * y AS lat, 94.45e0 + 0.1e0 * x AS lon FROM grid), s AS (SELECT p_partkey AS ord, p_brand AS name, -11.55e0 + 0.1e0 * ((p_partkey * 37) % 182) + 0.013e0 AS la, 94.45e0 + 0.1e0 * ((p_partkey * 91) % 472) + 0.017e0 AS lo, 0.2e0 + p_size / 25e0 AS r FROM part),
  e AS (SELECT ord, name, unnest([{{pa: la + r, po: lo, qa: la - r, qo: lo + r}}, {{pa: la - r, po: lo + r, qa: la - 0.3e0 * r, qo: lo}}, {{pa: la - 0.3e0 * r, po: lo, qa: la - r, qo: lo - r}}, {{pa: la - r, po: lo - r, qa: la + r, qo: lo}}]) AS z FROM s),
  h AS (SELECT y, x, ord, name FROM c JOIN e ON lat >= least(z.pa, z.qa) AND lat <= greatest(z.pa, z.qa) AND (z.pa > lat) <> (z.qa > lat) WHERE lon < z.po + (lat - z.pa) / (z.qa - z.pa) * (z.qo - z.po) GROUP BY ALL HAVING count(*) % 2 = 1),
  g AS (SELECT y, x, max_by(name, ord) AS name FROM h GROUP BY 1, 2) SELECT coalesce(name, 'none') AS name, count(*) AS cells, min(y) AS first_row, max(y) AS last_row, CAST(sum(x) AS BIGINT) AS columns FROM c LEFT JOIN g USING (y, x) GROUP BY 1""")(_rasterised)
query("q_age_exceedance", f"WITH {CAT}, y AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat) SELECT h AS hours, CAST(sum((duration_h >= h)::BIGINT) AS BIGINT) AS storms, sum((duration_h >= h)::BIGINT) / any_value(years) AS per_year, coalesce(CAST(sum(CAST(CASE WHEN duration_h >= h THEN total_volume_km3 END AS DECIMAL(30,10))) AS DOUBLE), 0e0) / {VOLSUM} AS volume_share FROM cat, y, (VALUES (12e0), (24e0), (48e0), (72e0)) x(h) GROUP BY h")(
    _cat(lambda c: analyses.age_exceedance(c, climatology.years_of(c)))
)
query("q_propagation_speed", f"WITH {_LANDED}, s AS (SELECT offshore_km_at_start / hours_at_sea AS v FROM ld WHERE offshore_km_at_start > 15 AND hours_at_sea > 0) SELECT count(*) AS n, round(quantile_cont(v, 0.25), 6) AS p25_km_h, round(quantile_cont(v, 0.5), 6) AS median_km_h, round(quantile_cont(v, 0.75), 6) AS p75_km_h FROM s")(
    lambda spark, sf: _rounded(analyses.propagation_speed(_landed(spark, sf)), p25_km_h=6, median_km_h=6, p75_km_h=6)
)


def _regional_edges(cat: DataFrame) -> DataFrame:
    return analyses.regional_edges(_thirds(cat.where(untruncated())), climatology.years_of(cat)).withColumn("region", F.coalesce("region", F.lit(-1)))


query("q_regional_edges", f"""WITH {CAT}, y AS (SELECT count(DISTINCT year * 100 + month) / 12e0 AS years FROM cat), a AS (SELECT {_THIRD} AS region, total_volume_km3 AS v FROM whole UNION ALL SELECT -1, total_volume_km3 FROM whole), r AS (SELECT region, v, row_number() OVER (PARTITION BY region ORDER BY v DESC) AS k, count(*) OVER (PARTITION BY region) AS n FROM a),
  e AS (SELECT region, n, max(v) FILTER (k = least(greatest(CAST(round_even(500 * years, 0) AS BIGINT), 1), n)) AS lo, max(v) FILTER (k = least(greatest(CAST(round_even(50 * years, 0) AS BIGINT), 1), n)) AS hi FROM r, y GROUP BY region, n)
  SELECT region = -1 AS domain, region, n / years AS storms_per_year, lo AS low_km3, hi AS high_km3, hi / (SELECT hi FROM e WHERE region = -1) AS of_domain FROM e, y""")(_cat(_regional_edges))


def _density_by_height(spark: SparkSession, sf: str) -> DataFrame:
    vox, heights = _vox(spark, sf), [2.0, 4.0, 8.0]
    components = materialize(mergetree.build(vox)[0], "components")
    cut = mergetree.Flood(vox).cuts(components, heights, 2)
    named = cut.withColumn("label", F.col("label") * 10 + F.col("h").cast("long"))
    table = materialize(storms.storm_table(materialize(named, "labels")).withColumn("h", (F.col("label") % 10).cast("double")), "storms")
    return _rounded(analyses.density_concentration(table, 20_000.0, 1.0), mean_volume_km3=6, mean_duration_h=9, top_share=6)


query("q_density_concentration", f"""WITH RECURSIVE {_TREE}, {_survivors('(2e0), (4e0), (8e0)')}, o AS (SELECT h, label, sum({VOL}) AS vol, (max(t) - min(t) + 1) * 0.5e0 AS dur FROM lab GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY vol DESC, label) AS k, count(*) OVER (PARTITION BY h) AS n FROM o)
  SELECT h, n / 0.02e0 AS storms_per_mkm2_month, round({ES.format('vol')} / n, 6) AS mean_volume_km3, round({ES.format('dur')} / n, 9) AS mean_duration_h, round(CAST(sum(CAST(CASE WHEN k <= greatest(round_even(0.13e0 * n, 0), 1) THEN vol END AS DECIMAL(30,10))) AS DOUBLE) / {ES.format('vol')}, 6) AS top_share FROM k GROUP BY h, n""")(_density_by_height)
