"""Fixed values of the data model: units, grid and default thresholds."""

# Fixed values; results depend on each of them.
DT_HOURS = 0.5
STEPS_PER_DAY = 48
EARTH_RADIUS_M = 6_371_008.8
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.32
GRID_DEG = 0.1
LAT_FIRST, LAT_CELLS = -11.55, 182
LON_FIRST, LON_CELLS = 94.45, 472
WET_THRESHOLD, PROMINENCE, MIN_VOXELS = 1.0, 4.0, 6
PERCOLATION_ALARM = 0.20
WET_LEVELS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
SEVERITY_NAMES = ("very low", "low", "moderate", "medium", "heavy", "very heavy", "intense", "severe", "extreme")
AGE_CLASSES = ("under a day", "1 day", "2 days", "3+ days")
TRANSITIONS = ("sea -> land", "sea -> sea", "land -> land", "land -> sea")
MIN_RECORD_YEARS = 10
PERCENTILE_BANDS = (90.0, 99.0)
STORM_RATE_BANDS = (500.0, 50.0)
FAMILY_RATE_BANDS = (200.0, 20.0)
