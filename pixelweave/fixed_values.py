"""Constants whose value decides results. Each is stated as is."""

# --- fixed values: scaling -------------------------------------------------
ROBUST_LOW, ROBUST_HIGH = 0.01, 0.99          # band scaling percentiles
STRETCH_LOW, STRETCH_HIGH = 0.02, 0.98        # contrast stretch percentiles
RANGE_EPS = 1e-6                              # guard added to value ranges
NORM_EPS = 1e-8                               # guard added to vector norms
REFLECTANCE_SCALE = 10000.0
REFLECTANCE_FLOAT_MAX = 1.1                   # at or below: unit reflectance
DISPLAY_GAIN, DISPLAY_MIN, DISPLAY_MAX = 3.5, 0.001, 0.9999

# --- fixed values: indices and masks ---------------------------------------
WATER_THRESHOLD = 0.05                        # NDWI above this is water
WATER_VALUE = -1.0
OVERLAY_COLOUR = (46, 204, 113)
COMPOSITE_ORDER = (5, 3, 1)                   # 0-based default band order
BLOCK_MAJORITY = 0.5

# --- fixed values: geography -----------------------------------------------
METRES_PER_DEGREE = 111320.0
UTM_LAT_MIN, UTM_LAT_MAX = -80.0, 84.0
UTM_NORTH_BASE, UTM_SOUTH_BASE = 32600, 32700
LAUNCH_OVERLAP_M = 128.0
CENTRE_EPS = 1e-12
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_K0, UTM_FALSE_EASTING, UTM_FALSE_NORTHING = 0.9996, 500000.0, 10000000.0

# --- fixed values: product names -------------------------------------------
PRODUCT_BANDS = {"_TCI": (4, 3, 2), "_IRP": (12, 8, 5)}
CHIP_SUFFIXES = ("tif", "TIF", "tiff", "TIFF")

# --- fixed values: regions and prompts -------------------------------------
MIN_PROMPT_AREA, PROMPT_AREA_DIVISOR = 250, 6
BOX_MARGIN_SHARE, BOX_MARGIN_MIN = 0.01, 6
FEW_REGIONS = 5
RELAXED_AREA_FLOOR, RELAXED_DISTANCE_FLOOR = 5, 3
OUTLINE_TOLERANCE = 0.01                      # share of the outline length
# boundary pattern code -> length contribution
PERIMETER_WEIGHTS = {
    5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0,
    21: 2.0 ** 0.5, 33: 2.0 ** 0.5,
    13: (1.0 + 2.0 ** 0.5) / 2.0, 23: (1.0 + 2.0 ** 0.5) / 2.0,
}

# --- fixed values: clusters ------------------------------------------------
COVERAGE_BOUNDS = (0.01, 0.7)
COVERAGE_EXTREME = 0.95
KMEANS_STARTS = 5
