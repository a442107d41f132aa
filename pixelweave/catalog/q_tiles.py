"""Tile grids."""

from pyspark.sql import functions as F

from ..operators import tiles as tl
from . import fixtures as fx
from .registry import query, r6

# Starts along one axis as SQL lists; L is the length expression.
_STRIDE = "range(0, greatest(1, {L} - 24 + 1), 10)"
_STRIDE_EDGE = "list_sort(list_distinct(list_concat(range(0, greatest(1, {L} - 24 + 1), 10), [greatest(0, {L} - 24)])))"
_SNAPPED = "CASE WHEN 24 >= {L} THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, greatest(1, {L} - 24), 18), [{L} - 24]))) END"
_PADDED = "range(0, {L}, 18)"
_SHIFTED = "list_sort(list_distinct(list_transform(range(0, {L}, 24), lambda s: CASE WHEN s + 24 > {L} THEN greatest(0, {L} - 24) ELSE s END)))"


def _grid_sql(starts: str, clip: bool = True) -> str:
    ys, xs = (starts.format(L=f"CAST({n} AS BIGINT)") for n in ("height", "width"))
    end = "least({s} + 24, {n})" if clip else "{s} + 24"
    return fx.with_(fx.PX, fx.SCENES, f"""ax AS (SELECT scene_id, height, width, {ys} AS ys, {xs} AS xs FROM scenes),
ay AS (SELECT *, unnest(ys) AS y0, generate_subscripts(ys, 1) AS iy FROM ax),
axx AS (SELECT *, unnest(xs) AS x0, generate_subscripts(xs, 1) AS ix FROM ay)""") + f"""SELECT scene_id,
  CAST((iy - 1) * len(xs) + ix - 1 AS BIGINT) AS tile_id, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0,
  CAST({end.format(s='y0', n='height')} AS INT) AS y1, CAST({end.format(s='x0', n='width')} AS INT) AS x1 FROM axx"""


def _register(name: str, grid: tl.Grid, starts: str, clip: bool = True):
    @query(name, _grid_sql(starts, clip))
    def _(spark, sf):
        return tl.list_tiles(fx.scenes(spark, sf), grid)


_register("tile_stride", tl.tile_stride(24, 10), _STRIDE)
_register("tile_stride_covering", tl.tile_stride(24, 10, cover_edges=True), _STRIDE_EDGE)
_register("tile_snapped", tl.tile_snapped(24, 6), _SNAPPED)
_register("tile_padded", tl.tile_padded(24, 6), _PADDED, False)
_register("tile_shifted", tl.tile_shifted(24), _SHIFTED)


def _assign_sql(starts: str) -> str:
    ys, xs = (starts.format(L=f"CAST({n} AS BIGINT)") for n in ("height", "width"))
    return fx.with_(fx.PX, fx.SCENES, f"""sy AS (SELECT scene_id, unnest({ys}) AS y0 FROM scenes),
sx AS (SELECT scene_id, unnest({xs}) AS x0 FROM scenes)""") + """SELECT px.scene_id, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0,
  count(*) AS n, round(sum(b1), 2) AS total FROM px JOIN sy ON sy.scene_id = px.scene_id AND y >= y0 AND y < y0 + 24
  JOIN sx ON sx.scene_id = px.scene_id AND x >= x0 AND x < x0 + 24 GROUP BY ALL"""


def _register_assign(name: str, grid: tl.Grid, starts: str):
    @query(name, _assign_sql(starts))
    def _(spark, sf):
        got = tl.assign_tiles(fx.pixels(spark, sf), fx.scenes(spark, sf), grid)
        return got.groupBy("scene_id", "y0", "x0").agg(F.count("*").alias("n"), r6(F.sum("b1"), "total", 2))


_register_assign("assign_tiles_stride", tl.tile_stride(24, 10), _STRIDE)
_register_assign("assign_tiles_snapped", tl.tile_snapped(24, 6), _SNAPPED)
_register_assign("assign_tiles_padded", tl.tile_padded(24, 6), _PADDED)
_register_assign("assign_tiles_shifted", tl.tile_shifted(24), _SHIFTED)


@query("padded_tile_pixels", fx.with_(fx.PX, fx.SCENES, """t AS (SELECT scene_id, y0, unnest(range(0, width, 18)) AS x0 FROM
  (SELECT scene_id, width, unnest(range(0, height, 18)) AS y0 FROM scenes)),
c AS (SELECT scene_id, y0, x0, y, unnest(range(x0, x0 + 24)) AS x FROM (SELECT *, unnest(range(y0, y0 + 24)) AS y FROM t))""") +
       """SELECT c.scene_id, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x, coalesce(b2, 0.0) AS b2
  FROM c LEFT JOIN px ON px.scene_id = c.scene_id AND px.y = c.y AND px.x = c.x""")
def _(spark, sf):
    return tl.padded_tile_pixels(fx.pixels(spark, sf), fx.scenes(spark, sf), tl.tile_padded(24, 6), ["b2"])


@query("token_grid", "SELECT p_partkey, CAST(p_size AS INT) AS hp, 10 AS wp FROM part")
def _(spark, sf):
    """Images of size x 10 patches, not an exact multiple in pixels."""
    g = tl.token_grid(F.col("p_size") * 16 + 3, F.lit(165), F.col("p_size") * 10, 16)
    return fx.table(spark, sf, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.hp", "g.wp")


@query("token_grid_by_aspect", "SELECT p_partkey, CAST(p_size AS INT) AS hp, CAST(p_size AS INT) AS wp FROM part")
def _(spark, sf):
    """Token counts that disagree with the division: square grids by aspect."""
    s = F.col("p_size")
    g = tl.token_grid((s + 2) * 16, (s + 2) * 16, s * s, 16)
    return fx.table(spark, sf, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.hp", "g.wp")


_MIN = """CAST(CASE WHEN {e} - {s} < 16 THEN greatest(0, {e} - 16) ELSE {s} END AS INT)"""


@query("tile_min_size", fx.with_(fx.PX, fx.SCENES, """c AS (SELECT *, unnest(range(0, width, 24)) AS xa FROM (SELECT *, unnest(range(0, height, 24)) AS ya FROM scenes)),
d AS (SELECT scene_id, ya, xa, least(ya + 24, height) AS yb, least(xa + 24, width) AS xb FROM c)""") + f"""SELECT scene_id,
  CAST(ya AS INT) AS write_y0, CAST(xa AS INT) AS write_x0, CAST(yb AS INT) AS write_y1, CAST(xb AS INT) AS write_x1,
  {_MIN.format(s='ya', e='yb')} AS read_y0, {_MIN.format(s='xa', e='xb')} AS read_x0, CAST(yb AS INT) AS read_y1, CAST(xb AS INT) AS read_x1 FROM d""")
def _(spark, sf):
    return tl.tile_min_size(fx.scenes(spark, sf), 24, 16)


@query("tile_sr_geometry", fx.with_(fx.PX, fx.SCENES, f"""sy AS (SELECT *, unnest({_SNAPPED.format(L='CAST(height AS BIGINT)')}) AS y0 FROM scenes),
sx AS (SELECT *, unnest({_SNAPPED.format(L='CAST(width AS BIGINT)')}) AS x0 FROM sy)""") + """SELECT scene_id, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0,
  CAST(CASE WHEN y0 = 0 THEN 0 ELSE y0 + 2 END * 4 AS INT) AS out_y0, CAST(CASE WHEN x0 = 0 THEN 0 ELSE x0 + 2 END * 4 AS INT) AS out_x0,
  CAST(CASE WHEN least(y0 + 24, height) = height THEN height ELSE y0 + 22 END * 4 AS INT) AS out_y1,
  CAST(CASE WHEN least(x0 + 24, width) = width THEN width ELSE x0 + 22 END * 4 AS INT) AS out_x1 FROM sx""")
def _(spark, sf):
    return tl.tile_sr_geometry(fx.scenes(spark, sf), 24, 6, 4, 2).select(
        "scene_id", "y0", "x0", "out_y0", "out_x0", "out_y1", "out_x1")


@query("snap_grid", """SELECT c_custkey, unnest(range(xa, xb, 1000)) AS cell_x, cell_y FROM (SELECT *, unnest(range(ya, yb, 1000)) AS cell_y FROM
  (SELECT c_custkey, CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) AS xa, CAST(ceil((c_acctbal + 1700) / 1000) * 1000 AS BIGINT) AS xb,
  CAST(floor(c_custkey * 3.5 / 1000) * 1000 AS BIGINT) AS ya, CAST(ceil((c_custkey * 3.5 + 900) / 1000) * 1000 AS BIGINT) AS yb FROM customer))""")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("min_x"), (F.col("c_acctbal") + 1700).alias("max_x"),
        (F.col("c_custkey") * F.lit(3.5)).alias("min_y"), (F.col("c_custkey") * F.lit(3.5) + 900).alias("max_y"))
    return tl.snap_grid(c, 1000).select("c_custkey", "cell_x", "cell_y")


_CENTERS = """CASE WHEN {hi} - {lo} <= {p} THEN [({lo} + {hi}) / 2.0] ELSE list_transform(range(0, CAST(ceil(({hi} - {lo} - {p}) / {s}) AS BIGINT) + 1),
  lambda i: greatest({lo} + {p} / 2.0, least({lo} + {p} / 2.0 + i * {s}, {hi} - {p} / 2.0))) END"""


@query("grid_centers", fx.with_(f"""c AS (SELECT c_custkey, {_CENTERS.format(lo='0.0', hi='w', p='0.6', s='0.5')} AS cs FROM
  (SELECT c_custkey, CAST(c_custkey % 97 AS DOUBLE) / 13.0 AS w FROM customer))""") +
       "SELECT c_custkey, CAST(i - 1 AS INT) AS pos, round(center, 9) AS center FROM (SELECT c_custkey, unnest(cs) AS center, generate_subscripts(cs, 1) AS i FROM c)")
def _(spark, sf):
    span = (F.col("c_custkey") % 97).cast("double") / 13.0
    c = tl.grid_centers(F.lit(0.0), span, F.lit(0.6), F.lit(0.5))
    return fx.table(spark, sf, "customer").select("c_custkey", F.posexplode(c).alias("pos", "center")).select(
        "c_custkey", "pos", r6("center", digits=9))


_LL = fx.with_(fx.SITES, "b AS (SELECT site_id, lat AS s, lat + 0.11 AS n, lon AS w, lon + 0.13 AS e FROM sites)",
               f"r AS (SELECT *, {_CENTERS.format(lo='s', hi='n', p='(5120.0 / 111320.0)', s='(4992.0 / 111320.0)')} AS lats FROM b)",
               "rr AS (SELECT *, len(lats) AS row_count, unnest(lats) AS latitude, generate_subscripts(lats, 1) - 1 AS row_index FROM r)",
               "rs AS (SELECT *, 5120.0 / (111320.0 * cos(radians(latitude))) AS p, 4992.0 / (111320.0 * cos(radians(latitude))) AS st FROM rr)",
               f"c AS (SELECT *, {_CENTERS.format(lo='w', hi='e', p='p', s='st')} AS lons FROM rs)",
               "cc AS (SELECT *, len(lons) AS column_count, unnest(lons) AS longitude, generate_subscripts(lons, 1) - 1 AS column_index FROM c)")


@query("latlon_patches", _LL + """SELECT site_id, CAST(row_index AS INT) AS row_index, CAST(row_count AS INT) AS row_count,
  CAST(column_index AS INT) AS column_index, CAST(column_count AS INT) AS column_count, round(latitude, 9) AS latitude,
  round(longitude, 9) AS longitude, 512 AS edge_size FROM cc""")
def _(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    b = fx.sites(spark, sf).select(
        "site_id", (lat + 0.11).alias("lat1"), lon.alias("lon1"), lat.alias("lat2"), (lon + 0.13).alias("lon2"))
    return tl.latlon_patches(b, 512, 10.0).select(
        "site_id", "row_index", "row_count", "column_index", "column_count", r6("latitude", digits=9),
        r6("longitude", digits=9), "edge_size")
