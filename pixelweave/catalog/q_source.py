"""Sources, sinks and names."""

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from .. import sources as src
from ..functions import geo
from ..functions.scalar import response_ok
from ..operators.pixels import pick_bands
from ..operators.tiles import assign_tiles, tile_shifted
from ..session import checkpoint_folder
from ..sources.listing import open_folder
from . import fixtures as fx
from .registry import query, r6


def _folder(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/products/{uuid.uuid4().hex}"


_CHIPS = """ch AS (SELECT '/chips/' || lower(c_mktsegment) || '/c' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.tif.aux.xml' WHEN 3 THEN '.png' ELSE '_tif' END AS path,
  CAST(c_nationkey * 1000 + c_custkey AS BIGINT) AS length FROM customer)"""


@query("read_manifest", fx.with_(_CHIPS) + "SELECT path, length FROM ch WHERE path LIKE '%.tif' OR path LIKE '%.TIFF'")
def _(spark, sf):
    """The chips of a listing with sidecars, other images and names without an ending."""
    c, k = fx.table(spark, sf, "customer"), F.col("c_custkey") % 5
    end = F.when(k == 0, ".tif").when(k == 1, ".TIFF").when(k == 2, ".tif.aux.xml").when(k == 3, ".png").otherwise("_tif")
    files = c.select(F.concat(F.lit("/chips/"), F.lower("c_mktsegment"), F.lit("/c"), "c_custkey", end).alias("path"),
                     (F.col("c_nationkey") * 1000 + F.col("c_custkey")).cast("bigint").alias("length"))
    return src.chip_manifest(files)


@query("list_files", fx.with_(_CHIPS) + """SELECT substr(path, 8) AS path, CAST(length % 97 AS BIGINT) AS length FROM ch WHERE path LIKE '%.tif' OR path LIKE '%.TIFF'""")
def _(spark, sf):
    """A tree of files, a folder for each segment and one below it for each last
    digit's half, is written by tasks and listed by tasks."""
    c, k = fx.table(spark, sf, "customer"), F.col("c_custkey") % 5
    end = F.when(k == 0, ".tif").when(k == 1, ".TIFF").when(k == 2, ".tif.aux.xml").when(k == 3, ".png").otherwise("_tif")
    at = _folder(spark)
    c.select(F.lower("c_mktsegment").alias("folder"), F.concat(F.lit("c"), "c_custkey", end).alias("name"),
             ((F.col("c_nationkey") * 1000 + F.col("c_custkey")) % 97).cast("int").alias("n")).repartition("folder").mapInArrow(
        lambda batches: _put_files(at, batches), "files bigint").agg(F.sum("files")).collect()
    got = src.read_manifest(spark, at)
    return got.select(F.regexp_replace("path", "^.*/([^/]+)/(?:odd|even)/([^/]+)$", "$1/$2").alias("path"), "length")


def _put_files(at, batches):
    system, top = open_folder(at)
    for b in batches:
        for folder, name, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            where = f"{top}/{folder}/{'odd' if n % 2 else 'even'}"
            system.create_dir(where)
            with system.open_output_stream(f"{where}/{name}") as f:
                f.write(b"x" * n)
        yield pa.RecordBatch.from_pydict({"files": pa.array([b.num_rows], pa.int64())})


@query("read_pixels", fx.with_(fx.PX8) + "SELECT scene_id, y, x, b1, CASE WHEN b3 <> 50 THEN b3 END AS b3, CASE WHEN b8 <> 50 THEN b8 END AS b8 FROM px")
def _(spark, sf):
    """Pixels are written with a nodata value and NaN and read back with three of eight bands."""
    px = fx.pixels(spark, sf, lines=True)
    at = _folder(spark)
    src.write_pixels(px.withColumn("b3", F.coalesce("b3", F.lit(float("nan")))), at)
    return src.read_pixels(spark, at, [1, 3, 8], nodata=50.0)


@query("pick_bands", fx.with_(fx.PX8) + "SELECT scene_id, y, x, b1, b3, b8 FROM px")
def _(spark, sf):
    px = fx.band_array(fx.pixels(spark, sf, lines=True))
    return pick_bands(px, [1, 3, 8], ["b1", "b3", "b8"])


_TILES = """scenes AS (SELECT scene_id, max(y) + 1 AS height, max(x) + 1 AS width FROM px GROUP BY scene_id),
t AS (SELECT px.*, CAST(least((y // 16) * 16, greatest(0, height - 16)) AS INT) AS ya,
  CAST(greatest(0, height - 16) AS INT) AS yb, CAST((x // 16) * 16 AS INT) AS xa, CAST(width - 16 AS INT) AS xb
  FROM px JOIN scenes USING (scene_id)),
ty AS (SELECT scene_id, y, x, b1, b2, xa, xb, unnest(list_distinct(list_filter([ya, yb], lambda s: s <= y AND y < s + 16))) AS y0 FROM t),
tp AS (SELECT scene_id, y, x, b1, b2, y0, unnest(list_distinct(list_filter([least(xa, xb), xb], lambda s: s <= x AND x < s + 16))) AS x0 FROM ty)"""


def _tile_pixels(spark, sf):
    px = fx.pixels(spark, sf).withColumn("label", F.col("b2").cast("int") % 2)
    return assign_tiles(px, fx.scenes(spark, sf), tile_shifted(16))


@query("read_training_tiles", fx.with_(fx.PX, _TILES) + """SELECT 'scene' || scene_id || '_y' || y0 || '_x' || x0 AS tile_name,
  count(*) AS n, CAST(sum(CAST(b2 AS BIGINT) % 2) AS BIGINT) AS positives,
  round(sum(b1 / 255.0 + b2 / 255.0), 3) AS total FROM tp GROUP BY scene_id, y0, x0""")
def _(spark, sf):
    """Tiles are stored and read back scaled."""
    at = _folder(spark)
    src.write_training_tiles(src.training_tiles(_tile_pixels(spark, sf), ["b1", "b2"]), at)
    tiles = src.read_training_tiles(spark, at)
    return tiles.select(
        "tile_name", F.size("image").cast("bigint").alias("n"),
        F.aggregate("label", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("positives"),
        r6(F.aggregate("image", F.lit(0.0), lambda a, p: a + p[0] + p[1]), "total", 3))


@query("write_training_tiles", fx.with_(fx.PX, _TILES) + """SELECT 'scene' || scene_id || '_y' || y0 || '_x' || x0 AS tile_name,
  CAST(max(y) - min(y) + 1 AS INT) AS height, CAST(max(x) - min(x) + 1 AS INT) AS width, count(*) AS n
  FROM tp GROUP BY scene_id, y0, x0""")
def _(spark, sf):
    """Half of the tiles are stored first; a second write adds those that are not there yet."""
    at, tiles = _folder(spark), src.training_tiles(_tile_pixels(spark, sf), ["b1", "b2"])
    src.write_training_tiles(tiles.where(F.crc32(F.col("tile_name").cast("binary")) % 2 == 0), at)
    src.write_training_tiles(tiles, at, done=spark.read.parquet(at))
    return spark.read.parquet(at).select(
        "tile_name", "height", "width", F.size("label").cast("bigint").alias("n"))


@query("write_products", """SELECT CAST(o_orderkey // 100 AS INT) AS y, CAST(o_orderkey % 100 AS INT) AS x,
  (o_custkey * 977 + o_orderkey) % 65536 AS label FROM orders""")
def _(spark, sf):
    """Label ids are stored as a 16-bit label image has them, and read back."""
    labels = fx.table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 100).cast("int").alias("y"), (F.col("o_orderkey") % 100).cast("int").alias("x"),
        (F.col("o_custkey") * 977 + F.col("o_orderkey")).alias("label")).withColumn("scene_id", F.lit(0).cast("bigint"))
    at = _folder(spark)
    src.write_products(at, labels=labels, mask=labels.drop("label"), wrap_labels=True)
    return src.read_product(spark, at, "labels").join(src.read_product(spark, at, "mask"), ["scene_id", "y", "x"]).select("y", "x", "label")


_PATHS = """files AS (SELECT '/patches/p' || printf('%03d', CAST(c_custkey % 37 AS INT)) || CASE WHEN c_acctbal < 0 THEN '/logs/' ELSE '/outputs/' END
  || CASE WHEN c_mktsegment = 'BUILDING' THEN 'preview_' ELSE 'output_SR_image_' END
  || printf('%d.000000_%d.000000.tif', CAST(c_nationkey AS INT), CAST(c_custkey % 11 AS INT)) AS path FROM customer)"""


def _files(spark, sf):
    return fx.table(spark, sf, "customer").select(F.concat(
        F.lit("/patches/p"), F.format_string("%03d", F.col("c_custkey") % 37),
        F.when(F.col("c_acctbal") < 0, "/logs/").otherwise("/outputs/"),
        F.when(F.col("c_mktsegment") == "BUILDING", "preview_").otherwise("output_SR_image_"),
        F.format_string("%d.000000_%d.000000.tif", "c_nationkey", F.col("c_custkey") % 11)).alias("path"))


@query("collect_patch_outputs", fx.with_(_PATHS) + """SELECT name, max_by(path, dir) AS path FROM (
  SELECT path, regexp_extract(path, '([^/]+)/outputs/(output_SR_image_[^/]*\\.tif)$', 1) AS dir,
  regexp_extract(path, '([^/]+)/outputs/(output_SR_image_[^/]*\\.tif)$', 2) AS name FROM files)
  WHERE name <> '' GROUP BY name""")
def _(spark, sf):
    return src.collect_patch_outputs(_files(spark, sf))


@query("collect_patch_logs", fx.with_(_PATHS) + """SELECT split_part(path, '/', 3) || '_logs/' || split_part(path, '/', 5) AS target, path
  FROM files WHERE path LIKE '%/logs/%' AND split_part(path, '/', 3) IN
  (SELECT split_part(path, '/', 3) FROM files WHERE path LIKE '%/outputs/%')""")
def _(spark, sf):
    return src.collect_patch_sidecars(_files(spark, sf), logs=True)


@query("pending_tiles", """SELECT event_id AS tile_id, event_type FROM events WHERE event_id NOT IN
  (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("event_id").alias("tile_id"), "event_type")
    return src.pending_tiles(e, e.where(F.col("event_type") == "purchase"), "tile_id")


@query("fetch_summary", """SELECT count(*) FILTER (WHERE event_type <> 'error') AS ok,
  count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""")
def _(spark, sf):
    t = F.col("event_type")
    log = fx.table(spark, sf, "events").select(F.concat(
        F.when(t == "error", "FAIL ").when(t == "view", "SKIP ").otherwise("DONE "), F.col("event_id")).alias("msg"))
    return src.fetch_summary(log)


_STATES = """tn AS (SELECT 'scene' || scene_id || '_y' || y0 || '_x' || x0 AS tile_name, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS area, count(*) AS n,
  count(*) FILTER (WHERE b1 > 480000) AS holes, scene_id * 7 + y0 + x0 AS k FROM tp GROUP BY scene_id, y0, x0)"""


@query("response_ok", """SELECT event_id, event_type <> 'error' AND event_id % 3 = 0 AS ok FROM events""")
def _(spark, sf):
    """Responses by status and body: only images with status 200 count."""
    e, k = fx.table(spark, sf, "events"), F.col("event_id") % 3
    status = F.when(F.col("event_type") == "error", 404).otherwise(200)
    body = F.when(k == 0, "image/png").when(k == 1, "text/xml")
    return e.select("event_id", response_ok(status, body).alias("ok"))


@query("quarantine", fx.with_(fx.PX, _TILES, _STATES) + """SELECT tile_name, CASE WHEN n <> area OR k % 9 = 0 THEN 'size' WHEN k % 9 = 1 THEN 'bands' WHEN holes > 0 THEN 'missing' ELSE 'good' END AS state FROM tn""")
def _(spark, sf):
    """Tiles with a label too few, a pixel with a band too few, or missing values."""
    px = _tile_pixels(spark, sf).withColumn("k", F.col("scene_id") * 7 + F.col("y0") + F.col("x0"))
    px = px.withColumn("b1", F.when(F.col("b1") > 480000, F.lit(float("nan"))).otherwise(F.col("b1")))
    k = px.groupBy("scene_id", "y0", "x0").agg(F.first("k").alias("k")).select(
        F.format_string("scene%d_y%d_x%d", "scene_id", F.col("y0").cast("bigint"), F.col("x0").cast("bigint")).alias("tile_name"), "k")
    t = src.training_tiles(px, ["b1", "b2"]).join(k, "tile_name")
    t = t.withColumn("label", F.when(F.col("k") % 9 == 0, F.slice("label", 2, F.size("label") - 1)).otherwise(F.col("label")))
    t = t.withColumn("image", F.when(F.col("k") % 9 == 1, F.transform("image", lambda v, i: F.when(i == 0, F.slice(v, 1, 1)).otherwise(v))).otherwise(F.col("image")))
    return src.check_tiles(t).select("tile_name", "state")


_CELL = "CAST(500000 + 1000 * (s_suppkey % 40) AS BIGINT) AS cx, CAST(5900000 + 1000 * (s_suppkey // 40) AS BIGINT) AS cy"


def _cells(spark, sf):
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey", (500000 + 1000 * (F.col("s_suppkey") % 40)).alias("cx"),
        (5900000 + 1000 * F.floor(F.col("s_suppkey") / 40)).alias("cy"))


@query("getmap_url", f"""SELECT s_suppkey, 'https://maps.example.org/wms?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=rgb&STYLES=&CRS=EPSG:25832&BBOX='
  || cx || '.0,' || cy || '.0,' || (cx + 1000) || '.0,' || (cy + 1000) || '.0&WIDTH=5000&HEIGHT=5000&FORMAT=image/png' AS url
  FROM (SELECT s_suppkey, {_CELL} FROM supplier)""")
def _(spark, sf):
    return _cells(spark, sf).select("s_suppkey", geo.getmap_url(
        "https://maps.example.org/wms", "rgb", F.col("cx"), F.col("cy"), 1000, 5000, 5000, 25832).alias("url"))


@query("tile_name", fx.with_(fx.SITES) + f"""SELECT site_id, printf('output_SR_image_%.6f_%.6f.tif', lat, lon) AS sr_name,
  'dop20_' || cx || '_' || cy || '_1km_20cm.tif' AS cell_name FROM sites JOIN
  (SELECT s_suppkey, {_CELL} FROM supplier) ON s_suppkey = site_id""")
def _(spark, sf):
    c = _cells(spark, sf).withColumnRenamed("s_suppkey", "site_id")
    return fx.sites(spark, sf).join(c, "site_id").select(
        "site_id", geo.sr_name(F.col("lat"), F.col("lon")).alias("sr_name"),
        geo.cell_name(F.col("cx"), F.col("cy")).alias("cell_name"))


@query("parse_tile_name", fx.with_(fx.SITES) + f"""SELECT site_id, lat, lon, cx, cy FROM sites JOIN
  (SELECT s_suppkey, {_CELL} FROM supplier) ON s_suppkey = site_id""")
def _(spark, sf):
    """Names are written and read back."""
    c = _cells(spark, sf).withColumnRenamed("s_suppkey", "site_id")
    named = fx.sites(spark, sf).join(c, "site_id").select(
        "site_id", geo.parse_sr_name(geo.sr_name(F.col("lat"), F.col("lon"))).alias("p"),
        geo.parse_cell_name(geo.cell_name(F.col("cx"), F.col("cy"))).alias("q"))
    return named.select("site_id", "p.lat", "p.lon", F.col("q.x").alias("cx"), F.col("q.y").alias("cy"))


@query("parse_training_tile_name", "SELECT page_id, url, page_id * 512 AS y, page_id * 7 AS x FROM pages")
def _(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", geo.parse_tile_name(
        geo.tile_name(F.col("url"), F.col("page_id") * 512, F.col("page_id") * 7)).alias("t"))
    return p.select("page_id", F.col("t.base").alias("url"), "t.y", "t.x")


@query("bands_for_product", """SELECT page_id, CASE WHEN upper(url) LIKE '%/FR/%' THEN '4,3,2' WHEN upper(url) LIKE '%/EN/%' THEN '12,8,5' END AS bands FROM pages""")
def _(spark, sf):
    u = F.col("url")
    name = F.when(u.contains("/fr/"), F.concat(u, F.lit("_tci.tif"))).when(
        u.contains("/en/"), F.concat(u, F.lit("_IRP.tif"))).otherwise(u)
    return fx.table(spark, sf, "pages").select(
        "page_id", F.array_join(geo.bands_for_product(name).cast("array<string>"), ",").alias("bands"))
