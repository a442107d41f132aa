"""Reading and writing scenes, tiles, products and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.scalar import fetch_ok
from .listing import list_files

BLOCK = 256                   # rows and columns of a block of stored pixels
SCENES = ("scene_id bigint, height int, width int, n_bands int, dtype string, epsg int, "
          "transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, nodata double, "
          "acquired timestamp, path string")
TRAINING_TILES = ("tile_name string, height int, width int, image array<array<double>>, "
                  "features array<array<float>>, label array<bigint>")


def read_manifest(spark: SparkSession, folder: str, recursive: bool = True, limit: int | None = None,
                  suffixes: Sequence[str] = fv.CHIP_SUFFIXES, depth: int = 1) -> DataFrame:
    """Paths and lengths of raster chips, sorted. Contents are never read, and
    tasks list the folders: one for each of the first ``depth`` levels."""
    return chip_manifest(list_files(spark, folder, recursive, depth, suffixes), limit, suffixes)


def chip_manifest(files: DataFrame, limit: int | None = None, suffixes: Sequence[str] = fv.CHIP_SUFFIXES) -> DataFrame:
    """The raster chips of a listing, sorted by path."""
    ending = F.regexp_extract("path", r"\.([^./]*)$", 1)
    out = files.where(ending.isin(*suffixes)).orderBy("path")
    return out.limit(limit) if limit is not None else out


def read_pixels(spark: SparkSession, path: str, bands: Sequence[int] | None = None,
                nodata: float | None = None) -> DataFrame:
    """Pixel table with the chosen 1-based bands (else all) as columns b1, b2, ...

    Bands are stored as columns, so bands that are not asked for are not read.
    NaN and nodata become NULL.
    """
    df = spark.read.parquet(path)
    names = [f"b{i}" for i in bands] if bands is not None else [c for c in df.columns if c[:1] == "b" and c[1:].isdigit()]
    return df.select("scene_id", "y", "x", *[_missing(F.col(n), nodata).alias(n) for n in names])


def _missing(v, nodata):
    bad = F.isnan(v) if nodata is None else F.isnan(v) | (v == nodata)
    return F.when(~bad, v)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENES).parquet(path)


def _in_blocks(df: DataFrame) -> DataFrame:
    """Rows laid out by scene and block, sorted within: few files, and footers
    whose ranges let readers skip blocks."""
    by = [F.floor(F.col(c) / BLOCK).cast("int").alias(f"_{c}") for c in ("y", "x") if c in df.columns]
    keyed = df.select("*", *by)
    names = ["scene_id", *[c for c in ("_y", "_x") if c in keyed.columns]]
    order = [*names, *[c for c in ("y", "x") if c in df.columns]]
    return keyed.repartition(*names).sortWithinPartitions(*order).select(*df.columns)


def write_pixels(df: DataFrame, path: str) -> None:
    """Pixels with one column per band (b1, b2, ...)."""
    _in_blocks(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_training_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Training tiles with the image as 0..1 and whole-number labels."""
    return scale_training_tiles(spark.read.schema(TRAINING_TILES).parquet(path))


def scale_training_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn(
        "image", F.transform("image", lambda px: F.transform(px, lambda v: v.cast("double") / 255.0))
    ).withColumn("label", F.col("label").cast("array<bigint>"))


def training_tiles(tile_pixels: DataFrame, bands: Sequence[str], base: str = "scene",
                   features: str | None = None) -> DataFrame:
    """One record per tile (scene_id, y0, x0): pixel vectors and labels in
    row-major order. A tile's pixel count is fixed by the tiling, so the lists
    are bounded."""
    item = F.struct("y", "x", F.array(*[F.col(b).cast("double") for b in bands]).alias("v"),
                    F.col("label").cast("bigint").alias("l"))
    g = tile_pixels.groupBy("scene_id", "y0", "x0").agg(
        F.sort_array(F.collect_list(item)).alias("_p"),
        *([F.min_by(features, F.struct("y", "x")).alias("features")] if features else []))
    last = F.element_at("_p", -1)
    return g.select(
        F.format_string("%s%d_y%d_x%d", F.lit(base), "scene_id", F.col("y0").cast("bigint"), F.col("x0").cast("bigint"))
        .alias("tile_name"),
        (last["y"] - F.col("_p")[0]["y"] + 1).cast("int").alias("height"),
        (last["x"] - F.col("_p")[0]["x"] + 1).cast("int").alias("width"),
        F.transform("_p", lambda p: p["v"]).alias("image"),
        (F.col("features") if features else F.lit(None)).cast("array<array<float>>").alias("features"),
        F.transform("_p", lambda p: p["l"]).alias("label"))


def write_training_tiles(tiles: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append tiles that are not stored yet; the commit protocol makes each
    write all-or-nothing."""
    if done is not None:
        tiles = pending_tiles(tiles, done, "tile_name")
    tiles.write.mode("append").option("compression", "zstd").parquet(path)


_PIXEL_PRODUCTS = ("mask", "labels")


def write_products(path: str, mask: DataFrame | None = None, labels: DataFrame | None = None,
                   regions: DataFrame | None = None, boxes: DataFrame | None = None,
                   points: DataFrame | None = None, wrap_labels: bool = False) -> None:
    """Write result tables under ``path``, laid out by scene and block.
    ``wrap_labels`` stores label ids modulo 65536, as 16-bit label images do."""
    if labels is not None and wrap_labels:
        labels = wrap_label_ids(labels)
    tables = {"mask": mask, "labels": labels, "regions": regions, "boxes": boxes, "points": points}
    for name, df in tables.items():
        if df is not None:
            _in_blocks(df).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_product(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables of ``write_products``.

    Pixel tables are sorted and take a byte or two a row in their files, far
    less than in memory. The planner only knows the files, so joins of them are
    kept from broadcasting one."""
    df = spark.read.parquet(f"{path}/{name}")
    return df.hint("merge") if name in _PIXEL_PRODUCTS else df


def wrap_label_ids(labels: DataFrame) -> DataFrame:
    return labels.withColumn("label", F.col("label") % 65536)


def collect_patch_outputs(manifest: DataFrame) -> DataFrame:
    """(name, path): outputs named output_SR_image_*.tif in a patch folder's
    ``outputs``; of equal names the one from the last patch folder stays."""
    pattern = r"([^/]+)/outputs/(output_SR_image_[^/]*\.tif)$"
    return manifest.select("path", F.regexp_extract("path", pattern, 1).alias("_dir"),
                           F.regexp_extract("path", pattern, 2).alias("name")).where(
        F.col("name") != "").groupBy("name").agg(F.max_by("path", "_dir").alias("path"))


def collect_patch_sidecars(manifest: DataFrame, logs: bool = False, inputs: bool = False) -> DataFrame:
    """(target, path) of log and input files of patches that have outputs."""
    pattern = r"([^/]+)/(outputs|logs|data_sentinel2)/(.*)$"
    parts = manifest.select("path", *[F.regexp_extract("path", pattern, i).alias(n)
                                      for i, n in ((1, "_dir"), (2, "_kind"), (3, "_rest"))])
    ready = parts.where(F.col("_kind") == "outputs").select("_dir").distinct()
    wanted = (["logs"] if logs else []) + (["data_sentinel2"] if inputs else [])
    suffix = F.when(F.col("_kind") == "logs", "_logs/").otherwise("_data/")
    return parts.where(F.col("_kind").isin(wanted)).join(ready, "_dir", "left_semi").select(
        F.concat("_dir", suffix, "_rest").alias("target"), "path")


def pending_tiles(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose output does not exist yet."""
    return manifest.join(done.select(key), key, "left_anti")


def fetch_summary(log: DataFrame, msg: str = "msg") -> DataFrame:
    ok = fetch_ok(F.col(msg))
    return log.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def _parquet_opens(content: bytes) -> bool:
    import io

    import pyarrow.parquet as pq

    try:
        pq.read_table(io.BytesIO(content))
        return True
    except Exception:
        return False


def quarantine(spark: SparkSession, folder: str, opens: Callable[[bytes], bool] = _parquet_opens,
               glob: str = "*.parquet") -> DataFrame:
    """(path, length, state) of stored tile files: 'good' or 'corrupt', by
    trying to decode each once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "length": b["length"],
                                "state": ["good" if opens(c) else "corrupt" for c in b["content"]]})

    return files.mapInPandas(check, "path string, length bigint, state string")


def check_tiles(tiles: DataFrame) -> DataFrame:
    """Training tiles with ``state``: 'size' if the image or label has not
    height * width pixels, 'bands' if pixels differ in their number of bands,
    'missing' if a value is NULL or NaN, else 'good'. One pass, no decoding."""
    n = F.col("height") * F.col("width")
    bad = F.coalesce((F.size("image") != n) | (F.size("label") != n), F.lit(True))
    uneven = F.array_min(F.transform("image", F.size)) != F.array_max(F.transform("image", F.size))
    hole = F.exists("image", lambda px: px.isNull() | F.exists(px, lambda v: v.isNull() | F.isnan(v))) | F.exists("label", lambda v: v.isNull())
    return tiles.withColumn("state", F.when(bad, "size").when(uneven, "bands").when(hole, "missing").otherwise("good"))
