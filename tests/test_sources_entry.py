import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelweave import sources as src
from pixelweave.operators.tiles import assign_tiles, tile_shifted

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_listing_is_split_by_folder(spark, tmp_path):
    for i, name in enumerate(["a.tif", "x/b.tif", "x/deep/c.tiff", "y/d.png", "z/e.TIF", "x/deep/deeper/f.tif"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * i)
    for depth, parts in ((1, 4), (2, 5)):
        got = src.list_files(spark, f"file://{tmp_path}", depth=depth)
        assert sorted((r["path"].removeprefix(str(tmp_path)), r["length"]) for r in got.collect()) == sorted(
            [("/a.tif", 0), ("/x/b.tif", 1), ("/x/deep/c.tiff", 2), ("/y/d.png", 3), ("/z/e.TIF", 4), ("/x/deep/deeper/f.tif", 5)])
        assert got.rdd.getNumPartitions() == parts
    assert src.list_files(spark, str(tmp_path), suffixes=["tif"]).count() == 3
    assert src.list_files(spark, str(tmp_path), recursive=False).count() == 1
    (tmp_path / "none").mkdir()
    assert src.list_files(spark, str(tmp_path / "none")).count() == 0


def test_manifest_lists_four_spellings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("b.tif", "a.TIFF", "c.tiff", "d.TIF", "e.png", "f.tif.aux.xml", "sub/g.tif"):
        (tmp_path / n).write_bytes(b"x")
    names = [os.path.basename(r["path"]) for r in src.read_manifest(spark, str(tmp_path)).collect()]
    assert names == ["a.TIFF", "b.tif", "c.tiff", "d.TIF", "g.tif"]
    assert src.read_manifest(spark, str(tmp_path), recursive=False).count() == 4
    assert src.read_manifest(spark, str(tmp_path), limit=2).count() == 2


def test_pixels_round_trip(spark, tmp_path):
    rows = [(0, 0, 0, 1.0, float("nan"), 7.0), (1, 0, 1, 0.0, 4.0, None)]
    df = spark.createDataFrame(rows, "scene_id bigint, y int, x int, b1 double, b2 double, b3 double")
    src.write_pixels(df, str(tmp_path / "px"))
    read = src.read_pixels(spark, str(tmp_path / "px"), [2, 1], nodata=0.0)
    assert [(r["b2"], r["b1"]) for r in read.orderBy("scene_id").collect()] == [(None, 1.0), (4.0, None)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "b3" not in plan[plan.index("ReadSchema"):]
    assert tuple(src.read_pixels(spark, str(tmp_path / "px")).where("scene_id = 0").first())[3:] == (1.0, None, 7.0)


def test_products_round_trip(spark, tmp_path):
    lab = spark.createDataFrame([(0, 0, 0, 65537), (1, 0, 0, 9)], "scene_id bigint, y int, x int, label bigint")
    src.write_products(str(tmp_path), mask=lab.drop("label"), labels=lab, wrap_labels=True)
    assert {r["label"] for r in src.read_product(spark, str(tmp_path), "labels").collect()} == {1, 9}
    assert src.read_product(spark, str(tmp_path), "mask").count() == 2


def test_training_tiles_resume(spark, make, tmp_path):
    px = make.values(np.arange(400.0).reshape(20, 20)).withColumn("label", F.lit(1))
    tiles = src.training_tiles(assign_tiles(px, make.scenes((20, 20)), tile_shifted(16)), ["v"])
    out = str(tmp_path / "tiles")
    src.write_training_tiles(tiles.limit(1), out)
    src.write_training_tiles(tiles, out, done=spark.read.parquet(out))
    got = src.read_training_tiles(spark, out)
    assert got.count() == 4 and got.select("tile_name").distinct().count() == 4
    first = got.where("tile_name = 'scene0_y0_x0'").first()
    assert (first["height"], first["width"], len(first["image"])) == (16, 16, 256)
    assert first["image"][1] == [1.0 / 255.0]


def test_corrupt_files_are_separated(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "bad.parquet").write_bytes(b"nothing")
    got = src.quarantine(spark, str(tmp_path / "t")).collect()
    assert sorted(r["state"] for r in got) == ["corrupt", "good"]
    assert [os.path.basename(r["path"]) for r in got if r["state"] == "corrupt"] == ["bad.parquet"]


def test_entry(spark):
    assert entry.entry(spark).count() >= 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "stretch_2_98", "excess_green", "assign_tiles_snapped", "latlon_patches", "mosaic", "paint_labels", "resize_bicubic",
    "region_props", "label_boundaries", "closing_disk", "connected_components", "clean_field_mask", "seed_prompts",
    "score_clusters", "knn_classify_majority", "sample_rows", "to_utm",
])
def test_query_matches_sql(spark, name):
    if name not in entry.oracle_sql():
        pytest.skip("no SQL")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(str(tuple(r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_stored_pixels_are_not_broadcast(spark, tmp_path):
    """A sorted pixel table is small in its file only."""
    px = spark.range(20000).select(F.lit(0).cast("bigint").alias("scene_id"), F.floor(F.col("id") / 100).cast("int").alias("y"),
                                   (F.col("id") % 100).cast("int").alias("x"), (F.col("id") * 7).alias("label"))
    src.write_products(str(tmp_path), labels=px, mask=px.drop("label"), regions=px.limit(3).drop("y", "x"))
    both = src.read_product(spark, str(tmp_path), "labels").join(src.read_product(spark, str(tmp_path), "mask"), ["scene_id", "y", "x"])
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == 20000
    assert src.read_product(spark, str(tmp_path), "regions").count() == 3
