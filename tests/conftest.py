import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pixelweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Tables from NumPy masks and from rows."""
    import numpy as np
    import pandas as pd

    class Make:
        def mask(self, a, scene=0):
            ys, xs = np.nonzero(a)
            pdf = pd.DataFrame({"scene_id": np.full(len(ys), scene, np.int64), "y": ys.astype("int32"), "x": xs.astype("int32")})
            return spark.createDataFrame(pdf, "scene_id bigint, y int, x int")

        def values(self, a, name="v", scene=0):
            ys, xs = np.indices(a.shape)
            pdf = pd.DataFrame({"scene_id": np.full(a.size, scene, np.int64), "y": ys.ravel().astype("int32"),
                                "x": xs.ravel().astype("int32"), name: a.ravel().astype(float)})
            return spark.createDataFrame(pdf, f"scene_id bigint, y int, x int, {name} double")

        def scenes(self, *shapes):
            from pixelweave.functions import geo
            from pyspark.sql import functions as F

            df = spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate(shapes)], "scene_id bigint, height int, width int")
            return df.withColumn("epsg", F.lit(25832)).withColumn("transform", geo.affine(1.0, 0.0, 0.0, 0.0, -1.0, 0.0))

        def array(self, df, shape, col=None, fill=0):
            out = np.full(shape, fill, float if col else bool)
            for r in df.collect():
                out[r["y"], r["x"]] = r[col] if col else True
            return out

    return Make()


def discs(shape, centres, radius):
    import numpy as np

    yy, xx = np.indices(shape)
    a = np.zeros(shape, bool)
    for y, x in centres:
        a |= (yy - y) ** 2 + (xx - x) ** 2 <= radius * radius
    return a
