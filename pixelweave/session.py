"""Session helpers: a local session for tests and lineage cutting for iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pixelweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # joins that feed a group by of their own key are split too
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pixelweave-checkpoint-"))
        .config("spark.driver.memory", os.environ.get("PIXELWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, for clusters on which it is not installed."""
    target = Path(tempfile.mkdtemp(prefix="pixelweave-ship-")) / "pixelweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder. On a cluster it
    must be named: executors would write to their own disks otherwise.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pixelweave-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, *used_up: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Against ``checkpoint()`` the table also brings true sizes, so small sides
    of later joins are seen as small, and drops the size estimates and
    constraints of the old plan, which grow with every join of an iteration.
    ``used_up`` are earlier results of this function that nothing reads any
    more: their tables are deleted once ``df`` is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/pixelweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_tables(*used_up)
    out = spark.read.schema(df.schema).parquet(path)
    out._pixelweave_table = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete the tables of ``cut_lineage`` results that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_pixelweave_table", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
