"""Session defaults and table access."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; on a cluster, spark-submit's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package where they would not find it: a zip added to the session once.

    Nothing is sent where workers start in the package's folder or have it on PYTHONPATH.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    near = sc.master.startswith("local") and (os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if near or getattr(sc, "_quern_shipped", False):
        return
    sc._quern_shipped = True
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern"), "zip", root, "quern"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder, read lazily by Spark's Parquet reader (pruning and pushdown apply)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
