"""Session helpers: building a local session, cutting lineage, checking sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "loreline", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benches; on a cluster use the one that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); set to a temporary one only where it is unset, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            folder = tempfile.mkdtemp(prefix="loreline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.setCheckpointDir(folder)
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, so that later stages neither recompute nor lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most bound rows, reading no more than bound + 1 of them."""
    return df.limit(bound + 1).agg(F.count(F.lit(1))).first()[0] <= bound
