"""Session helpers: settings every job relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tidepool") -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter's session is used as is."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Settings the library needs whatever the session: UTC clock, AQE, skew splitting."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, wherever they run, once per context: operators
    whose functions run there are imported by name."""
    import shutil
    sc = spark.sparkContext
    if getattr(sc, "_tidepool_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="tidepool-package-"), "tidepool")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "tidepool"))
    sc._tidepool_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only when unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidepool-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def cut_lineage(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back
    (never a local checkpoint).  Columnar and written once, unlike an RDD checkpoint, which
    computes the plan again to write it; a lost executor recomputes nothing upstream."""
    import uuid
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def spread_for_write(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cluster rows by the output partition columns before a partitioned write; AQE sizes the
    writers by bytes: small values share one, and a hot value (one type or day holding a third of the
    rows) is split over as many as its size needs."""
    return df.hint("rebalance", *cols)
