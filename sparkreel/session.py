"""Session and table helpers shared by the queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def local_session(cpus: int | str = 8, app: str = "sparkreel") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by columns to as many tasks as shuffles have: few rows of small files that each become many would else share one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares for checkpoints (spark.checkpoint.dir).

    Only a local session may do without that setting; a temporary folder then takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir[0] if _own_dir else tempfile.mkdtemp(prefix="sparkreel-")
        _own_dir[:] = [root]
    return f"{root.rstrip('/')}/sparkreel-{uuid.uuid4().hex}"
