"""Session helpers shared by operators: table access, lineage cuts and shuffle-friendly settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "corpuslane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and UTC; ``master`` is left to the submitter unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_folder(spark: SparkSession) -> str:
    """A temporary folder for intermediate data of a local master, removed when the process ends."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpuslane-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@cache
def _own_folder(application: str) -> str:
    return local_folder(SparkSession.active())


def shared_folder(spark: SparkSession, name: str) -> str:
    """The folder ``name`` for stored tables inside ``spark.checkpoint.dir``; a temporary one for a local master where that is unset."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{configured or _own_folder(spark.sparkContext.applicationId)}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset a local master gets a temporary folder,
    and any other master an error, as executors would not share it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or local_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, tasks_per_core: int = 2) -> DataFrame:
    """Repartition by ``keys`` only where ``df`` has too few partitions to keep the cluster busy (small compressed files)."""
    wanted = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df
