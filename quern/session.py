"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CUTS: list[str] = []


def build_session(app: str = "quern", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the launcher's session is used instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, as in
    tests, is a temporary folder made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = named or tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(target)
    return target


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs at most the tasks that were running, and a frame used several
    times is computed once.  ``drop_cuts`` removes what a session has written; the rest goes when the driver ends.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    path = f"{checkpoint_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this process; frames built on them can no longer be read."""
    jvm, done = spark.sparkContext._jvm, 0
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers on machines that see this folder import the package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale folder."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
