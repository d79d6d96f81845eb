"""Session helpers: shipping this package to executors, shared folders, spreading of small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, so workers import it from any working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already imported from the shipped archive
        return
    target = os.path.join(tempfile.mkdtemp(prefix="cohortia-"), "cohortia_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir; a temporary folder only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortia-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def shared_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise a DataFrame in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame that `cut` made and that is no longer used."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession, per_core: int = 2) -> int:
    """Number of tasks for stages whose rows take long: some per core, and no fewer than the session's shuffle partitions."""
    return max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Repartition by key when the input has fewer splits than the cluster has cores; large inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(per_core * cores, *keys)
