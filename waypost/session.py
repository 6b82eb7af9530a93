"""Session helpers: tables, and intermediate results kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; others are refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; it is unset and the master is {master}")
        folder = "file://" + tempfile.mkdtemp(prefix="waypost-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_made: set[str] = set()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written once as Parquet to the shared folder and read from there.

    Cuts the lineage like checkpoint(), survives the loss of executors, and later reads prune columns. The files go when the
    session's process ends.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/waypost-{spark.sparkContext.applicationId}"
    if root not in _made:
        _made.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(df: DataFrame, name: str = "stage") -> DataFrame:
    """staged(), with denser files, and the shuffle files behind them go as soon as they are written; for tables as large as the input."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in (_CLEANUP, "spark.sql.parquet.compression.codec")}
    try:
        conf.set(_CLEANUP, "true")
        conf.set("spark.sql.parquet.compression.codec", "zstd")
        return staged(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def dropped(*done: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in done:
        ours = f"/waypost-{df.sparkSession.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if ours in f}:
            _drop(df.sparkSession, folder)


def _drop(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone by now; the cluster's own cleaning has the folder
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, which need not see the repository's folder."""
    sc = spark.sparkContext
    if getattr(sc, "_waypost_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="waypost-")) / "waypost_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path(here.name) / f.relative_to(here))
    sc.addPyFile(str(archive))
    sc._waypost_shipped = True
