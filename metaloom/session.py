"""Session helpers shared by operators: scratch folder, lineage cuts, shipping the package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCRATCH: list[list[str]] = []
_ALIVE: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share. Only on one machine a temporary one is set where the session names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="metaloom-checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a folder of tables in the shared checkpoint folder.

    Frames that read it need it as long as they are used, so it lives until :func:`discard`, the end of the
    :func:`scratch` that it was made in, :func:`release`, or else the end of the application, whose file system deletes
    it then.
    """
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _ALIVE.append(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def cut(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """``df`` as a table written in the shared checkpoint folder (:func:`new_folder`): later jobs neither recompute it nor lose it with an executor, read only the columns they need, and plan with its true size. ``rows_a_file`` (0: any number) is for very large rows."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    if path in _ALIVE:
        _ALIVE.remove(path)


def discard(*cuts: DataFrame) -> None:
    """Deletes the tables behind frames that :func:`cut` has returned, when nothing will read them again."""
    for df in cuts:
        delete(df.sparkSession, _TABLES.pop(df))


def release(spark: SparkSession) -> None:
    """Deletes all tables that are left of earlier queries: for a long session whose results have been written or collected."""
    for path in list(_ALIVE):
        delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end: for work whose result has been written by then."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            if path in _ALIVE:
                delete(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (they may not share the driver's folders)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="metaloom-ship-"), "metaloom_pkg.zip")
    Path(path).write_bytes(out.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
