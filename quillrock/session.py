"""Session helpers: table access, the shared folder, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a temporary folder is made and
    removed at exit. On a cluster the setting has to be present: a machine-local folder
    cannot be read by other machines, so its absence raises.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _LOCAL_ROOT
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="quillrock-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT, True)
    return f"file://{_LOCAL_ROOT}"


_LOCAL_ROOT: str | None = None


def _application_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/quillrock-{spark.sparkContext.applicationId}"


_TABLES: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder; nothing is ever written to it
    twice. All of them go when the driver ends (see ``release``)."""
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        _TABLES[app] = []
        atexit.register(_release_at_exit, app)
    return f"{_application_root(spark)}/{label}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and the copy
    outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, first: bool) -> None:
    """Append ``df`` as one sorted run to a hash-bucketed table of this application."""
    app = df.sparkSession.sparkContext.applicationId
    if first:
        _TABLES.setdefault(app, []).append(name)
    w = df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    w.mode("overwrite" if first else "append").saveAsTable(name)


def bucketed(df: DataFrame, label: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` hash-bucketed and sorted by ``key`` and read it back: joins and groupings on
    ``key`` need no shuffle of it. What is shuffled by ``key`` already is written as it lies."""
    spark = df.sparkSession
    name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    append_bucketed(df, name, path, [key], buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), True)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Drop the tables and remove the files that this application wrote to the shared folder; frames
    that read them can no longer be used."""
    sc = spark.sparkContext
    for name in _TABLES.get(sc.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    if sc.applicationId in _TABLES:
        _TABLES[sc.applicationId] = []
        path = sc._jvm.org.apache.hadoop.fs.Path(_application_root(spark))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(app: str) -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext.applicationId == app:
            release(spark)
    except Exception:  # the session ended before the driver did: nothing can be reached any more
        pass


def side_by_side(*parts: Callable[[], DataFrame]) -> list[DataFrame]:
    """Make frames whose walks do not depend on each other at the same time: each walk is a chain of
    small jobs, which leave most of a cluster idle."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(p) for p in parts]]


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers of a cluster (local sessions share
    the driver's path already)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillrock-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "quillrock.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(base, n)
                    z.write(p, os.path.join("quillrock", os.path.relpath(p, here)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def broadcast_if_bounded(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only where the counted rows stay under ``limit``; otherwise the
    planner joins by shuffling."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit else df
