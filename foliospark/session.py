"""Session settings and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) a folder of
    this machine is made and set, once per session, and removed when the driver
    ends. On a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path that is deleted when the driver ends."""
    path = new_table_path(spark, name)
    at, files = _hadoop(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage into the plan that made it, survives the loss of
    executors and is compressed and columnar, which ``checkpoint()`` is not. The
    table is deleted when the driver ends; a caller that names its ``path`` may
    drop it sooner.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark, name)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table just read, in enough partitions to keep all cores busy.

    Only a table in at most half as many splits as there are cores is moved, which
    no large table is; costly work on a small file then does not run in one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def _hadoop(spark: SparkSession, path: str):
    """(path, file system) of the driver's JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder written by this package."""
    at, files = _hadoop(spark, path)
    files.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no such folder."""
    at, files = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def matching_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the files that a folder holds or a pattern matches."""
    at, files = _hadoop(spark, path)
    found = [s for m in files.globStatus(at) or [] for s in (files.listStatus(m.getPath()) if m.isDirectory() else [m])]
    return sorted(s.getPath().getName() for s in found)


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _hadoop(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole; an error where it is there already."""
    at, files = _hadoop(spark, path)
    part, _ = _hadoop(spark, f"{path}.part-{uuid.uuid4().hex}")
    stream = files.create(part, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if files.exists(at) or not files.rename(part, at):
        files.delete(part, False)
        raise FileExistsError(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this session this package, once."""
    import pathlib
    import zipfile

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="foliospark-")  # the driver's; workers fetch the file from it
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    target = pathlib.Path(own) / "foliospark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
