"""Table access: parquet reads, written cuts of the lineage, first arrivals."""

from __future__ import annotations

import atexit
import io
import os
import site
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library, once per Spark application.

    Nothing is done where they find it themselves: installed, on PYTHONPATH, or in the working directory.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages(), site.getusersitepackages()]
    if context.applicationId in _SHIPPED or str(package.parent) in {os.path.realpath(k) for k in known if k}:
        return
    _SHIPPED.add(context.applicationId)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = Path(tempfile.mkdtemp(prefix="terralace-")) / "terralace.zip"  # on the driver; Spark hands it out from there
    path.write_bytes(held.getvalue())
    context.addPyFile(str(path))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (``<folder>/<name>.parquet``, a file or a directory)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) a temporary folder is made, and only under a local master,
    because another machine could not read it.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS[own] = "file://" + tempfile.mkdtemp(prefix="terralace-")
    return _OWN_FOLDERS[own]


def cut_folder(spark: SparkSession, name: str = "cut") -> str:
    """A new folder below the shared one; it is removed at the end of the ``cuts`` scope it was made in."""
    ship(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return path


@contextmanager
def cuts() -> Iterator[None]:
    """Remove what was written inside: run a query to its end within it, so that a long session keeps no files."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        _sweep(before)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write ``df`` as parquet into the shared folder and read it back.

    A lost executor costs nothing afterwards, columns stay prunable, and the size of the result is known to the
    planner. The files are removed at the end of the scope (``cuts``), at the latest when the driver's Python ends.
    """
    path = cut_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep(start: int = 0) -> None:
    for spark, path in _WRITTEN[start:]:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            break
    del _WRITTEN[start:]


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; exact for files that were just written."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, limit: int = 16 << 20) -> bool:
    """Whether ``df`` may be broadcast: its estimated size is at most ``limit`` bytes."""
    return size_in_bytes(df) <= limit


def first_arrivals(df: DataFrame, key: str, time: str, keep: list[str]) -> DataFrame:
    """One row per ``key``: the columns ``keep`` of its earliest delivery by ``time``, and ``time`` itself.

    Ties of ``time`` go to the smallest values of ``keep`` in their order, so the result doesn't depend on the order
    of the rows. A null time counts as later than any time. Rows whose key is null are no records and drop out.
    Partial aggregation runs before the shuffle.
    """
    order = F.struct(F.col(time).isNull().alias("late"), F.col(time).alias(time), *[F.col(c) for c in keep])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    return best.select(key, F.col(f"first.{time}").alias(time), *[F.col(f"first.{c}").alias(c) for c in keep])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Enough partitions for all cores where a few small files give fewer; all other plans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def month_of(time: Column) -> Column:
    """yyyy-MM of a timestamp."""
    return F.date_format(time, "yyyy-MM")
