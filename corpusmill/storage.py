"""Reading tables, and cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from functools import reduce
from operator import add
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LEFT: list[tuple[SparkSession, str]] = []
MOST_BROADCAST_BYTES = 64 << 20
LEAST_SPACE = 8 << 30  # bytes that must be free before a run writes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, in whatever store Spark can read, as it lies."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded(df: DataFrame, most_rows: int, name: str = "bounded", most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """``df``, written to the shared folder, with a hint to broadcast it if it has at most ``most_rows`` rows and ``most_bytes``.

    Bytes are those of the strings and binaries in it, and eight for any other value.
    """
    out = materialize(df, name)
    width = lambda f: F.octet_length(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.lit(8)
    each = reduce(add, (F.coalesce(width(f), F.lit(0)) for f in out.schema.fields), F.lit(0))
    rows, size = out.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    if rows > most_rows or size > most_bytes:
        return out
    small = F.broadcast(out)
    small._corpusmill_small = True
    return small


def is_broadcast(df: DataFrame) -> bool:
    """Whether :func:`bounded` found that ``df`` may be broadcast."""
    return getattr(df, "_corpusmill_small", False)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset: a temporary folder in local mode, on a cluster one in the warehouse.

    A warehouse on a local disk is refused on a cluster, as each executor would write to its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        found = _fallback(master == "local" or master.startswith("local["), spark.conf.get("spark.sql.warehouse.dir"))
    return found.rstrip("/")


def _fallback(is_local: bool, warehouse: str) -> str:
    if is_local:
        return os.path.join(tempfile.gettempdir(), "corpusmill-shared")
    if urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: the warehouse is on a local disk")
    return f"{warehouse.rstrip('/')}/_corpusmill"


def materialize(df: DataFrame, name: str = "step", partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again.

    The result depends on files that all executors see, so a lost executor costs no more than the
    tasks it ran, and a plan that uses the result twice doesn't compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def numbered(df: DataFrame, by: str | Column, name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in the order of ``by`` in column ``name``, without a sort in one task.

    Rows are dealt to ranges and written; a row's number is its place in its range after the sizes of the ranges before, of which there are few.
    """
    (part,) = free_names(df, "part")
    ranged = materialize(df.repartitionByRange(by).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n")).collect()  # a row for each partition
    first, before = {}, 0
    for r in sorted(sizes, key=lambda r: r[0]):
        first[r[0]], before = before, before + r[1]
    starts = F.create_map(*(F.lit(x) for kv in first.items() for x in kv)) if first else F.create_map().cast("map<int,int>")
    place = F.row_number().over(Window.partitionBy(part).orderBy(by)) + starts[F.col(part)]
    return ranged.withColumn(name, place).drop(part)


def check_space(spark: SparkSession, folder: str, least: int = LEAST_SPACE) -> int:
    """The bytes left in the store of ``folder``; an error if they are fewer than ``least``. A folder that isn't there yet is that above it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while not fs.exists(where) and where.getParent() is not None:
        where = where.getParent()
    left = fs.getStatus(where).getRemaining()
    if left < least:
        raise RuntimeError(f"only {left} bytes are left in {folder}, and {least} are needed")
    return left


def fingerprint(df: DataFrame) -> tuple:
    """The path, length and time of each file that ``df`` reads: equal as long as the files are."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames from :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_corpusmill_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _LEFT[:] = [x for x in _LEFT if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_LEFT):
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _delete(spark, path)


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
