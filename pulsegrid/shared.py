"""Intermediate tables in the folder that all executors share.

``written`` cuts lineage with a Parquet table below ``spark.checkpoint.dir``, so
lost executors cost no recomputation beyond their running tasks.  All tables of an
application lie in one folder, which goes when the driver's process ends; ``drop``
removes those that no later plan reads before.  Only on one machine (tests) is a
local folder made where the session names none.
"""

from __future__ import annotations

import atexit
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast; beyond, joins shuffle.
LOOKUP_ROWS = 200_000
_BASE: dict[str, str] = {}
_FOLDERS: dict[str, tuple[object, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset and driver and executors are one machine, else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _BASE:
        _BASE[app] = tempfile.mkdtemp(prefix="pulsegrid-")
        atexit.register(__import__("shutil").rmtree, _BASE[app], True)
    return f"file://{_BASE[app]}"


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _folder(spark: SparkSession) -> str:
    """This application's folder, which goes at the end."""
    path = f"{shared_dir(spark)}/pulsegrid-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


@atexit.register
def clear() -> None:
    """Removes all tables of all applications of this process; also runs when it ends."""
    for path, (jvm, conf) in list(_FOLDERS.items()):
        try:
            _delete(jvm, conf, path)
        except Exception:  # the JVM may have gone before: then nothing can be removed any more
            pass
        del _FOLDERS[path]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there. ``drop`` removes it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pulsegrid_path = path  # type: ignore[attr-defined]
    return out


def free(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame | None) -> None:
    """Removes tables made by ``written`` that no later plan reads, and the shuffle files of plans that are done; others are left alone."""
    known = [df for df in tables if df is not None]
    if known:
        free(known[0].sparkSession)
    for df in known:
        path = getattr(df, "_pulsegrid_path", None)
        if path:
            _delete(df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), path)


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name that is not among ``taken``, whatever its case."""
    have = {c.lower() for c in taken}
    return next(c for c in itertools.chain([name], (f"{name}{i}" for i in itertools.count())) if c.lower() not in have)


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now hands rows to Python in batches of 16 MB at most, unless it sets a bound itself: kernels over long reads take many times a batch's size."""
    conf = df.sparkSession.conf
    if _BYTES not in conf.getAll:
        conf.set(_BYTES, "16m")
    return df


def lookup(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= LOOKUP_ROWS else df


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its places from 0 in the whole order, written: ranges are sorted apart, and the sizes of those before are added."""
    own, part, before = (unused(x, df.columns) for x in ("id", "part", "before"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id())
    made = written(dealt, "numbered").withColumn(part, F.shiftright(own, 33))
    sizes = {r[0]: r[1] for r in made.groupBy(part).count().collect()}  # a row per partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(starts, f"`{part}` long, `{before}` long")
    placed = made.join(F.broadcast(table), part)
    return placed.withColumn(name, F.col(before) + F.col(own).bitwiseAND((1 << 33) - 1)).drop(part, before, own)
