"""Intermediate tables in the folder that the driver and all executors share.

A table cuts lineage: what it holds never changes, also when executors are
lost.  Tables that a later table has made needless are discarded at once; the
rest, which lazily evaluated results may still read, when the program ends or
``clean`` is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session that runs in one machine may do without the setting: a
    temporary folder takes its place.  On a cluster executors would write to
    folders that nobody else sees, so its absence is an error there.
    """
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted at the latest when the program ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.register(_at_exit)
    _KEPT[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._strandline_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        _delete(table._strandline_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables left; results that were not yet computed cannot be computed any more."""
    for path in [p for p, owner in _KEPT.items() if owner is spark]:
        _delete(path)


def _delete(path: str) -> None:
    spark = _KEPT.pop(path, None)
    if spark is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _at_exit() -> None:
    for path in list(_KEPT):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, the engine is already gone
            return
