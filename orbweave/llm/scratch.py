"""Shared working folder for intermediate tables.

The cluster names a folder that the driver and all executors share in
``spark.checkpoint.dir``.  Only a session on one machine (a local master) that
leaves it unset gets a temporary folder; any other session must set it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Size of Arrow batches between the JVM and Python workers, where the session
#: sets none: a worker's memory follows the batch, and documents are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI without a trailing slash."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise NoSharedFolder(f"set {_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set(_KEY, found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        if key not in spark.conf.getAll:
            spark.conf.set(key, str(value))


def lean(run):
    """``run`` of mapInArrow, giving freed memory back to the system at the end.

    Workers are used again, and Arrow's pool and the C heap would keep the most
    that any partition of any operator needed.
    """

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return trimmed


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orbweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread.

    This cuts the lineage: a lost executor costs only the tasks it ran, never
    the stages before the table.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
