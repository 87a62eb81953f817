"""Cutting lineage with tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names the folder.  Where it is unset, as in tests on one machine, a temporary folder is made;
on a cluster that would be a machine-local folder, so there it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Share of the driver's heap from which its garbage is collected between jobs.
GROWN = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a path that Spark's writers take."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="velograph-")
    return _local[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; the folder goes when the driver's JVM ends.

    An executor lost later costs nothing, as its part of the table does not have to be made again.  What the driver held
    for the jobs behind it is let go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._velograph_path = path
    _let_go(spark)
    return table


def _let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to a good share of what it may have.

    The driver keeps little from one job to the next, but plans, stages and tasks of many jobs fill its heap up to the
    limit before it collects them all, and shuffle files and broadcasts of past jobs are only then deleted.  In local mode the
    heap is that of the tasks too and is left alone.
    """
    if spark.sparkContext.master.split("[")[0] == "local":
        return
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > GROWN * heap.maxMemory():
        spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised ``tables``, once no result that is still to be read comes from them."""
    for table in tables:
        spark, path = table.sparkSession, table._velograph_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
