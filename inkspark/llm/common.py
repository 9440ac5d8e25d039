"""Shared-folder scratch space and size-checked broadcasts.

Columns whose names begin with two underscores are the operators' own; tables given to them have none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows up to which an id list may be broadcast; beyond it the same join runs as a shuffle
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder under the shared spark.checkpoint.dir; only where that is unset (as in tests) a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="inkspark-")
            spark.sparkContext.setCheckpointDir(base)
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, once all that was made of it is stored itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (it is read once to count them), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Lets the driver give back what finished jobs have left: garbage, by which Spark's cleaner also learns which shuffle
    files and broadcasts can go, and memory that the JVM's native allocator holds for threads that are done.

    For the ends of long chains of jobs: without it files stay on the executors' disks, and memory with the driver, until
    the driver happens to run short itself.
    """
    spark.sparkContext._jvm.System.gc()
    trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> bool:
    """The JVM's command of this name, by its management interface; False where the JVM has none."""
    from py4j.protocol import Py4JJavaError

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def trimmed(run):
    """``run`` for mapInArrow, whose worker gives its free memory back when its task ends; workers serve many tasks, of other operators, too."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Free memory of this Python process to the system: Arrow's pool, and the C allocator's where it is glibc."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
