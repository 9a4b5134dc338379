"""What the text operators share: the shared folder, tables written to it, and small driver helpers."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs on one machine, as in tests, a folder of our own is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: the text operators write tables that all executors read")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="eddyforge-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/eddyforge/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is made: texts may be long, and a batch is held several times.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Rows up to which a table of one row a language or the like is broadcast.
FEW_ROWS = 100_000


def collect_garbage(spark: SparkSession) -> None:
    """Give back what past tables left in the driver.

    A result made of many jobs leaves plans on the driver's heap, which grows to its limit before it is
    collected, and compilers leave freed native memory that the C library keeps; Spark deletes shuffle
    files and broadcasts of past jobs only when the heap is collected.
    """
    jvm, java = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        kinds, args = java.new_array(jvm.Class, 4), java.new_array(jvm.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, args)
    except Py4JError:  # a JVM or C library without it
        pass


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. What past
    tables left in the driver goes first."""
    collect_garbage(spark)
    path, before = new_path(spark, name), spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows; a larger one is joined as it comes."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator uses, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
