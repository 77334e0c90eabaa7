"""What all operators of this subpackage share: words, shared storage, input tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; any store that Spark's reader opens will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask (``lower`` folds other letters too)."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def python_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the Arrow batches that Python operators get, as texts may be long.

    The setting is read when a plan starts, so it holds for the whole session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: Spark's setting to remove an execution's shuffle files at its end rather than at some collection of the driver.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession):
    """What runs inside leaves no shuffle files behind."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def trimmed(spark: SparkSession) -> bool:
    """Gives native memory that the driver's two processes have freed back to the system; whether the JVM knows how.

    Planning, compiling and fetching in many threads leave the C library's arenas full of free blocks, which
    it keeps: a driver that runs many short jobs grows with their number, whatever their size.
    """
    with contextlib.suppress(AttributeError, OSError):  # the C library may be another
        ctypes.CDLL(None).malloc_trim(0)
    sc = spark.sparkContext
    jvm, of = sc._jvm, sc._jvm.java.lang.Class.forName

    def array(kind, *values):
        out = sc._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        # the server's own class is not open to reflection, its interface is
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(of, kinds)))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(server, array(jvm.java.lang.Object, command, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:  # an older JVM or another system
        return False
    return True


class Scratch:
    """Tables written to the shared folder that ``spark.checkpoint.dir`` names.

    Writing a table cuts lineage: a lost executor costs its running tasks, not
    the earlier steps. A folder of our own is set only if the session has none and
    runs in this process alone, as in tests; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="foliant-")
            spark.sparkContext.setCheckpointDir(base)
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table; the shuffle files of the write and the driver's free native memory go when it ends."""
        path = self.path(name)
        with freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        trimmed(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


#: Rows of two or three longs that a broadcast may hold.
MOST_BROADCAST = 200_000


def bounded(keys: DataFrame) -> DataFrame:
    """A written table of a few longs a row, marked for broadcast if it holds at most MOST_BROADCAST rows; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
