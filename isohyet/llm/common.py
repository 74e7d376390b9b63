"""Session helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> bool:
    """Hand memory that the driver's JVM has freed back to the system; true if that was possible.

    Each query compiles code and starts threads, and the C allocator holds on to what they free, so that a driver of
    many queries grows though nothing is kept. The JVM has a command for it, System.trim_native_heap
    (glibc, JDK 17.0.9 or later), which is called by its management interface; elsewhere nothing happens.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        named = jvm.java.lang.Class.forName
        kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, values)
    except Py4JError:  # this JVM has no such command
        return False
    return True


def hot_from(total: int) -> int:
    """Rows above which a key of ``total`` rows is hot."""
    return max(256, total // 1000)


def joined_by_key(rows: DataFrame, sums: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``sums``, a table with one row per key that says in ``n`` how many of ``total`` rows hold the key.

    Keys with more than a thousandth of the rows (256 at least) are joined by a broadcast: there
    are at most a thousand such keys. So no key sends its rows to one task.
    """
    hot = F.col(n) > hot_from(total)
    broadcast = F.broadcast(sums.filter(hot))
    others = rows.join(F.broadcast(sums.filter(hot).select(key)), key, "left_anti").join(sums.filter(~hot), key)
    return rows.join(broadcast, key).unionByName(others)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or if ``df`` has such a column the name with as many underscores behind it as make it new."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(key: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def fold(key: Column | str, modulus: int, part: int) -> Column:
    """True where the id falls in the held-out part; a null id is never held out."""
    return F.coalesce(remainder(key, modulus) == part, F.lit(False))
