"""Tables written in the shared folder, where lineage ends: a lost executor loses none of them."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GC_EVERY = 4
_written = itertools.count(1)
_passing: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back. Its shuffle files go as soon as it is written, and
    after every GC_EVERY tables what the driver keeps of the plans before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if (mine := _passing.get()) is not None:
        mine.append((spark, path))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if next(_written) % GC_EVERY == 0:
        tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def tidy(spark: SparkSession) -> None:
    """The driver drops what it keeps of earlier plans. Its C library, which holds what compilers and network threads have freed,
    gives that back to the system, where the JVM has the command for it."""
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # another JVM or C library
        _trimmed(spark.sparkContext._gateway, jvm)


def _trimmed(gateway, jvm) -> str:
    """What the JVM says of its command. Its server of beans has no class that may be called from outside, so the interface's
    method is taken."""
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


@contextlib.contextmanager
def passing() -> Iterator[list[tuple[SparkSession, str]]]:
    """Tables staged inside go at the end, but for those taken off the list: what is made of them must be collected or staged by then."""
    mine: list[tuple[SparkSession, str]] = []
    outer = _passing.set(mine)
    try:
        yield mine
    finally:
        _passing.reset(outer)
        for spark, path in mine:
            drop_table(spark, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The staged result of make(); the tables staged on the way to it go. A table of an outer step goes with that step."""
    with passing() as mine:
        out = staged(make(), name)
        last = mine.pop()
    if (outer := _passing.get()) is not None:
        outer.append(last)
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    drop_table(df.sparkSession, df.staged_at)
