"""Sessions, the shared working folder, and tables that cut lineage.

Intermediate tables are written as Parquet under the folder named by ``spark.checkpoint.dir``, which every executor
of a cluster can read: a lost executor then costs a re-read and never the result.  Only a local session that names no
such folder gets one of its own.
"""

from __future__ import annotations

import atexit
import gc
import io
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_folders: dict[str, str] = {}
_shipped: set[str] = set()
#: Tables that ``materialise`` writes between two collections of a ``tidied`` block.
TABLES_A_COLLECTION = 4
_tables: dict[str, int] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables, inside ``spark.checkpoint.dir``.

    Raises RuntimeError on a cluster that names no shared folder, since a machine-local one would not be readable from
    the other machines.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        base = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING, None)
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillon-")
            context.setCheckpointDir(base)
        _folders[app] = f"{base.rstrip('/')}/quillon-{app}"
        atexit.register(_release_quietly, spark)
    return _folders[app]


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, so that they need not have it on their paths."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{shared_folder(spark)}/quillon.zip"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Writes ``df`` into the shared folder; returns it as read back, and its path."""
    spark = df.sparkSession
    ship_code(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    app = spark.sparkContext.applicationId
    if app in _tables:
        _tables[app] += 1
        if _tables[app] % TABLES_A_COLLECTION == 0:
            collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path), path


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of the plans, shuffle files and broadcasts that nothing refers to any more, and of memory that was freed."""
    gc.collect()  # Python's side holds on to the JVM's
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Gives the system back what the driver's JVM has freed outside its heap.

    Compiling code and planning in many threads leaves the C library's allocator with free memory that it keeps, some
    hundred MB.  A JVM without this command (other systems, Java before 17.0.9) goes on as it is.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        known = jvm.java.lang.Class.forName
        # by the interface: the server's own class is not open to reflection
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = known(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        known("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        pass


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """For work of many tables: collects garbage after every few that ``materialise`` writes, and at the end.

    A written table cuts the plans before it off, but their shuffle files and broadcasts stay until the driver's JVM
    happens to collect them, and its heap grows with what is planned meanwhile; a collection also gives the room back.
    Before a large plan, ``collect_garbage`` makes room once more.
    """
    app = spark.sparkContext.applicationId
    outer = app not in _tables
    _tables.setdefault(app, 0)
    try:
        yield
    finally:
        if outer:
            del _tables[app]
            collect_garbage(spark)


def ship_files(spark: SparkSession, path: str) -> list[str]:
    """Gives every executor the file ``path``, or the data files of the folder ``path``, once a session; returns the names
    by which ``SparkFiles.get`` finds them.  A path without a scheme that exists here is a file of this machine."""
    context = spark.sparkContext
    if "://" not in path and os.path.exists(path):
        path = "file://" + os.path.abspath(path)
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath()) for f in fs.listStatus(root) if not f.getPath().getName().startswith(("_", ".")))
    for file in found:
        key = f"{context.applicationId} {file}"
        if key not in _shipped:
            context.addFile(file)
            _shipped.add(key)
    return [file.rsplit("/", 1)[1] for file in found]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``materialise`` wrote and no pending result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results not yet read are lost."""
    app = spark.sparkContext.applicationId
    folder = _folders.pop(app, None)
    _shipped.discard(app)
    if folder:
        drop(spark, folder)


def _release_quietly(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def blocks_for(spark: SparkSession, rows: int, rows_per_block: int = 250_000) -> int:
    """How many blocks keep each one's entries to about ``rows_per_block``, and all tasks evenly busy.

    Blocks are hashed to partitions, so there are several a partition: with one each, some partitions would get three
    or four and others none.
    """
    ship_code(spark)
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_block))
