"""Session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Settings the operators rely on; sizes such as shuffle partitions belong to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "millrace", master: str | None = None, **conf) -> SparkSession:
    """Create (or reuse) a session with the settings above plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder for written tables and stream checkpoints.

    It lies under ``spark.checkpoint.dir``, which every executor must reach. Only a
    local session without that setting falls back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    name = f"{label}-{uuid.uuid4().hex[:12]}"
    if shared:
        return f"{shared.rstrip('/')}/millrace/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.mkdtemp(prefix='millrace-')}/{name}"


#: Spark's switch for removing the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITERS: dict[str, tuple[int, str | None]] = {}


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside remove their shuffle files when they end; the caller's setting comes back after the last.

    Spark would keep them until the driver happens to collect its garbage.
    """
    name = spark._jsparkSession.sessionUUID()
    with _LOCK:
        count, before = _WRITERS.get(name) or (0, spark.conf.get(CLEANUP, None))
        _WRITERS[name] = count + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            count, before = _WRITERS.pop(name)
            if count > 1:
                _WRITERS[name] = count - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def checkpointed(df, label: str, folder: str | None = None):
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    A caller that names a ``folder`` owns what is written below it, and removes it. What the
    write has shuffled goes with it, so a chain of steps holds the shuffle files of one of them.
    """
    path = f"{folder}/{label}" if folder else workspace(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it lies; a missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def side_by_side(spark: SparkSession, function: Callable, items: Iterable, jobs: int = 4) -> list:
    """``function`` of every item, in order, with the Spark jobs of a few items running at once."""
    with ThreadPoolExecutor(jobs) as pool:
        return list(pool.map(inheritable_thread_target(spark)(function), items))
