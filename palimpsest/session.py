"""Sessions, and tables written on the way through a long plan."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}
_CHOOSING = threading.Lock()
_TIDYING = threading.Lock()
_TIDIED: dict[str, list] = {}  # per application: writers at work, and the setting before the first of them
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's folder inside the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent, a local master gets a temporary folder; a cluster gets an
    error, since a machine-local folder is lost with its machine.
    """
    app = spark.sparkContext.applicationId
    with _CHOOSING:
        if app in _ROOTS:
            return _ROOTS[app][1]
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = (spark, f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex[:12]}")
        return _ROOTS[app][1]


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile removes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    app = spark.sparkContext.applicationId
    with _TIDYING:
        if app not in _TIDIED:
            _TIDIED[app] = [0, spark.conf.get(_SHUFFLES, None)]
            spark.conf.set(_SHUFFLES, "true")
        _TIDIED[app][0] += 1
    try:
        yield
    finally:
        with _TIDYING:
            _TIDIED[app][0] -= 1
            if not _TIDIED[app][0]:
                _, before = _TIDIED.pop(app)
                if before is None:
                    spark.conf.unset(_SHUFFLES)
                else:
                    spark.conf.set(_SHUFFLES, before)


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    with _tidy(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Remove the table that `stage` gave, or its folder `part` (name=value): nothing may read it any more."""
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{root.getName()}/" in folder and folder.endswith(part):
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def together(*makers: Callable[[], Any]) -> list[Any]:
    """What the calls give, made at the same time: jobs that don't need each other's results share the cores."""
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        return [f.result() for f in [pool.submit(m) for m in makers]]


def release(spark: SparkSession) -> None:
    """Remove what `stage` wrote in this session; its DataFrames are unusable afterwards."""
    _, root = _ROOTS.pop(spark.sparkContext.applicationId, (None, None))
    if root:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_ROOTS.values()):
        try:
            release(spark)
        except Exception:  # the JVM may be gone by now
            pass
