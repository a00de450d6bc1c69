"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}  # by application; local sessions without the setting only
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodgecast")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are small: without this one task would take over most stages.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own; on a cluster such a
    folder would be on one machine, so an unset value is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        application = spark.sparkContext.applicationId
        root = _local_roots.get(application)
        if root is None:
            root = _local_roots[application] = tempfile.mkdtemp(prefix="lodgecast-")
    return f"{root.rstrip('/')}/lodgecast-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    written = _scope.get()
    if written is not None:
        written.append(path)
    return path


def checkpoint_folder(spark: SparkSession) -> None:
    """Let Spark's own checkpoints go to the scratch folder where no folder is set for them.

    ``spark.checkpoint.dir`` sets one, so on a cluster nothing changes here.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark)}/checkpoints")


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediates written inside the block when it ends.

    Write or collect every result that depends on them before that.
    """
    written: list[str] = []
    token = _scope.set(written)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in written:
            _delete(spark, path)


@contextmanager
def scratch_noted() -> Iterator[list[str]]:
    """Yield a list that gets the paths of the intermediates written inside the block; they stay
    until :func:`delete_scratch`."""
    written: list[str] = []
    token = _scope.set(written)
    try:
        yield written
    finally:
        _scope.reset(token)
        outer = _scope.get()
        if outer is not None:
            outer.extend(written)


def delete_scratch(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's written intermediates; call it when the job is done."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
