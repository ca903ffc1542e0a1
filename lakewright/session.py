"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job here is written for. Adaptive execution coalesces small shuffle
# partitions, splits skewed join partitions and replaces sort-merge joins whose side
# turns out small; nothing else in the library depends on a fixed partition count. The last
# one stops PySpark from recording the Python line of every column expression, which costs
# more than small queries take to run.
SETTINGS: Mapping[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "lakewright", master: str | None = None, **conf: object) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Root of the folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session may do without it (tests); there a new temporary folder is made
    once and kept in the session's settings.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    key = "spark.lakewright.local.folder"
    made = spark.conf.get(key, None)
    if made:
        return made
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="lakewright-")
    spark.conf.set(key, made)
    return made


def folders_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern of Hadoop's file systems, in whatever store they are."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def drop_folder(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# The paths made inside the innermost ``scratch`` block, if there is one.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever operators write aside inside the block is deleted after it.

    What the block is for must be written by then, to a path made before it: frames that still read the deleted
    folders can't be run any more.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            drop_folder(spark, path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Runtime settings for the actions inside the block; old values come back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
