"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_stored: list[str] = []        # tables of ``materialize`` that still exist


def build_session(app_name: str = "tidemark", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are planned for; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without that setting; it then gets a folder of its own, which
    is removed when the process ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_folder.get(context.applicationId)
        if root is None:
            root = _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/tidemark/{context.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored table.

    Cuts the lineage so that a lost executor never replays what lies before, and lets later passes
    read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_since(mark: int = 0) -> list[str]:
    """Paths of the tables stored after the first ``mark`` ones."""
    return _stored[mark:]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables of ``materialize``.  The caller knows that nothing reads them any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _stored:
            _stored.remove(path)


def remove_folders(spark: SparkSession, addresses: list[str]) -> None:
    """Delete these folders, given as addresses with escapes, as file metadata names them."""
    for address in addresses:
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(address))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_by_value(module: str) -> None:
    """Send the module's Python functions to executors with the task, so that none of them needs
    this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
