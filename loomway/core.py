"""Helpers that every layer shares: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Names what this process writes, so that it can be removed when the process ends.
_RUN = uuid.uuid4().hex
_SEEN: set[str] = set()


class _Open(threading.local):
    """Folders written inside each open ``scratch`` block of a thread, innermost last."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_OPEN = _Open()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; then the folder's owner cleans up
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. One of our own is set only on a local master; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", f"loomway-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/loomway/{_RUN}"
    if base not in _SEEN:
        _SEEN.add(base)
        atexit.register(_remove, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _OPEN.blocks:
        _OPEN.blocks[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomway_path = path
    return out


def forget(*written: DataFrame | None) -> None:
    """Remove what ``materialize`` wrote for these; nothing that reads them may run afterwards. Other frames are let be."""
    for df in written:
        path = getattr(df, "_loomway_path", None)
        if path:
            _remove(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is removed at the end: for callers that write their result before they leave."""
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        for path in _OPEN.blocks.pop():
            _remove(spark, path)
