"""Written intermediate tables and binary files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset: a temporary folder on a
    local master, as in tests, and the shared warehouse on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = tempfile.mkdtemp(prefix="pagemill-llm-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/pagemill-llm/{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)


def written(frame: DataFrame, path: str, **options: str) -> DataFrame:
    """The frame after it is written: later reads start from files that outlive an executor."""
    with freed(frame.sparkSession):
        frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def dropped(*paths: str) -> None:
    """Delete written folders that nothing reads any more."""
    for path in paths:
        system, inner = opened(path)
        system.delete_dir(inner)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a folder; works for every store that Arrow can reach."""
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write one file; every attempt of a task uses a name of its own, so none meets another's."""
    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/{name}") as out:
        out.write(data)
