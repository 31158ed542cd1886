"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from verigauge.session import ship_package


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests, one machine), a new folder of the session."""
    ship_package(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if where is None:
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="run-"))
        where = str(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    elif not held.isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lost executors cost no earlier step again.

    The table stays as long as the folder does; the caller's cluster clears that folder after the job.
    """
    spark = df.sparkSession
    path = fresh(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the table does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def opened(uri: str):
    """(file system, path in it) of a URI, on the driver or in a task."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def release() -> None:
    """Hand freed memory back to the system: Python workers live on and share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A batch function that releases what its task held: only when its generator has ended are its last arrays free."""
    def wrapped(batches):
        yield from run(batches)
        release()
    return wrapped


def put(uri: str, chunks) -> None:
    """Write a file in one step: readers see all of it or nothing, and attempts at a task do not disturb each other."""
    from pyarrow import fs

    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    try:
        system.move(draft, path)
    except OSError:
        # some stores do not replace: then an earlier attempt's file, which holds the same, stays
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(draft)


def mapped(uri: str, kind: str) -> np.ndarray:
    """A file of numbers as an array: memory-mapped where it lies on a mounted folder."""
    system, path = opened(uri)
    if system.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)
