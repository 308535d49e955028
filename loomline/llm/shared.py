"""What the operators share: the cluster's folder, shipped code, batches of text."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder, set as its checkpoint
    folder; a session on a cluster is refused, as its machines share no such folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/loomline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: cuts the lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`written` wrote for frames that are not read any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, *frames: DataFrame) -> None:
    """Between two steps: delete what ``frames`` hold and let Spark drop the shuffles of finished steps.

    Spark deletes a shuffle's files once the driver has collected what refers to it, which it
    may not do for long where the driver itself does little.
    """
    discard(*frames)
    spark.sparkContext._jvm.java.lang.System.gc()


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` to the shared folder and hand it to every executor; returns its file name."""
    file = f"{uuid.uuid4().hex[:12]}-{name}"
    uri = f"{scratch(spark, 'file')}/{file}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    if file.endswith(".zip"):
        spark.sparkContext.addPyFile(uri)
    else:
        spark.sparkContext.addFile(uri)
    return file


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith((".py", ".toml")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    put_file(spark, "loomline.zip", buffer.getvalue())
    _shipped.add(app)


def trimmed() -> None:
    """Give back the memory that this process holds free: a Python worker goes on to other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it keeps
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in their order, in slices of at most ``limit`` bytes of text or one longer row."""
    trimmed()
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)
    trimmed()


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """As :func:`chunks`, with small batches put together up to ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in chunks(batches, text, limit):
        n = pa.compute.sum(pa.compute.binary_length(piece.column(text))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held)
