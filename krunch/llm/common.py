"""Shared plumbing: table access, lineage cuts in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one, but only if there is
    no cluster: the executors of one would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="krunch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/krunch/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may have ended before; the files are the cluster's to expire then
            return


#: While a table is written, Spark drops each query's shuffle files as soon as it ends: what is written is the only copy needed.
#: Batches for Python are no larger than the slices that are made of them: a larger one would be held twice for nothing.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    for name, value in _WRITING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write(df: DataFrame, path: str, *by: str) -> None:
    """df as Parquet at path, partitioned by the columns named."""
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder, so that a lost executor costs no recomputation, and read it back."""
    path = new_path(df.sparkSession, label)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._krunch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialise() has written, once nothing that reads them is left to run."""
    for df in tables:
        path = df._krunch_path
        drop_path(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those put in the list that it gives."""
    kept, before = [], len(_written)
    yield kept
    paths = {df._krunch_path for df in kept}
    for entry in [x for x in _written[before:] if x[1] not in paths]:
        drop_path(*entry)
        _written.remove(entry)


def without(docs: DataFrame, gone: Callable[[], DataFrame], label: str) -> DataFrame:
    """The rows of docs whose doc_id isn't among gone()'s, with all columns of docs. A null doc_id names nothing, so its rows stay.

    The ids are written first: Spark then knows their size, broadcasts them if it is below its threshold, and else
    joins by shuffle. Whatever gone() writes on the way is deleted.
    """
    with passing() as kept:
        ids = materialise(gone().select(F.col("doc_id").alias("gone_id")).distinct(), label)
        kept.append(ids)
    return docs.join(ids, docs["doc_id"] == ids["gone_id"], "left_anti").select(*(docs[c] for c in docs.columns))


def pieces_of(df: DataFrame, size: int) -> int:
    """How many partitions of about size bytes the tables under df make, by what Catalyst knows of their files; where it
    knows nothing, as many as spark.sql.shuffle.partitions."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found >= 1 << 55:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(1 << 20, -(-found // size)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one stays small. Behind the last, memory goes back to the machine:
    Python workers outlive their tasks, and what they hold on to counts against the executor."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
