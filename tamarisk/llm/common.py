"""What the operators of this subpackage share: tables, shared folders and file access."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What one Arrow batch between the JVM and a Python worker may hold; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 4_000, 8 * 1024 * 1024
#: Bytes of Arrow data that a worker gathers for a row group of an intermediate table.
GROUP_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer parts than there are cores (a file with one row group) is dealt to all cores."""
    rows, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none (tests) gets an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tamarisk-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_made: list[list[str]] = []


def _on_disk(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; it goes with the ``temporaries`` around it, or else when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made, inside = filesystem(path)
    made.create_dir(inside, recursive=True)
    hadoop, p = _on_disk(spark, path)
    hadoop.deleteOnExit(p)
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def temporaries(spark: SparkSession):
    """Folders made inside are deleted at its end: for steps whose result is written to a folder made before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            hadoop, p = _on_disk(spark, path)
            hadoop.delete(p, True)


#: Spark's rule by which a query ends as soon as a side of its join is found empty, though the other side's stages still run.
EMPTY_SIDE = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@contextlib.contextmanager
def without_shuffles(spark: SparkSession):
    """Queries made and run inside leave no shuffle files behind, which else stay until the driver collects its garbage.

    Such a query ends with its last stage, not with an empty side of a join: the files would go from under stages that still run, and tasks
    that ask where they are get no answer, wait for ``spark.network.timeout`` each time and keep the cores from the next query.
    """
    cleanup, excluded = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.optimizer.excludedRules"
    before = {key: spark.conf.get(key, None) for key in (cleanup, excluded)}
    spark.conf.set(cleanup, "true")
    spark.conf.set(excluded, ",".join(filter(None, (before[excluded], EMPTY_SIDE))))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and reread: later reads survive lost executors."""
    return stored_rows(df, name, path)[0]


def stored_rows(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, int]:
    """The same, and the number of rows."""
    return stored_map(df, iter, df.schema, name, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` gives, stored; the folders that it needed meanwhile are deleted."""
    path = new_folder(spark, name)
    with temporaries(spark):
        return stored(make(), name, path)


def stored_map(rows: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: StructType | str, name: str, path: str | None = None) -> tuple[DataFrame, int]:
    """What ``run`` makes of ``rows``, written by the workers themselves to the shared folder, and its number of rows.

    A task writes one Parquet file, or none if it has no row; a task that runs again writes a file of another name, and
    only files that a finished task has named stay.
    """
    spark, path = rows.sparkSession, path or new_folder(rows.sparkSession, name)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        file, out, opened, n, held, size = f"{uuid.uuid4().hex}.parquet", None, None, 0, [], 0

        def flush() -> None:
            nonlocal out, opened, held, size
            if out is None:
                opened = writer(f"{path}/{file}")
                out = pq.ParquetWriter(opened.__enter__(), held[0].schema, compression="zstd", compression_level=1)
            out.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        for batch in run(batches):
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
                if size >= GROUP_BYTES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            opened.__exit__(None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([file] * bool(n), pa.string()), pa.array([n] * bool(n), pa.int64())], ["file", "n"])

    with without_shuffles(spark):
        made = {r.file: r.n for r in mapped(rows, write, "file string, n long").collect()}
    at, inside = filesystem(path)
    for found in at.get_file_info(fs.FileSelector(inside)):
        if found.base_name not in made:
            at.delete_file(found.path)
    reread = spark.read.schema(schema).parquet(path) if made else spark.createDataFrame([], schema)
    return reread, sum(made.values())


def shuffle_parts(spark: SparkSession, rows: int, per_part: int, most: int = 20_000) -> int:
    """Partitions for ``rows``: at least the session's, one for each ``per_part`` rows, but a number a driver can plan."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, -(-rows // per_part)))


def whole_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def mapped(rows: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with batches of a bounded size and workers that keep little."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(lean(run), schema)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where they stand higher: default ones are 10,000 rows or 64 MB, several times in each worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that gives memory back: workers live on and serve later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


SALTS = 1023


def salted(keys: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, several, salt) of a batch's keys: sorted, whether a key stands several times, and a salt for its later places.

    A key's first place in each batch goes unsalted, so an unsalted key brings at most one row a batch to a window that
    counts it, however frequent it is; a later place needs no count, for it knows of the first.
    """
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    again = np.concatenate(([False], k[1:] == k[:-1])) if len(k) else np.zeros(0, bool)
    several = again | np.concatenate((again[1:], [False])) if len(k) else again
    return order, several, np.where(again, (spread[order] % np.uint64(SALTS)).astype(np.int64) + 1, 0)


_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, kept in this process until another key is asked for: a worker holds one model or encoder at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
        give_back()
    return _resident[key]


class Bounded(dict):
    """A memo of strings' results that empties itself beyond so many bytes."""

    def __init__(self, most: int = 48 * 1024 * 1024) -> None:
        super().__init__()
        self.most, self.size = most, 0

    def put(self, key: str, value: Any, size: int) -> None:
        self.size += len(key) + size + 200
        if self.size > self.most:
            self.clear()
            self.size = len(key) + size + 200
        self[key] = value


class Recent(dict):
    """A memo of strings' results in two halves of so many bytes together: when one is full the other is forgotten, and what is asked for again moves on."""

    def __init__(self, most: int = 48 * 1024 * 1024) -> None:
        super().__init__()
        self.half, self.size, self.before = most // 2, 0, {}

    def put(self, key: str, value: Any, size: int) -> None:
        size += len(key) + 200
        if self.size + size > self.half:
            self.before = dict(self)
            self.clear()
            self.size = 0
        self.size += size
        self[key] = value

    def __missing__(self, key: str) -> Any:
        value = self.before[key]
        self.put(key, value, 0)
        return value


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), u.path
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def writer(path: str):
    """A new file, created with its folder; any scheme that pyarrow opens."""
    at, p = filesystem(path)
    at.create_dir(p.rpartition("/")[0], recursive=True)
    with at.open_output_stream(p) as f:
        yield f


def reader(path: str):
    """A random-access file."""
    at, p = filesystem(path)
    return at.open_input_file(p)
