"""What the corpus operators share: a shared folder, row batches, and per-process caches."""

from __future__ import annotations

import contextlib
import gc
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only on one machine, where the session names no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Rows that the JVM puts into one Arrow batch; Python joins small batches again.
ROWS_A_BATCH = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset and Spark
    runs on one machine; on a cluster it has to be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        named = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Where each table of ``written`` lies, by the identity of its frame.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs no rerun."""
    path = f"{shared_folder(df.sparkSession)}/veilframe-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def spent(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that came from them is itself written."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ROWS_A_BATCH`` rows in this session: the JVM and a worker hold two or three at a time,
    and texts may be long.  A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


def pieces_of(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Join and cut record batches so that each piece holds about ``most_bytes``, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and size + batch.nbytes > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        if rows < batch.num_rows:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
        else:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


#: What a Python worker did last; workers go on from stage to stage.
_DOING: list[str] = [""]


def now_doing(what: str) -> None:
    """Called by each task with its operator's name: what other operators left in the worker is given back first."""
    if _DOING[0] != what:
        import ctypes

        _DOING[0] = what
        _COMPILED.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps its free memory


@contextlib.contextmanager
def without_collection():
    """Cyclic garbage waits until a batch is done: the compiled tables are millions of objects without cycles, and each
    collection would walk through them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` over pieces of bounded size; ``each`` may return None for no rows."""

    def run(batches):
        now_doing(each.__module__)
        for piece in pieces_of(batches, most_bytes):
            out = each(piece)
            if out is not None and out.num_rows:
                yield out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only id and text (null: empty) and ``more``, so that other columns, whatever their names, can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


#: Compiled tables by the digest of what they were compiled from; a Python worker keeps them between tasks.
_COMPILED: dict[object, object] = {}


def compiled(key: object, make: Callable[[], object]) -> object:
    if key not in _COMPILED:
        while len(_COMPILED) >= 2:  # a worker that serves many jobs keeps the latest
            _COMPILED.pop(next(iter(_COMPILED)))
        _COMPILED[key] = make()
    return _COMPILED[key]


class Shipped:
    """A file's bytes, read on the driver and broadcast once; a vocabulary has a fixed size of a few MB."""

    LARGEST = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        import hashlib

        with open(path, "rb") as f:
            data = f.read(self.LARGEST + 1)
        if len(data) > self.LARGEST:
            raise ValueError(f"{path} is larger than {self.LARGEST} bytes and isn't broadcast")
        self.key = hashlib.sha256(data).hexdigest()
        self._value = spark.sparkContext.broadcast(data)

    def bytes(self) -> bytes:
        return self._value.value


def runs_of(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first ``keys`` integer columns, as one table each."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(c[low]) for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held)
