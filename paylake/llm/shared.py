"""The folder that the driver and all executors share, and tables and files in it.

The folder is the one named by ``spark.checkpoint.dir``; where that is unset (tests), a local
one is set. Work is written below one subfolder per session, removed when the JVM ends. What an operator
needs for itself alone is written within ``scratch`` and removed when it returns; what its result is
read from stays (``keep``), in a ``stage`` until a later stage that does not read it begins.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Memory of batches comes from malloc, so that ``release`` can give it back; Arrow's own pools keep most of it.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of a batch that is handed to Python: rows may hold very long texts.
BATCH_BYTES = 8 << 20
_ROOTS: dict[str, str] = {}
_OPEN: list[list[str]] = []  # what the open scopes have written, outermost first
_LEFT: dict[str, list[list[str]]] = {}  # what each stage has left, by application


def shared_root(spark: SparkSession) -> str:
    """This session's work folder in the shared folder, as a URI."""
    sc = spark.sparkContext
    bounded(spark)
    if sc.applicationId not in _ROOTS:
        base = sc.getConf().get("spark.checkpoint.dir", "")
        if not base:
            base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
            sc.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/work-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        jvm = sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[sc.applicationId] = root
    return _ROOTS[sc.applicationId]


def bounded(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on batches handed to Python have ``most`` bytes at most, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := int(spark.conf.get(key).rstrip("b"))) > most or now == BATCH_BYTES:
        spark.conf.set(key, f"{most}b")


def _new_path(spark: SparkSession, name: str, keep: bool) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    return path


def _remove(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at the end, but for what is kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for uri in _OPEN.pop():
            _remove(spark, uri)


@contextmanager
def stage(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """A stage over ``docs``. What each earlier stage has left goes now, unless ``docs`` is read from some of it; so
    the result of a stage before the last one has to be written by now."""
    left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
    if left:
        files = docs.inputFiles()
        for group in [g for g in left if not any(u.rpartition("/")[2] in f for u in g for f in files)]:
            for uri in group:
                _remove(spark, uri)
            left.remove(group)
    _OPEN.append([])
    try:
        yield
    finally:
        if own := _OPEN.pop():
            left.append(own)


def hand_over(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A stage's result, written and read again; it goes when a stage begins that does not read it."""
    _OPEN.append([])
    try:
        return save(spark, df, name)
    finally:
        _LEFT.setdefault(spark.sparkContext.applicationId, []).append(_OPEN.pop())


def shared_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new empty folder in the shared folder, as a URI."""
    out = _new_path(spark, name, keep)
    fs, path = open_fs(out)
    fs.create_dir(path, recursive=True)
    return out


def save(spark: SparkSession, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    path = _new_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; a plain path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of its own, then renames it: a retried or doubled task
    leaves one complete file."""
    fs, path = open_fs(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


def read_file(uri: str):
    """The file's bytes; a local file is memory-mapped, so it costs no memory of its own."""
    fs, path = open_fs(uri)
    if fs.type_name == "local":
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with fs.open_input_stream(path) as f:
        return f.read()


def release() -> None:
    """Gives memory that is free back to the system; a worker lives on between tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


class FileCache:
    """Keeps the most recently used files open, ``most`` at a time."""

    def __init__(self, load, most: int = 16):
        self.load, self.most, self.files = load, most, OrderedDict()

    def get(self, uri: str):
        if uri in self.files:
            self.files.move_to_end(uri)
        else:
            self.files[uri] = self.load(uri)
            if len(self.files) > self.most:
                self.files.popitem(last=False)
        return self.files[uri]


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds output columns; an input column of the same name is replaced."""
    return df.withColumns(cols)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns whose names (in any case) clash with output columns."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def new_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name = "_" + name
    return name


#: A key that holds this share of all rows is hot; there are 1 / HOT of them at most.
HOT = 0.001


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join on ``keys`` where ``count`` in ``small`` (one row a key, keys not null) is the number of
    rows that ``big`` has of the key. Keys with more than ``HOT`` of all rows, 1 / HOT at most, are sent
    to the rows; the others are too small to make a task large."""
    least = F.lit(HOT) * F.lit(small.agg(F.sum(count)).first()[0] or 0)
    hot, rest = small.where(F.col(count) > least).drop(count), small.where(F.col(count) <= least).drop(count)
    others = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(others.join(rest, keys))
