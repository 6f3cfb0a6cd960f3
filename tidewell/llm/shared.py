"""What several operators of this subpackage share: checkpoints, and memory that workers give back."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset one of our own is set, but only if driver and executors are one process."""
    context = spark.sparkContext
    folder = context._conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tidewell-checkpoints"))
    return folder or ""


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Shuffle files go when the driver collects its garbage, so it is asked to: what earlier steps left
    would else stay on the executors' disks.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return kept


def stored(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder, under ``name`` or one of its own, and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name or f'stored-{uuid.uuid4().hex}.parquet'}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def discard(spark: SparkSession, name: str) -> None:
    """Remove what ``stored`` wrote under a name, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


class Settling:
    """Gives freed memory back at most once in ``seconds``, and once more when nothing has come for so long."""

    def __init__(self, seconds: float = 1.0):
        self.seconds, self.last, self.timer, self.lock = seconds, 0.0, None, threading.Lock()

    def __call__(self) -> None:
        with self.lock:
            now = time.monotonic()
            if now - self.last >= self.seconds:
                self.last = now
                _trim()
            elif self.timer is None:
                self.timer = threading.Timer(self.seconds, self._later)
                self.timer.daemon = True
                self.timer.start()

    def _later(self) -> None:
        with self.lock:
            self.timer, self.last = None, time.monotonic()
            _trim()


_settling = Settling()


def settle() -> None:
    """Give freed memory back to the system: Python workers idle beside the next stage's, and an executor's memory is one sum."""
    _settling()


class Idle:
    """Keeps a worker's memos from one task to the next, and drops them once no task has come for a while.

    While a task runs, the cycle collector is off: memos are many small objects without cycles.
    """

    def __init__(self, release: Callable[[], object], seconds: float = 1.5):
        self.release, self.seconds = release, seconds
        self.lock, self.tasks, self.timer = threading.Lock(), 0, None

    @contextmanager
    def busy(self) -> Iterator[None]:
        with self.lock:
            self.tasks += 1
            if self.timer:
                self.timer.cancel()
        gc.disable()
        try:
            yield
        finally:
            gc.enable()
            with self.lock:
                self.tasks -= 1
                self.timer = threading.Timer(self.seconds, self._drop)
                self.timer.daemon = True
                self.timer.start()

    def _drop(self) -> None:
        with self.lock:
            if not self.tasks:
                self.release()
                settle()

    def __reduce__(self):
        raise TypeError("belongs to one process")
