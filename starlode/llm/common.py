"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is
    unset and everything runs in one JVM, a temporary folder."""
    jsc = spark.sparkContext._jsc.sc()
    if (path := spark.sparkContext.getConf().get("spark.checkpoint.dir")) is None:
        if (known := jsc.getCheckpointDir()).isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="starlode-checkpoint-")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that nothing above runs again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over: it does once the driver's JVM has collected
    what refers to them, which by itself may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(column: str, by: int):
    """crc32 of a column's decimal text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "64m", "2m")


def batched(df: DataFrame) -> DataFrame:
    """``df``, whose session is told to hand rows to Python in batches of about 2 MB: 10,000 long texts at
    once, Spark's default, are held several times by executor and worker. Other settings than the
    default are left as they are."""
    name, default, wanted = BATCH
    conf = df.sparkSession.conf
    if conf.get(name, default) in (default, "67108864b", "67108864"):
        conf.set(name, wanted)
    return df


def trim() -> None:
    """Gives freed memory back to the system: Python's garbage, Arrow's pool and the C library's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


_held: dict[Hashable, object] = {}


def held(name: Hashable, make: Callable[[], object]):
    """The one model that a Python worker keeps from task to task; another one takes its place, so a
    worker that serves many stages holds what one of them needs."""
    if name not in _held:
        _held.clear()
        trim()
        _held[name] = make()
    return _held[name]


class Shared:
    """A model as bytes, which every worker reads once however many tasks it runs."""

    def __init__(self, model: object):
        self.data = pickle.dumps(model, protocol=pickle.HIGHEST_PROTOCOL)
        self.name = hashlib.sha256(self.data).hexdigest()

    def get(self):
        return held(self.name, lambda: pickle.loads(self.data))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches a few at a time, so that few texts are Python objects at once; what
    is freed goes back to the system at the end of the task."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        trim()
