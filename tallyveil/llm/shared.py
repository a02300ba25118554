"""Scratch tables in the folder that driver and executors share, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of the contracts' class [\x20\x09-\x0D]: a fixed value.
SPACES = " \t\n\x0b\x0c\r"
#: Bounds of an Arrow batch while a table is written: a batch is held several times, by executor and Python worker, and
#: rows may be whole texts or sets.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallyveil-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyveil/{uuid.uuid4().hex}/{name}"


#: Folders of the tables written by this process that have not been forgotten, in order.
_written: list[str] = []


@contextmanager
def _configured(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which the worker, which waits for further tasks, holds no freed Arrow memory."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return then_release


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with _configured(spark, ARROW):
        df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for forget_since."""
    return len(_written)


def forget_since(spark: SparkSession, point: int, keep: int = 0) -> None:
    """Deletes the tables written since, but for the last `keep`. Nothing may read them any more: a frame is computed when it
    is asked for, so only what has been written, or collected, since is safe."""
    done = _written[point : len(_written) - keep]
    del _written[point : len(_written) - keep]
    for path in done:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A step of a loop as a written table. checkpoint() would keep the size estimate of the plan it cuts: each self-join
    multiplies it, until the estimate itself is a number of hundreds of MB on the driver."""
    return stored(df, "step")


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does it where the string is pure ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, upper, lower))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def private_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name
