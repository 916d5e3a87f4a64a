"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:  # each Python worker imports this module, and pandas takes a good part of its memory
    import pandas as pd

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexloom-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int | None):
    """Arrow batches of that many rows at most for what runs within; None for the session's own."""
    before = spark.conf.get(_BATCH)
    try:
        if rows:
            spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
        yield
    finally:
        if rows:
            spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str, batch_rows: int | None = None, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and lost executors cannot take it with them.
    batch_rows: rows of an Arrow batch while it is written, where rows are large; the session's own after that.
    compression: a Parquet codec, where the session's takes too much disk."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark, batch_rows):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables of written() that nothing reads any more, and lets Spark drop the shuffle files of
    finished steps, which stay until the driver has collected their garbage."""
    import gc

    spark = SparkSession.active()
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # what held the files, then the files
        gc.collect()
        spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint where df, whose rows have a fixed width, is counted and small; else df, for a shuffled join.
    Call it on written tables only: the count reads them."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def texts(batch: pa.RecordBatch, name: str = "text"):
    """The UTF-8 bytes of each row; None for null."""
    col = batch.column(batch.schema.get_field_index(name))
    for x in col.cast(pa.binary()):
        yield x.as_py()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows: what a step works out at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def longs(values) -> pa.Array:
    """uint64 or int64 numbers as Arrow int64, bits kept."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def fraction(rows: int, wanted: int) -> float:
    """The share of rows to take to get about `wanted`."""
    return 1.0 if rows <= wanted else wanted / rows


def hash_unit(*cols) -> F.Column:
    """A number in [0, 1) that depends on the columns only."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / F.lit(float(1 << 52))


def _give_back() -> None:
    """Hands freed memory back, as a worker outlives its task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def handing_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A step of mapInArrow that hands back its memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            _give_back()

    return run


def fit_on_executor(rows: DataFrame, fit: Callable[[pd.DataFrame], object]):
    """fit of all rows as one pandas frame, run in a task, so that the driver holds the result alone. Only for rows
    whose number and size the caller has bounded."""
    import pickle

    import pandas as pd

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        frames = [b.to_pandas() for b in batches]
        got = fit(pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=names))
        frames.clear()
        _give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    # no rows, no task: what is learnt of nothing is learnt here
    return pickle.loads(made[0]["model"]) if made else fit(pd.DataFrame(columns=names))


def unused(wanted: str, taken) -> str:
    """A column name that is not among those taken."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def columns_of(docs: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in (docs.columns if names is None else names)]


def kept(docs: DataFrame, keep: list[str]) -> tuple[list[Column], list[str], str]:
    """Columns to hand through a Python step, by position, under names that clash with nothing; the names; their DDL."""
    names = [f"__{i}" for i in range(len(keep))]
    by_name = {f.name: f.dataType for f in docs.schema.fields}
    quoted = columns_of(docs, keep)
    ddl = ", ".join(f"`{n}` {by_name[c].simpleString()}" for n, c in zip(names, keep, strict=True))
    return [q.alias(n) for q, n in zip(quoted, names, strict=True)], names, ddl
