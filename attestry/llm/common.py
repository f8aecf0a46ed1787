"""Small helpers shared by the training-data operators.

Every operator takes a DataFrame, names the columns it needs and selects them first, so extra columns
(of whatever name) in the input never clash with its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one step inside a task holds at a time (a single longer text is a step of its own).
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices with about ``limit`` bytes in ``column``."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def bounded_batches(spark: SparkSession) -> None:
    """Rows with texts go to Python in batches of a thousand and of STEP_BYTES at most."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", STEP_BYTES)):
        held = spark.conf.get(key)
        if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > most:
            spark.conf.set(key, str(most))


def map_steps(
    df: DataFrame,
    text: str,
    schema: str | T.StructType,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None],
    limit: int = STEP_BYTES,
) -> DataFrame:
    """``work`` on every slice of ``df`` with bounded text; it returns columns by name (or nothing)."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    shape = to_arrow_schema(kind)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches, text, limit):
            out = work(piece)
            if out is None:
                continue
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in ((out[f.name], f) for f in shape)],
                schema=shape,
            )

    return df.mapInArrow(run, kind)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode, where none is set, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="attestry-checkpoint-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder, for rows that hold texts."""
    path = path or f"{shared_folder(df.sparkSession)}/attestry-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table's files, wherever they are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sampled(df: DataFrame, most: int, *key: str) -> DataFrame:
    """``most`` rows at most, whatever repeats: by a hash of ``key``, then cut where many rows have one key."""
    n = df.count()
    share = 1.0 if n <= most else (most - 4 * most**0.5) / n  # the cut is for repeated keys
    chosen = df.filter(F.pmod(F.xxhash64(*key, F.lit(9)), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else df
    return chosen.limit(most) if share < 1 else chosen


def free_name(df: DataFrame, *taken: str) -> str:
    """A column name that neither ``df`` nor ``taken`` has, whatever the case."""
    held = {c.lower() for c in (*df.columns, *taken)}
    return next(name for k in range(len(held) + 1) if (name := f"attestry_{k}") not in held)


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a whole column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("n")).first()["n"])
