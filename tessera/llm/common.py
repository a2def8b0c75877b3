"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes handled at once in a Python worker, so that lists of tokens stay small next to long texts;
#: one longer text is a slice of its own.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 4 << 20
#: Rows of an Arrow batch between the JVM and Python, unless the session sets its own.
ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows: texts can be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where all of Spark is one local process, as in tests, is a folder of this machine set in its place;
    a cluster without the setting raises, since its executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no plan reads any more: what was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = ROWS_AT_ONCE, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and about so many bytes of strings."""
    size = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(total, before + most, "right"))), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def trim() -> None:
    """Give freed memory back to the system: workers wait for their next task, of any stage, for a while."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], rows: int = ROWS_AT_ONCE, most: int = BYTES_AT_ONCE) -> DataFrame:
    """mapInArrow in slices of some rows; make() builds a worker's function once a task.

    The function takes a slice and returns its output columns by name, in the order of the schema.
    """
    tune(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, rows, most):
                out = f(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == t.type else pa.array(x, t.type, from_pandas=False) for x, t in ((out[t.name], t) for t in arrow)], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)
