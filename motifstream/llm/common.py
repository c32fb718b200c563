"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="motifstream-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames from ``materialize`` that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def salted_join(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``left`` with ``right`` on null-safe equal ``keys`` (left name -> right name), right's key columns dropped.

    Rows of ``left`` are dealt over ``salts`` copies of ``right``, so a key of a third of all rows is spread whatever
    join Spark chooses; ``right`` has to be the small side.
    """
    own, other = free_name("_salt", left.columns + right.columns), free_name("_salt_of", left.columns + right.columns)
    a = left.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = a[own] == b[other]
    for x, y in keys.items():
        on = on & a[x].eqNullSafe(b[y])
    return a.join(b, on, how).drop(own, other, *keys.values())


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20  # that go to Python at a time, where the session allows more: texts are large


def lean(run, rows: int = BATCH_ROWS):
    """``run``, a function for ``mapInArrow``, on at most ``rows`` rows at a time.

    The session's limits of an Arrow batch are lowered to ``BATCH_ROWS`` and ``BATCH_BYTES`` for that, which bounds the
    buffers on both sides. At the end its worker gives free memory back, as Spark keeps it for other tasks.
    """
    if spark := SparkSession.getActiveSession():
        rows_of, bytes_of = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
        if not 0 < int(spark.conf.get(rows_of)) <= BATCH_ROWS:
            spark.conf.set(rows_of, BATCH_ROWS)
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bytes_of)) > BATCH_BYTES:
            spark.conf.set(bytes_of, BATCH_BYTES)

    def task(batches):
        try:
            yield from run(b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


def free_name(name: str, taken) -> str:
    """``name``, longer if a column has it already; Spark's names ignore case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
