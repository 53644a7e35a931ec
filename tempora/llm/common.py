"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class ``[\x20\x09-\x0D]`` of the contracts.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Folders made where the session names none, by application.
_own_dirs: dict[str, str] = {}
#: The folder within the application's for tables that are written now.
_scratch: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local session without one gets its own; on a
    cluster that is an error, since no local folder is seen by all."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:  # a static setting: it cannot be set on a running session
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tempora-")
        where = _own_dirs[app]
    return where.rstrip("/")


def app_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/tempora-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or f"{app_folder(spark)}/{_scratch.get()}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that are written within are deleted at the end; what is made of them must be written by then,
    to a ``path`` of its own."""
    folder = f"scratch-{uuid.uuid4().hex}/"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, f"{app_folder(spark)}/{folder}")


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when their results have been consumed."""
    delete(spark, app_folder(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo ``n``; the fold rule of the contracts. Null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: of several that whose text has the least hash, null last. Not for null ids."""
    others = F.struct(*[c for c in rows.columns if c != "doc_id"])
    least = F.min_by(others, F.struct(F.col("text").isNull(), F.xxhash64("text"), F.col("text")))
    return rows.groupBy("doc_id").agg(least.alias("_row")).select("doc_id", "_row.*").select(*rows.columns)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def tidy(run):
    """``run``, a generator over batches, that gives the memory it has used back to the system when it ends: Spark keeps
    its Python workers, and the stages of a pipeline would add up in them."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
            if trim:
                trim(0)

    return wrapped


def in_chunks(sizes, most: int):
    """(start, end) ranges over consecutive items whose sizes sum to about ``most``; at least one item each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def apart(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, so that a join above it shuffles anew and Spark may split the join's hot keys."""
    return df.hint("rebalance")
