"""What the operators of this subpackage share: the shared folder, written tables, code shipping, worker memory."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from veritide.sources.tables import read_table

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may do without that setting; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veritide-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders below the shared one that this driver made, in order, until they are dropped.
_MADE: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/veritide/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veritide_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """(the store of ``path``, its path object there)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def store_of(path: str):
    """(the store of ``path``, its path there) for workers, which have no JVM at hand."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:", "", path))


def exists(spark: SparkSession, path: str) -> bool:
    store, at = file_system(spark, path)
    return store.exists(at)


def drop(*tables: DataFrame | None) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_veritide_path", None)
        if path in _MADE:
            sweep(t.sparkSession, [path])


def made() -> list[str]:
    """The folders made so far, for a later ``sweep``."""
    return list(_MADE)


def sweep(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these folders of ``made`` (all by default); tables that read them must be done with."""
    for path in made() if paths is None else paths:
        if path in _MADE:
            store, at = file_system(spark, path)
            store.delete(at, True)
            _MADE.remove(path)


def integer_ids(df: DataFrame, *columns: str) -> None:
    """Raise TypeError unless these columns hold integers, by which the operators order and compare rows."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, IntegralType):
            raise TypeError(f"{c} must be an integer column, not {df.schema[c].dataType.simpleString()}")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while any(name.lower() == c.lower() for c in df.columns):
        name = "_" + name
    return name


def lean(run, encodes: bool = False):
    """``run`` for mapInArrow: its worker, which later tasks reuse, gives freed memory back when a task ends.

    The tokenizers' memos live from task to task only while tasks encode; any other task drops them.
    """

    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            tokens = sys.modules.get("veritide.llm.tokens")
            if tokens and not encodes:
                tokens.forget()
            give_back()

    return held


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes, "CDLL"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


#: Rows and bytes of one Arrow batch between Spark and a worker; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and make this package importable on the executors unless their path already has it."""
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))
    on_path = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if any(p and os.path.realpath(p) == os.path.realpath(_ROOT) for p in on_path):
        return
    sc = spark.sparkContext
    if getattr(sc, "_veritide_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="veritide-code-"), "veritide_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(os.path.join(_ROOT, "veritide")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(target)
    sc._veritide_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, sf_dir, table)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model may learn from: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hashes of ``key``; the same rows on every run.

    Of large tables only about twice the bound passes a first cut by hash, so that what all tasks send
    to the driver does not grow with their number.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    n = df.count()
    if n > 2 * bound + 1000:
        df = df.where(h < int(-(2.0**63) + 2.0**64 * (2 * bound + 500) / n))
    return df.orderBy(h, F.col(key)).limit(bound)
