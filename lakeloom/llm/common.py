"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources import tables

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the path may be remote)."""
    importable(spark)
    if spark.conf.get(tables.BYTES) == tables.LEAST:
        spark.conf.unset(tables.BYTES)  # here rows bound a batch
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")  # texts are long: what a worker holds at once
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package from where the driver has it.

    Workers elsewhere get it with --py-files or an installed package, as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


_tenant: dict[str, Callable[[], object]] = {}


def tenant(name: str, forget: Callable[[], object] = lambda: None) -> None:
    """In a worker: what another operator keeps from task to task goes, as workers outlast operators."""
    if name not in _tenant:
        for f in _tenant.values():
            f()
        _tenant.clear()
        _tenant[name] = forget
        gc.collect()
        returned()


def returned() -> None:
    """In a worker: memory that nothing holds goes back to the system, where it would wait to be used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on
    this machine alone, as in tests, a temporary folder takes its place, one for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if (own := _local.get(spark.sparkContext.applicationId)) is None:
        own = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_local: dict[str, str] = {}


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, below one folder of this application."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(forget_files, spark)
    return f"{shared_dir(spark).rstrip('/')}/lakeloom/{app}/{uuid.uuid4().hex}-{what}"


_cleaned: set[str] = set()


def forget_files(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder, once its results are taken.
    A session that has ended already keeps them."""
    try:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lakeloom/{sc.applicationId}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the machine behind the session is gone
        return


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage, makes what follows independent of lost executors and lets later steps read
    single columns. The files stay until ``forget_files`` or the end of the driver's Python.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: str = "doc_id"):
    """True for rows that models may learn from: they have an id and are not held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def single_threaded() -> None:
    """Keeps native libraries in a worker on the one core that the task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
