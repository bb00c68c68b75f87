"""What the operators of this subpackage share: the shared folder, written tables, shipping code."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: `[^\x20\x09-\x0D]+` is a word everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED = "_lattica_shipped"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one made here where that is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    own = getattr(spark.sparkContext, "_lattica_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext._lattica_dir = own
        spark.sparkContext.setCheckpointDir(f"file://{own}/rdd")
    return f"file://{own}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python need not have it installed, and set the session's batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="lattica-ship-")) / "lattica.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    atexit.register(shutil.rmtree, str(out.parent), True)
    setattr(sc, _SHIPPED, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive any executor.

    keep() writes a table and reads it back; drop() removes those that later steps no longer need.
    What is left goes when the driver ends, as a result may still be read lazily from it, or at the end of released().
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._quiet)
        Scratch.made.append(self)

    def path(self, step: str) -> str:
        return f"{self.base}/{step}"

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step))

    def drop(self, step: str | None = None) -> None:
        fs, p = _fs(self.spark, self.path(step) if step else self.base)
        fs.delete(p, True)

    def _quiet(self) -> None:
        """As the driver ends: through Hadoop's file systems while there is a JVM, else what is local."""
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
                return
        except Exception:  # the context has gone  # noqa: BLE001, S110
            pass
        local = self.base.removeprefix("file:")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


@contextmanager
def released() -> Iterator[None]:
    """Drops the tables that operators called within wrote, at its end: what those returned must have been written by then.

    After an error the tables stay until the driver ends. Not for operators that run at once in several threads.
    """
    before = len(Scratch.made)
    yield
    for s in Scratch.made[before:]:
        s.drop()
    del Scratch.made[before:]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(col: str):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.encode(F.col(col), "UTF-8"), F.lit(b""))


def crc32_of_id(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary"))


#: Rows of a batch sent to Python: texts may be long, and both sides hold a batch.
BATCH_ROWS = "2000"


def env_threads() -> None:
    """At a Python task's start: one BLAS thread, as Spark already runs a task on each core, and freed memory given back.

    Workers serve many tasks, so what one kept of its arrays would add to what the next needs: arrays of
    1 MB and more get pages of their own, and what the last task left is returned.
    """
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own ways
        pass
