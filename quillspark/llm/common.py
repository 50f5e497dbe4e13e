"""Shared plumbing: table access, materialised steps in the shared folder, worker-side caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from functools import reduce
from operator import add

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers need no copy of this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["quillspark.llm"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all runs on this machine, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors.

    `keep` writes a DataFrame as Parquet and rereads it. `drop` deletes those that no later step reads, and lets go of the shuffle
    files of the steps that are done.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        jvm.System.gc()  # shuffle files go once the driver has collected what refers to them


#: Bytes, as estimated from a count and the columns' sizes, up to which a kept table is broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """`df`, which must be a kept table, with a broadcast hint if its measured size allows it."""
    limit = BROADCAST_BYTES if limit is None else limit
    rows = df.count()
    if rows * (16 + 8 * len(df.columns)) > limit:
        return df
    wide = [F.length(f.name) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))] + [16 * F.size(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    more = df.agg(F.sum(reduce(add, (F.coalesce(c, F.lit(0)).cast("long") for c in wide)))).first()[0] if wide and rows else 0
    return F.broadcast(df) if rows * (16 + 8 * len(df.columns)) + (more or 0) <= limit else df


def carry(df: DataFrame, without: list[str] = ()) -> tuple[Column, list[Column], list[T.StructField]]:
    """The caller's columns as one struct `row`, so that no helper column can share a name with them; what takes them out of it
    again; and their fields."""
    fields = [f for f in df.schema if f.name not in without]
    quoted = ["`" + f.name.replace("`", "``") + "`" for f in fields]
    packed = F.struct(*(F.col(q) for q in quoted)) if fields else F.struct(F.lit(True).alias("none"))
    return packed.alias("row"), [F.col(f"row.{q}") for q in quoted], fields


def row_type(fields: list[T.StructField]) -> T.StructType:
    """The type of `carry`'s struct."""
    return T.StructType(list(fields) or [T.StructField("none", T.BooleanType())])


def worker_cache(name: str) -> dict:
    """A dict that outlives a task within one Python worker. What is put there must be bounded by its user."""
    holder = sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker"))
    return holder.__dict__.setdefault(name, {})


def tidy(run):
    """`run` for mapInArrow, giving what it has freed back to the system at a task's end: workers live on between steps."""

    def tidied(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return tidied
