"""What the operators of this package share: tables, scratch space and packed columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Maps every byte outside 0-9, A-Z, a-z and non-ASCII to a space, and A-Z to a-z.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir. Where that is unset and Spark is one machine, as in tests, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = f"file://{tempfile.mkdtemp(prefix='pathloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # best effort: the folder may be gone, or the session ended
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder. Writing one cuts its lineage, and it survives the loss of executors.

    drop() removes a table that nothing will read again; whatever is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, self.root)
        self.n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and (path := getattr(t, "_scratch_path", None)):
                _delete(self.spark, path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that are done: it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """run, a function for mapInArrow, and then the return of what it has freed to the system.

    A worker process outlives its task, and without this keeps the most that any task has needed.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


#: Ids up to which their table is broadcast, 8 MB of them; beyond, the texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose doc_id is in ids (how: left_semi) or is not (left_anti). ids is a stored table of one column."""
    few = ids.count() <= limit
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", how).select(*docs.columns)


#: Rows of one key that a task may get in a join before the key is dealt to several; and such keys, at most.
KEY_ROWS, HEAVY_KEYS = 1_000, 100_000


def heavy_limit(total: int) -> int:
    """Rows beyond which a key is heavy, of total rows: so there are never more than HEAVY_KEYS heavy ones."""
    return max(KEY_ROWS, total // HEAVY_KEYS)


def heavy_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """(on, parts): the keys that rows, a stored table, has too often, and the number of parts to deal each to; at most HEAVY_KEYS rows."""
    limit = heavy_limit(rows.count())
    return deal(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on, limit)


def deal(counts: DataFrame, on: list[str], limit: int, n: str = "n") -> DataFrame:
    """(on, parts): the keys of counts, which has a row for each, whose number is beyond limit."""
    return counts.where(F.col(n) > limit).select(*on, F.ceil(F.col(n) / limit).cast("int").alias("parts"))


def spread_join(many: DataFrame, one: DataFrame, on: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with one (inner, left or left_semi), where a key that heavy names is dealt to several tasks.

    Rows of many are dealt by a hash of their other columns, and one's rows of such a key go to each part: no more copies
    than many has rows to fill them. heavy has no null keys, and its size is bounded (see heavy_keys).
    """
    if heavy.isEmpty():
        return many.join(one, on, how)
    parts = F.broadcast(heavy.select(*on, "parts"))
    others = [c for c in many.columns if c not in on] or on
    many = many.join(parts, on, "left").withColumn("_part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*others), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    one = one.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return many.join(one, [*on, "_part"], how).drop("_part")


def wide_hash(*cols) -> tuple:
    """Two independent 64-bit hashes, for use as one 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(*cols, F.lit("\x01second"))


def extended(df: DataFrame, fresh: list[tuple]) -> StructType:
    """df's schema with a field for each (name, DDL type, ...) of fresh."""
    more = StructType.fromDDL(", ".join(f"{f[0]} {f[1]}" for f in fresh))
    return StructType([*df.schema.fields, *more.fields])
