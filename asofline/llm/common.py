"""What the corpus operators share: a shared scratch folder, table input and word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..storage import shared_folder

#: ASCII white space, which separates words in every operator here.
BLANK = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
BLANKS = "[ \\t\\n\\u000b\\f\\r]+"

#: Bytes of a batch of rows that a task hands to Python, about.
BATCH_BYTES = 8 << 20

_made: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; the executors get the package that the operators' tasks import."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends or by clear()."""
    path = f"{shared_folder(spark).rstrip('/')}/asofline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@atexit.register
def clear() -> None:
    """Remove what scratch() has made."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may have ended; the folder is the cluster's to clean then
            return


def let_go() -> None:
    """Give memory that a finished task held back to the system; a Python worker goes on to other tasks beside the executor's own memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        return


_caches: dict[str, Callable[[], None]] = {}
_owner = ""


def cached_by(name: str, clear: Callable[[], None]) -> None:
    """In a task: the caches of one operator are in use now, and clear empties them; those of the others are let go."""
    global _owner
    if name not in _caches:
        _caches[name] = clear
    if _owner != name:
        for other, empty in _caches.items():
            if other != name:
                empty()
        _owner = name
        let_go()


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), for which the executors get the package; batches are of BATCH_BYTES where the session has Spark's own, larger default."""
    spark = df.sparkSession
    ship(spark)
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(BATCH_BYTES))

    def then_let_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        let_go()

    return df.mapInArrow(then_let_go, schema)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """saved(df), and its number of rows, which the same job counts."""
    seen = Observation(name)
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get.get("n", 0)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark removes the shuffle files of finished jobs, everywhere, when the driver no longer refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all but the needed columns under names that nothing else uses, and a function that gives a result (and more columns of it) the old names."""
    new = {c: c if c in needed else f"_extra{k}" for k, c in enumerate(docs.columns)}
    back = lambda df, *more: df.select(*[F.col(n).alias(c) for c, n in new.items() if c not in more], *more)
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), back


def is_held_out(doc_id: int | None) -> bool:
    """The fold that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
