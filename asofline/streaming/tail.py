"""The tail of jobs' stages: a log of batches, and a streaming source that resends what a reader has not seen yet.

The log is a folder of numbered batches.  A batch is staged and appears by one rename, which fails where its number exists, so a
writer that is started again repeats nothing.  A row is one entry of a job's log: seq numbers a job's entries from 0, and the
entry of a terminal kind is its last.

A reader names the jobs it follows and how many entries of each it has seen; its offset is a number of batches, so Spark's checkpoint
says what it was sent.  Only the files of batches between two offsets are opened, each by a task, which holds one of its row batches at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..ship import ship
from ..storage import new_path

SCHEMA = "id string, seq long, kind string, stage string, at timestamp"
TERMINAL = ("complete", "fail", "timeout")


def _renamed(spark: SparkSession, staged: str, final: str) -> bool:
    """Whether the rename was made; False where the target is there."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = fs.Path(staged), fs.Path(final)
    b.getFileSystem(conf).mkdirs(b.getParent())
    modes = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    modes[0] = getattr(fs, "Options$Rename").NONE
    try:
        fs.FileContext.getFileContext(b.toUri(), conf).rename(a, b, modes)
        return True
    except Exception:
        if b.getFileSystem(conf).exists(b):
            a.getFileSystem(conf).delete(a, True)
            return False
        raise


def append(entries: DataFrame, path: str, batch: int) -> bool:
    """Add entries (id, seq, kind, stage, at) as the batch of a number, from 0 without gaps; False where that number was written before."""
    staged = f"{path.rstrip('/')}/staged/{uuid.uuid4().hex}"
    entries.select("id", F.col("seq").cast("long").alias("seq"), "kind", "stage", "at").sortWithinPartitions("id", "seq").write.parquet(staged)
    return _renamed(entries.sparkSession, staged, f"{path.rstrip('/')}/batches/{batch:012d}")


class Part(InputPartition):
    """A file of a batch."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class TailReader(DataSourceStreamReader):
    """Batches of the log as a stream; entries of other jobs, and those that were seen, are dropped as they are read."""

    def __init__(self, path: str, jobs: list[str] | None, seen: dict[str, int]):
        uri = path.rstrip("/")
        self._uri, self._jobs, self._seen = uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"), jobs, seen

    def _fs(self, sub: str):
        return pa.fs.FileSystem.from_uri(f"{self._uri}/{sub}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batches": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, at = self._fs("batches")
        found = {int(i.base_name) for i in fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)) if i.base_name.isdigit()}
        return {"batches": next(n for n in range(len(found) + 1) if n not in found)}  # a gap is waited for

    def partitions(self, start: dict, end: dict) -> list[Part]:
        found = []
        for n in range(start["batches"], end["batches"]):
            fs, at = self._fs(f"batches/{n:012d}")
            found += sorted(i.path for i in fs.get_file_info(pa.fs.FileSelector(at)) if i.path.endswith(".parquet"))
        return [Part(f) for f in found]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        jobs = None if self._jobs is None else pc.field("id").isin(self._jobs)
        file = ds.dataset(partition.path, filesystem=self._fs("batches")[0], format="parquet")
        for rows in file.to_batches(columns=["id", "seq", "kind", "stage", "at"], filter=jobs):
            if self._seen:
                upto = pa.array([self._seen.get(k, 0) for k in rows["id"].to_pylist()], pa.int64())
                rows = rows.filter(pc.greater_equal(rows["seq"], upto))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], rows["at"].cast(pa.timestamp("us", tz="UTC"))], names=rows.schema.names)

    def commit(self, end: dict) -> None:
        """The log stays; other readers may be behind."""


class TailSource(DataSource):
    """Options: path; jobs (a JSON list; all of them without it); seen (JSON: entries of a job that its reader has)."""

    @classmethod
    def name(cls) -> str:
        return "job_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        jobs = self.options.get("jobs")
        return TailReader(self.options["path"], None if jobs is None else json.loads(jobs), json.loads(self.options.get("seen", "{}")))


def tail(spark: SparkSession, path: str, jobs: list[str] | None = None, seen: dict[str, int] | None = None) -> DataFrame:
    """The entries of the log as a stream (id, seq, kind, stage, at)."""
    ship(spark)
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("job_tail").option("path", path).option("seen", json.dumps(seen or {}))
    return (reader if jobs is None else reader.option("jobs", json.dumps(list(dict.fromkeys(jobs))))).load()


def ended(spark: SparkSession, path: str, jobs: list[str]) -> set[str]:
    """Which of the asked jobs have ended by the log as it is now; nothing where there is no log."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batches")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not len(fs.listStatus(p)):
        return set()
    rows = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/batches/*").where(F.col("id").isin(jobs) & F.col("kind").isin(*TERMINAL))
    return {r.id for r in rows.select("id").distinct().collect()}  # of the asked jobs


def follow(spark: SparkSession, path: str, jobs: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, seen: dict[str, int] | None = None, wait: float = 1.0, most: float = 3600.0) -> bool:
    """Send each micro-batch of the jobs' entries to a sink until all of them have ended; False if that took longer than `most` seconds.

    Whether the jobs have ended is looked up before the log is drained, so an end that was found has been sent.  A reader that is started
    again with its checkpoint goes on where it was; the sink is told the micro-batch's number, as one that was cut off may come again.
    """
    until = time.monotonic() + most
    while True:
        done = ended(spark, path, jobs) >= set(jobs)
        q = tail(spark, path, jobs, seen).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if done or time.monotonic() >= until:
            return done
        time.sleep(wait)


def resent(entries: DataFrame, batches: int, jobs: list[str] | None = None) -> DataFrame:
    """Entries (with a column batch below `batches`) written to a log and read back by its tail, as what a reader was sent."""
    spark = entries.sparkSession
    path, out = new_path(spark, "log"), new_path(spark, "sent")
    for n in range(batches):
        append(entries.where(F.col("batch") == n), path, n)
    q = tail(spark, path, jobs).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{out}/rows")
