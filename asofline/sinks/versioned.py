"""A table in a shared folder whose writes become visible at once or not at all.

Rows are dealt over buckets by their key.  A write reads the buckets that its batch touches, merges them, and stages the
merged ones as Parquet in a new folder; then it commits a manifest, a small file that names the folder of each bucket,
by a rename that fails where the version exists.  A writer that lost the race merges again on the new version.  What a
failed attempt staged is named by no manifest and is removed by vacuum().  A batch that is known by its write id is not
applied again, so a retried job or a replayed micro-batch changes nothing.

Readers take one version, whatever is written meanwhile.  The driver holds one manifest, a row for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, TRIES = 32, 5
#: Write ids that a manifest remembers; older ones are forgotten first.
REMEMBERED = 1000

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer committed this version."""


class VersionedTable:
    """Rows of a schema, dealt by the hash of their keys; `merge` says what a batch does to the rows that are there."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], merge: Merge, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.merge, self.buckets = spark, path.rstrip("/"), schema, keys, merge, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # files

    def _at(self, path: str):
        p = self._fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _text(self, path: str) -> str:
        return "".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        """Of the named or the last version: its number, the folder of each bucket that has rows, and the write ids."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": {}, "writes": []}
        return json.loads(self._text(f"{self.path}/versions/{known[-1] if version is None else version:012d}.json"))

    def _commit(self, manifest: dict) -> None:
        final, fs = self._at(f"{self.path}/versions/{manifest['version']:012d}.json")
        staged = self._fs.Path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        mode = getattr(self._fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE  # never over a file that is there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(staged, final, modes)
        except Exception as e:
            fs.delete(staged, False)
            if fs.exists(final):
                raise Conflict(manifest["version"]) from e
            raise

    # rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: set[str], buckets: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = sorted(f"{self.path}/data/{folder}/_bucket={b}" for folder, b in folders)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._rows({(folder, b) for b, folder in m["buckets"].items()}, list(m["buckets"]))

    def write(self, batch: DataFrame, write_id: str | None = None, tries: int = TRIES) -> int:
        """The version in which the batch is applied: merged into its keys' buckets, on whatever version is the last when it is committed."""
        write_id = write_id or uuid.uuid4().hex
        incoming = batch.select(*self.schema.names, *[c for c in batch.columns if c not in self.schema.names])
        touched = sorted(str(r[0]) for r in incoming.select(self._bucket().alias("b")).distinct().collect())  # the number of buckets at most
        for _ in range(tries):
            base = self.manifest()
            if write_id in base["writes"]:
                return base["version"]
            before = self._rows({(base["buckets"][b], b) for b in touched if b in base["buckets"]}, touched)
            folder = uuid.uuid4().hex
            merged = self.merge(before, incoming).select(*self.schema.names).withColumn("_bucket", self._bucket())
            merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            written = {n.removeprefix("_bucket=") for n in self._names(f"{self.path}/data/{folder}") if n.startswith("_bucket=")}
            buckets = {b: f for b, f in base["buckets"].items() if b not in touched} | dict.fromkeys(written, folder)
            try:
                self._commit({"version": base["version"] + 1, "buckets": buckets, "writes": [*base["writes"], write_id][-REMEMBERED:]})
            except Conflict:
                continue
            return base["version"] + 1
        raise Conflict(f"{tries} attempts lost their version to other writers")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drop all but the last versions, and the folders that none of these names; no writer may be at work."""
        known = self.versions()
        for v in known[:-keep]:
            p, fs = self._at(f"{self.path}/versions/{v:012d}.json")
            fs.delete(p, False)
        used = {f for v in known[-keep:] for f in self.manifest(v)["buckets"].values()}
        gone = [n for n in self._names(f"{self.path}/data") if n not in used]
        for n in gone:
            p, fs = self._at(f"{self.path}/data/{n}")
            fs.delete(p, True)
        return gone

    def stream_into(self, stream: DataFrame, checkpoint: str, name: str):
        """A streaming query that writes each micro-batch once: its id is the write id, so a restart repeats nothing."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.write(batch, f"{name}-{n}") and None).option("checkpointLocation", checkpoint).queryName(name).start()
