"""Idempotent writes as DataFrame transforms: applying one twice gives what applying it once gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import guid


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing and the incoming rows of new keys; of several with one key the first in order, rows with an empty key aren't taken."""
    ok = incoming
    for k in keys:
        ok = ok.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    first = ok.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return existing.unionByName(first.join(existing.select(*keys).distinct(), keys, "left_anti").select(existing.columns))


def latest_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep: list[str] = ()) -> DataFrame:
    """existing overwritten by the last incoming row of each key; columns in keep hold the value they had."""
    last = incoming.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))).where("_r = 1").drop("_r")
    both = existing.select(*keys, F.struct(*existing.columns).alias("_old")).join(last.select(*keys, F.struct(*existing.columns).alias("_new")), keys, "full_outer")
    value = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*[(F.col(c) if c in keys else value(c).alias(c)) for c in existing.columns])


def verdicts(existing: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Verdicts (article_id, symbol, ..., decision_source) overwritten by the last incoming one (by its arrival; the surest one where that isn't known), but for those of users."""
    keys = ["article_id", "symbol"]
    mine = existing.where("decision_source = 'USER'").select(*keys)
    return latest_wins(existing, incoming.join(mine, keys, "left_anti"), keys, [arrival] if arrival in incoming.columns else ["confidence", "decision"])


def backfill(cases: DataFrame, recomputed: DataFrame, version: str) -> DataFrame:
    """cases with the recomputed columns where their version is older or their values differ; changed tells which."""
    names = [c for c in recomputed.columns if c != "case_id"]
    both = cases.join(recomputed.select("case_id", F.struct(*names).alias("_new")), "case_id", "left")
    stale = F.col("_new").isNotNull() & ((F.coalesce("methodology", F.lit("")) != version) | ~F.struct(*names).eqNullSafe(F.col("_new")))
    return both.withColumn("changed", stale).select(*[F.when(F.col("changed"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else (F.when(F.col("changed"), version).otherwise(F.col(c)).alias(c) if c == "methodology" else F.col(c)) for c in cases.columns], "changed")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows, and an error as soon as two of them have one key."""
    n = F.count("*").over(W.partitionBy(key))
    return rows.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def vector_points(rows: DataFrame, prefix: str, dimensions: int) -> DataFrame:
    """point, ref, vector of rows (ref, vector): a fixed id for each ref, so that writing again overwrites; vectors of other dimensions are left out."""
    return rows.where(F.size("vector") == dimensions).select(guid(F.concat(F.lit(f"{prefix}|"), F.col("ref"))).alias("point"), "ref", "vector")


def applied(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing after changes (its columns, op: add, update or delete, and at): the last change of a key counts; an update of an unknown key and an add of a known one do nothing."""
    last = changes.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col("at").desc()))).where("_r = 1")
    cols = existing.columns
    both = existing.select(key, F.struct(*cols).alias("_old")).join(last.select(key, "op", F.struct(*cols).alias("_new")), key, "full_outer")
    known = F.col("_old").isNotNull()
    row = F.when(F.col("op").isNull(), F.col("_old")).when(F.col("op") == "delete", None).when((F.col("op") == "add") & ~known, F.col("_new")).when((F.col("op") == "update") & known, F.col("_new")).otherwise(F.col("_old"))
    return both.select(row.alias("_x")).where("_x is not null").select("_x.*")


def with_stages(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """jobs (id, status, created, updated) with their stages (id, at, stage) in order, as an array; a stage that came after a job had ended isn't appended."""
    own = stages.join(jobs.select("id", F.when(F.col("status") != "running", F.col("updated")).alias("_end")), "id").where("_end is null or at <= _end")
    lists = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "stage"))).alias("_s"))  # a job has a few stages
    return jobs.join(lists, "id", "left").withColumn("stages", F.coalesce(F.transform("_s", lambda s: s["stage"]), F.array().cast("array<string>"))).drop("_s")


def with_payload(jobs: DataFrame, payloads: DataFrame) -> DataFrame:
    """jobs with the last payload (id, at, payload) that came once they had ended; a running job keeps none."""
    last = payloads.groupBy("id").agg(F.max_by("payload", "at").alias("payload"))
    return jobs.join(last, "id", "left").withColumn("payload", F.when(F.col("status") != "running", F.col("payload")))


def recent(rows: DataFrame, most: int = 12) -> DataFrame:
    """The newest row of each symbol (whatever its case), date and source, the newest first; rows without a symbol or date don't count."""
    key = [F.upper("symbol"), F.col("date"), F.col("source")]
    ok = rows.where((F.coalesce("symbol", F.lit("")) != "") & F.col("date").isNotNull())
    once = ok.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.col("at").desc()))).where("_r = 1").drop("_r")
    return once.orderBy(F.col("at").desc()).limit(most)


def job_step(jobs: DataFrame, events: DataFrame, now, timeout_minutes: int = 60, retention_days: int = 7) -> DataFrame:
    """Jobs (id, status, created, updated) after events (id, kind, at): a terminal status stays, running ones time out, old finished ones go."""
    last = events.where(F.col("kind").isin("complete", "fail")).groupBy("id").agg(F.min_by("kind", "at").alias("_k"), F.min("at").alias("_at"))
    both = jobs.join(last, "id", "left")
    running = F.col("status") == "running"
    told = running & F.col("_k").isNotNull()
    late = running & F.col("_k").isNull() & (F.col("created") < now - F.expr(f"interval {timeout_minutes} minutes"))
    out = both.withColumns({"_s": F.when(told, F.when(F.col("_k") == "complete", "completed").otherwise("failed")).when(late, "timeout").otherwise(F.col("status")), "_u": F.when(told, F.col("_at")).when(late, now).otherwise(F.col("updated"))})
    out = out.select("id", F.col("_s").alias("status"), "created", F.col("_u").alias("updated"))
    return out.where((F.col("status") == "running") | (F.col("updated") >= now - F.expr(f"interval {retention_days} days")))
