"""The job queue as a table: normalisation, claims, dependencies, pruning, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.operators.shared import first_rows, small

TERMINAL = ("done", "completed", "failed", "error", "canceled")


def worker_matches(worker_resource: Column, capabilities: Column, resource: Column, required: Column) -> Column:
    """May a worker take a job? Resource `any` or equal, and all required capabilities at hand."""
    return (F.coalesce(resource, F.lit("any")).isin("", "any") | (resource == worker_resource)) & (F.size(F.array_except(required, capabilities)) == 0)


def normalize(jobs: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """Status at `now` of jobs (status, attempts, lease_until, next_attempt_at): an expired lease waits for a retry or has failed, a due retry is queued. Others stay."""
    expired = (F.col("status") == "claimed") & (F.col("lease_until") < now)
    spent = F.col("attempts") >= most_attempts
    due = (F.col("status") == "retry_wait") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    new = F.when(expired & spent, "failed").when(expired, "retry_wait").when(due, "queued").otherwise(F.col("status"))
    error = F.when(expired & spent, "lease expired after maximum attempts").when(expired, "worker lease expired")
    return jobs.withColumn("new_status", new).withColumn("new_error", error)


def backoff_seconds(base: Column, attempts: Column, cap: int = 3600) -> Column:
    """Seconds until the next attempt: doubled with each one, six times at most, an hour at most."""
    return F.least(F.lit(cap).cast("double"), base * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6)))).cast("long")


def claims(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """For each worker (worker, resource) the queued job that it would claim: highest priority, then oldest, then least id. One candidate per resource is enough, so a few rows are joined."""
    order = Window.partitionBy("resource").orderBy(F.desc("priority"), "created_at", "id")
    first = jobs.where("status = 'queued'").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("resource", "id", "priority", "created_at")
    return workers.join(small(first), "resource")


def dependency_state(jobs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """id and state of jobs with dependencies (id, depends_on): `failed` if one failed or was canceled, `ready` if all are done, else `wait`. A dependency that isn't there counts as failed."""
    done = jobs.select(F.col("id").alias("depends_on"), "status")
    joined = dependencies.join(done, "depends_on", "left")
    bad = F.col("status").isNull() | F.col("status").isin("failed", "error", "canceled")
    return joined.groupBy("id").agg(F.when(F.bool_or(bad), "failed").when(F.bool_and(F.col("status").isin("done", "completed")), "ready").otherwise("wait").alias("state"))


def not_queued(rows: DataFrame, jobs: DataFrame, most: int) -> DataFrame:
    """The `most` oldest rows (id, created_at) for which no job (id, status) is queued or under way; ties by id."""
    busy = jobs.where(F.col("status").isin("queued", "claimed")).select("id").distinct()
    return rows.join(busy, "id", "left_anti").orderBy("created_at", "id").limit(most)


def prunable(jobs: DataFrame, dependencies: DataFrame, before: Column, most: int) -> DataFrame:
    """ids and reason of terminal jobs to drop: older than `before`, then the oldest above `most`; never one that another job depends on."""
    free = jobs.where(F.col("status").isin(*TERMINAL)).join(dependencies.select(F.col("depends_on").alias("id")).distinct(), "id", "left_anti")
    old = free.where(F.col("created_at") < before).select("id", F.lit("retention").alias("reason"))
    left = free.where(~(F.col("created_at") < before))
    total = left.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("_excess"))
    oldest = first_rows(left.select("id", "created_at").withColumn("_at", F.unix_micros(F.col("created_at").cast("timestamp"))), max(0, total.first()[0]), "_at", "id")
    return old.unionByName(oldest.select("id", F.lit("cap").alias("reason")))


def retried(jobs: DataFrame) -> DataFrame:
    """Failed and canceled jobs back in the queue with no attempts."""
    again = F.col("status").isin("failed", "canceled")
    return jobs.withColumns({"status": F.when(again, "queued").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))})


def compacted(jobs: DataFrame) -> DataFrame:
    """Jobs without the payloads of relink jobs that are done."""
    settled = (F.col("status") == "done") & (F.col("type") == "vector.relink")
    return jobs.withColumn("payload_bytes", F.when(~settled, F.col("payload_bytes")))
