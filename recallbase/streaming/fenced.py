"""Results with fencing tokens: a result counts only while its token is the one that its job holds, and only once.

The state is a table of jobs, a version of it per micro-batch, computed from the version before and the batch alone. A
batch that runs again writes the same version again; results that come late, twice, or from a worker whose lease was given
to another change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallbase.operators.shared import cut
from recallbase.streaming.streams import each_batch, last_version

#: A job of the state.
JOB = "id long, status string, token long, result string, accepted_seq long, refused long"


def settle(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs (JOB) after results (seq, id, token, ok, result): the first result by seq with the token of a claimed job ends it, as done or failed; all others are counted as refused. A null token fits none. Results of unknown jobs are ignored."""
    right = F.col("status").eqNullSafe("claimed") & F.coalesce(F.col("token") == F.col("_token"), F.lit(False))
    told = results.select("id", F.col("seq").alias("_seq"), F.col("token").alias("_token"), F.col("ok").alias("_ok"), F.col("result").alias("_result"))
    met = told.join(jobs.select("id", "status", "token"), "id")
    ends = met.groupBy("id").agg(F.min_by(F.when(right, F.struct("_seq", "_ok", "_result")), F.when(right, F.col("_seq"))).alias("e"), F.count("*").alias("n"))
    after = jobs.join(ends, "id", "left")
    ended = F.col("e").isNotNull()
    return after.select(
        "id", F.when(ended, F.when(F.col("e._ok"), "done").otherwise("failed")).otherwise(F.col("status")).alias("status"), F.when(~ended, F.col("token")).alias("token"),
        F.when(ended, F.col("e._result")).otherwise(F.col("result")).alias("result"), F.coalesce("e._seq", "accepted_seq").alias("accepted_seq"),
        (F.col("refused") + F.coalesce("n", F.lit(0)) - ended.cast("int")).alias("refused"),
    )


def apply_results(results: DataFrame, jobs: DataFrame, folder: str) -> DataFrame:
    """The jobs after all results of a stream (seq, id, token, ok, result) that are there now. The folder holds the versions; called again with it, the stream goes on where it was."""
    spark = results.sparkSession
    if last_version(spark, folder) is None:
        jobs.select("id", "status", "token", "result", "accepted_seq", "refused").write.mode("overwrite").parquet(f"{folder}/state--1")

    def work(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(JOB).parquet(f"{folder}/state-{number - 1}")
        cut(settle(before, batch)).write.mode("overwrite").parquet(f"{folder}/state-{number}")

    each_batch(results, f"{folder}/offsets", work)
    return spark.read.schema(JOB).parquet(f"{folder}/state-{last_version(spark, folder)}")
