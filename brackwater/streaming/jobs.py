"""The ingest queue: a folder of requests, read as a stream into the engine.

The stream's checkpoint is the queue's state, so a run that dies takes its batch again;
contents that are stored already are then duplicates, and a job's number and batch
name its row, so replaying changes nothing.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from brackwater.engine import INPUT, Engine, NotFound, ended

REQUEST = "job_id long, domain_id long, " + INPUT
MAX_ATTEMPTS = 3
RETENTION_MS = 24 * 3600 * 1000


def lifecycle(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(job_id, status, attempts) of each job from its events (job_id, ts, event_type).

    ``claim`` starts an attempt, ``done`` ends the job, ``fail`` sends it back until
    ``max_attempts`` were made. A job whose last event is a claim is running.
    """
    last = Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("event_type").desc())
    each = events.groupBy("job_id").agg(F.count_if(F.col("event_type") == "claim").alias("attempts"))
    end = events.withColumn("r", F.row_number().over(last)).where("r = 1").select("job_id", F.col("event_type").alias("last"))
    status = (
        F.when(F.col("last") == "done", "Done").when(F.col("last") == "claim", "Running")
        .when((F.col("last") == "fail") & (F.col("attempts") >= max_attempts), "Failed").otherwise("Pending")
    )
    return each.join(end, "job_id").select("job_id", status.alias("status"), "attempts")


def requeue_running(jobs: DataFrame) -> DataFrame:
    """After a crash what ran is pending again."""
    return jobs.withColumn("status", F.when(F.col("status") == "Running", "Pending").otherwise(F.col("status")))


def retained(jobs: DataFrame, now_ms: int, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Without jobs that ended longer ago than the retention."""
    return jobs.where(~ended(jobs, now_ms, retention_ms))


def _take(engine: Engine, domain_id: int | None, own: DataFrame, max_attempts: int) -> None:
    """Ingest the requests of one domain and write how each ended.

    What fails as often as may be is halved and tried again, down to single requests,
    so a request that can't be taken fails alone; with a domain that isn't there all do.
    """
    jobs, now = own.select(F.col("job_id").alias("n"), "job_id"), engine.clock()
    error, attempts = None, 0
    while attempts < max_attempts:
        attempts += 1
        try:
            result = engine.ingest(domain_id, own.withColumn("n", F.col("job_id")).drop("job_id", "domain_id"))
            jobs, error = jobs.join(result, "n", "left"), None
            break
        except NotFound as e:
            error = str(e)
        except (ValueError, KeyError, PySparkException) as e:
            error = str(e).strip().splitlines()[-1]
            if own.select("job_id").distinct().count() > 1:
                lowest, highest = own.agg(F.min("job_id"), F.max("job_id")).first()
                middle = (lowest + highest) // 2
                for half in (own.where(F.col("job_id") <= middle), own.where(F.col("job_id") > middle)):
                    _take(engine, domain_id, half, max_attempts)
                return
    if "document_id" not in jobs.columns:
        jobs = jobs.withColumn("document_id", F.lit(None).cast("long"))
    rows = jobs.select(
        F.col("job_id").alias("id"), F.lit("ingest").alias("kind"), "document_id", F.lit(domain_id).cast("long").alias("domain_id"), F.lit("Failed" if error else "Done").alias("status"),
        F.lit(attempts).alias("attempts"), F.lit(error).cast("string").alias("error"), F.lit(now).cast("long").alias("created_at"), F.lit(engine.clock()).cast("long").alias("updated_at"),
    )
    engine.store.commit({}, appends={"jobs": rows})


def ingest_stream(engine: Engine, inbox: str, checkpoint: str, max_attempts: int = MAX_ATTEMPTS) -> StreamingQuery:
    """Take what lies in the inbox, as JSON of REQUEST, into the engine, and stop; a row of ``jobs`` says how each ended.

    A request without job_id is left out, as it can't be told apart.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        done = engine.table("jobs").where(F.col("status") == "Done").select(F.col("id").alias("job_id"))
        fresh = batch.where("job_id is not null").join(done, "job_id", "left_anti").persist()
        try:
            for (domain_id,) in fresh.select("domain_id").distinct().orderBy("domain_id").collect():
                _take(engine, domain_id, fresh.where(F.col("domain_id").eqNullSafe(F.lit(domain_id))), max_attempts)
        finally:
            fresh.unpersist()

    requests = engine.spark.readStream.schema(REQUEST).json(inbox)
    return requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
