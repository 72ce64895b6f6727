"""Processing a stream of tasks, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import inference
from ..scratch import Scratch

#: A photo that can be opened has an address like this.
ADDRESS = r"^[a-z]+://\S+$"
RESULT = "reply_subject string, image_id string, n_detections long, error string"


def split_tasks(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks that can be opened, tasks that can't): a task needs the address of its photo."""
    usable = F.coalesce(F.col("image_url").rlike(ADDRESS), F.lit(False))
    return batch.filter(usable), batch.filter(~usable)


def process_batch(batch: DataFrame, pipeline: Callable[[DataFrame], DataFrame] = inference.process) -> DataFrame:
    """One result for each task: its number of detections, or an error."""
    good, bad = split_tasks(batch)
    found = pipeline(good.select(F.col("image_id").alias("id")).distinct()).groupBy("source_image_id").agg(F.count("*").alias("n"))
    done = good.join(found, F.col("image_id") == F.col("source_image_id"), "left")
    done = done.select("reply_subject", "image_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_detections"), F.lit(None).cast("string").alias("error"))
    failed = bad.select("reply_subject", "image_id", F.lit(0).cast("long").alias("n_detections"), F.lit("image could not be opened").alias("error"))
    return done.unionByName(failed)


def run(tasks: DataFrame, sink: str, checkpoint: str, pipeline: Callable[[DataFrame], DataFrame] = inference.process, interval: str | None = None) -> StreamingQuery:
    """Write the results of a stream of tasks to `sink`. A batch that fails as a whole gives an error result for
    each of its tasks, and the stream goes on. Each batch has its own folder, so a repeated one replaces itself.
    Without `interval` the query ends when no task is left."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _start(tasks, write, checkpoint, pipeline, interval)


def post(tasks: DataFrame, sink: str, checkpoint: str, job: str, pipeline: Callable[[DataFrame], DataFrame] = inference.process, interval: str | None = None) -> StreamingQuery:
    """As `run`, to a result sink (`sources.results`), where a batch counts as a whole or not at all. `JobTotals`
    has the job's totals while it runs; the query has the job's name."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.format("duskframe_results").option("path", sink).option("batch", number).mode("append").save()

    return _start(JobTotals.observe(tasks, job), write, checkpoint, pipeline, interval, job)


def _start(tasks: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, pipeline: Callable[[DataFrame], DataFrame], interval: str | None, name: str | None = None) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        # Written, not cached: of a cached batch each executor that needs a part may make its own, and count its tasks again.
        scratch = Scratch(batch.sparkSession, "tasks")
        batch = scratch.save(batch)
        try:
            write(process_batch(batch, pipeline), number)
        except Exception as error:
            text = str(error).splitlines()[0][:200] if str(error) else type(error).__name__
            write(batch.select("reply_subject", "image_id", F.lit(0).cast("long").alias("n_detections"), F.lit(text).alias("error")), number)
        finally:
            scratch.drop(batch)

    writer = tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class JobTotals(StreamingQueryListener):
    """Totals of jobs while their queries run: `totals` has tasks, unusable (without an address) and batches by job.
    Add it to `spark.streams` before the jobs begin."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.running: set[str] = set()
        self.failed: dict[str, str] = {}
        self._jobs: dict = {}

    @staticmethod
    def observe(tasks: DataFrame, job: str) -> DataFrame:
        unusable = ~F.coalesce(F.col("image_url").rlike(ADDRESS), F.lit(False))
        return tasks.observe(f"job {job}", F.count(F.lit(1)).alias("tasks"), F.count_if(unusable).alias("unusable"))

    def onQueryStarted(self, event) -> None:
        if event.name:
            self._jobs[event.runId] = event.name
            self.running.add(event.name)

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith("job "):
                total = self.totals.setdefault(name[4:], {"tasks": 0, "unusable": 0, "batches": 0})
                total["tasks"] += row["tasks"]
                total["unusable"] += row["unusable"]
                total["batches"] += row["tasks"] > 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        job = self._jobs.pop(event.runId, None)
        self.running.discard(job)
        if job and event.exception:
            self.failed[job] = event.exception


def run_jobs(jobs: dict[str, DataFrame], root: str, pipelines: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> JobTotals:
    """Run a stream of tasks for each job, all at once, to the end of what is there; results of job x are in
    `root`/x/results. A job that fails does not stop the others; at the end none is left running."""
    spark = next(iter(jobs.values())).sparkSession
    totals = JobTotals()
    spark.streams.addListener(totals)
    queries = []
    try:
        for job, tasks in jobs.items():
            queries.append(post(tasks, f"{root}/{job}/results", f"{root}/{job}/state", job, (pipelines or {}).get(job, inference.process)))
        for query in queries:
            try:
                query.awaitTermination()
            except StreamingQueryException as error:
                totals.failed.setdefault(query.name, str(error))
    finally:
        for query in queries:
            query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        spark.streams.removeListener(totals)
    return totals


def metrics(results: DataFrame) -> DataFrame:
    """One row: results, failures, share of successes."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed")).withColumn("success_rate", F.when(F.col("total") > 0, 1 - F.col("failed") / F.col("total")))
