"""Sessions of a stream of captures, by gaps, with state for each trap.

Times of a trap that lie in one stretch of the length of the gap are never parted, so a stretch counts as its first
time, its last time and its number of captures, whatever comes in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import SESSION_GAP_MINUTES

OUTPUT = "base_directory string, session_ordinal int, start_time timestamp, end_time timestamp, num_images long"
_STATE = "session_ordinal int, start_us long, end_us long, num_images long"


def sessionize(captures: DataFrame, maximum_gap_minutes: int = SESSION_GAP_MINUTES, late: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream of (base_directory, timestamp) that comes in order of time within a trap, up
    to `late`. A session closes when a capture comes after the gap, or once the watermark has passed it."""
    gap = maximum_gap_minutes * 60_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamp = lambda us: pd.Timestamp(us, unit="us")
        if state.hasTimedOut:
            ordinal, start, end, n = state.get
            state.update((ordinal + 1, end, end, 0))  # the number of the next session stays
            yield pd.DataFrame({"base_directory": [key[0]], "session_ordinal": [ordinal], "start_time": [stamp(start)], "end_time": [stamp(end)], "num_images": [n]})
            return
        found: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            times = batch["timestamp"].dropna().to_numpy("datetime64[us]").astype("int64")
            for at, part in pd.Series(times).groupby(times // gap):
                a, z, m = found.get(at, (part.min(), part.max(), 0))
                found[at] = (min(a, int(part.min())), max(z, int(part.max())), m + len(part))
        if not found:
            return
        first = found[min(found)][0]
        ordinal, start, end, n = state.get if state.exists else (1, first, first, 0)
        if not n:
            start = end = first
        closed = []
        for at in sorted(found):
            a, z, m = found[at]
            if n and a - end >= gap:
                closed.append((key[0], ordinal, stamp(start), stamp(end), n))
                ordinal, start, n = ordinal + 1, a, 0
            start, end, n = int(min(start, a)), int(max(end, z)), n + m
        state.update((ordinal, start, end, n))
        state.setTimeoutTimestamp(max(end // 1000 + gap // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["base_directory", "session_ordinal", "start_time", "end_time", "num_images"])

    rows = captures.select("base_directory", F.col("timestamp").cast("timestamp").alias("timestamp")).withWatermark("timestamp", late)
    return rows.groupBy("base_directory").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: The last session of each trap: its number, its times (microseconds) and captures; none (0) if it was given out.
_OPEN = "base_directory string, session_ordinal int, a long, z long, n long"


def stitch(held: DataFrame, captures: DataFrame, gap: int) -> DataFrame:
    """Sessions of the last ones that are `held` and of new captures (base_directory, at): base_directory,
    session_ordinal, a, z, n, last. Captures before a held session's start are counted in it."""
    stretch = F.floor(F.col("at") / F.lit(gap))
    found = captures.filter("at is not null").groupBy("base_directory", stretch.alias("stretch")).agg(F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("n"))
    rows = found.select("base_directory", F.lit(None).cast("int").alias("known"), "a", "z", "n").unionByName(held.withColumnRenamed("session_ordinal", "known"))
    order = Window.partitionBy("base_directory").orderBy(F.col("known").isNull(), "a")  # one row a stretch
    before = F.max(F.when(F.col("n") > 0, F.col("z"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("known").isNull() & (before.isNull() | (F.col("a") - before >= gap))
    # A held session keeps its number; one that was given out leaves the next one.
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("base", F.max("known").over(Window.partitionBy("base_directory")))
    rows = rows.withColumn("session_ordinal", (F.coalesce("base", F.lit(0)) + F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    out = rows.groupBy("base_directory", "session_ordinal").agg(F.min(F.when(F.col("n") > 0, F.col("a"))).alias("a"), F.max("z").alias("z"), F.sum("n").alias("n"))
    return out.withColumn("last", F.col("session_ordinal") == F.max("session_ordinal").over(Window.partitionBy("base_directory")))


def run(captures: DataFrame, root: str, checkpoint: str, maximum_gap_minutes: int = SESSION_GAP_MINUTES, late: str = "1 hour", interval: str | None = None) -> StreamingQuery:
    """Write closed sessions of a stream of (base_directory, timestamp) to `root`; `sessions` reads them.

    The last sessions of all traps are a table that each batch writes anew beside the one before, so a repeated
    batch starts from the same state. Batches are stitched by joins and windows: a task holds one row for each
    stretch of a trap. A session closes when its trap has a later one, or when the latest capture of any trap is
    the gap and `late` behind it. Captures without a time are left out. Without `interval` the query ends when no
    capture is left.
    """
    gap, spark = maximum_gap_minutes * 60_000_000, captures.sparkSession
    wait = spark.range(1).select((F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {late}"))).alias("us")).first().us
    rows = captures.select("base_directory", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))

    def each(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(_OPEN).parquet(f"{root}/open/batch={number - 1}") if number else spark.createDataFrame([], _OPEN)
        place = f"{root}/all/batch={number}"
        stitch(held, batch, gap).write.mode("overwrite").parquet(place)
        done = spark.read.parquet(place)
        newest = done.agg(F.max("z")).first()[0]
        over = ~F.col("last") | (F.col("z") + gap + wait <= F.lit(newest))
        _closed(done.filter(over & (F.col("n") > 0))).write.mode("overwrite").parquet(f"{root}/closed/batch={number}")
        kept = lambda c: F.when(~over, F.col(c)).otherwise(F.lit(None if c != "n" else 0)).cast("long").alias(c)
        done.filter("last").select("base_directory", "session_ordinal", kept("a"), kept("z"), kept("n")).write.mode("overwrite").parquet(f"{root}/open/batch={number}")

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _closed(rows: DataFrame) -> DataFrame:
    time = lambda c: F.timestamp_micros(c).alias(c)
    return rows.select("base_directory", "session_ordinal", time("a"), time("z"), "n").toDF("base_directory", "session_ordinal", "start_time", "end_time", "num_images")


def sessions(spark: SparkSession, root: str, still_open: bool = False) -> DataFrame:
    """Closed sessions that `run` has written; with `still_open` also those that are open after its last batch, as
    they are at the end of a stream."""
    out = spark.read.schema(OUTPUT).parquet(f"{root}/closed").select("base_directory", "session_ordinal", "start_time", "end_time", "num_images")
    if still_open:
        states = spark.read.schema(_OPEN + ", batch int").parquet(f"{root}/open")
        last = states.agg(F.max("batch")).first()[0]
        out = out.unionByName(_closed(states.filter((F.col("batch") == F.lit(last)) & (F.col("n") > 0))))
    return out
