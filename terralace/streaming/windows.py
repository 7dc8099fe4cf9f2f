"""Event-time streams over parquet folders: windows, late data, state, and interval joins.

Every function takes a streaming (or batch) DataFrame of events: event_id, ts, user_id, event_type, value. Streams are
bounded here by ``available_now``, which reads what is there and ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terralace.sources.tables import cut_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int | None = None) -> DataFrame:
    """A table of a data folder as a stream of its files, all at once or so many in a batch."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # the table may be one file or a folder of files
    return reader.parquet(f"{folder}/{name}.parquet*")


def available_now(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there, in as many batches as it takes, and read back what it says at the end.

    append: all rows. complete: the table of the last batch. update: the last row of each of ``keys``, over all batches.
    Each batch has a folder of its own, written anew if it is repeated. A stream without any batch gives an empty table.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    spark = stream.sparkSession
    base = cut_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(-1 if last is None else last))
    if mode == "update":
        whole = F.struct(*[F.col(c) for c in stream.columns])
        return rows.groupBy(*keys).agg(F.max_by(whole, F.col("batch")).alias("row")).select("row.*")
    return rows.drop("batch")


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a timestamp and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Count and sum of values by event type in windows side by side."""
    rows = timed(events).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours") -> DataFrame:
    """Counts by event type in overlapping windows."""
    rows = timed(events).groupBy(F.window("ts", width, step), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: runs of events less than ``gap`` apart."""
    rows = timed(events).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n"
    )


def first_deliveries(events: DataFrame) -> DataFrame:
    """Events without those that repeat an id within the watermark."""
    return timed(events).dropDuplicatesWithinWatermark(["event_id"])


def follow_ups(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream interval join: of each user, events at most ``within`` after one of another type."""
    side = lambda name: timed(events.select(
        F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("event_type").alias(f"{name}_type"), "ts"
    )).withColumnRenamed("ts", f"{name}_ts")
    near = F.expr(f"first_user = second_user AND second_ts >= first_ts AND second_ts <= first_ts + INTERVAL {within}")
    joined = side("first").join(side("second"), near & (F.col("first_type") != F.col("second_type")))
    return joined.select(F.col("first_user").alias("user_id"), "first_id", "first_type", "second_id", "second_type")


def counts(events: DataFrame) -> DataFrame:
    """Running number of events and time of the latest, by type: what a poll for changes compares."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


_STATE = "last double, n long"
_OUT = "user_id long, n_changes long, last_value double"


def value_changes(events: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Per user, how often the value moved by more than ``threshold`` against the last value that did (stateful)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            if v is not None and v == v and (last is None or abs(v - last) > threshold):
                n += last is not None
                last = v
        if last is not None:
            state.update((float(last), int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "n_changes": [int(n)], "last_value": [last]})

    rows = events.select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
