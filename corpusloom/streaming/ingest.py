"""Streams over growing tables. Offsets and state live in the checkpoint: a restart goes on where it stopped."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.commits import CommittedTable, committed


def events_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row of each key; with a watermark, state older than it is dropped."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, ts: str, window: str, late: str, by: str) -> DataFrame:
    """Tumbling windows by event time (an extension: the batch engine has no event time)."""
    w = F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def same_request(spark: SparkSession, path: str, request: dict) -> None:
    """Keep the request of a stream's first start beside its checkpoint; a resume with another one is an error."""
    text = json.dumps(request, sort_keys=True)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.text(path, wholetext=True).first()[0].strip()
        if held != text:
            raise ValueError(f"resumed with {text}, begun with {held}")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", request: dict | None = None) -> None:
    """Process all that is there once, into Parquet with exactly-once commits, and stop."""
    if request is not None:
        same_request(stream.sparkSession, f"{checkpoint}-request", request)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Updates of an aggregating stream into Parquet, one folder an epoch; of each key the last epoch's row holds."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/e={epoch}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def take_until(stream: DataFrame, most: int, path: str, checkpoint: str) -> int:
    """Batches into a committed table until `most` rows are kept; the batch that reaches it is cut, later ones are skipped.

    What is kept is in the manifests, so that neither a batch nor a restart reads former rows again.
    """

    def kept() -> int:
        return sum(p["rows"] for p in committed(path))

    def batch(rows: DataFrame, epoch: int) -> None:
        if (room := most - kept()) > 0:
            rows.limit(room).write.format("committed").mode("append").option("path", path).option("commit", epoch).save()

    stream.sparkSession.dataSource.register(CommittedTable)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return kept()


def collect_pages(stream: DataFrame, path: str, checkpoint: str, request: dict) -> None:
    """All pages of a paged source into a committed table, batch by batch; started again, it goes on with the next page.

    A failure ends the call with its error. What was committed stays, the batch that failed is read again.
    """
    spark = stream.sparkSession
    same_request(spark, f"{checkpoint}-request", request)
    spark.dataSource.register(CommittedTable)
    sink = stream.writeStream.format("committed").option("path", path).option("checkpointLocation", checkpoint)
    query = sink.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


REQUEST_SCHEMA = "user_id long, n_events long, asks long, verifies long, accepts long, invalid_accepts long"


def request_state(stream: DataFrame) -> DataFrame:
    """Per request (user_id): counts of asks, verifies, accepts, and accepts without a verify before them.

    stream: user_id, event_id, action (ask, verify, accept, other); within a batch events go by event_id.
    """

    def step(key, batches, state: GroupState):
        n, asks, verifies, accepts, invalid, pending = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for action in rows["action"]:
            n += 1
            if action == "ask":
                asks += 1
            elif action == "verify":
                verifies, pending = verifies + 1, 1
            elif action == "accept":
                accepts, invalid, pending = accepts + pending, invalid + (1 - pending), 0
        state.update((n, asks, verifies, accepts, invalid, pending))
        yield pd.DataFrame([(key[0], n, asks, verifies, accepts, invalid)], columns=[c.split()[0] for c in REQUEST_SCHEMA.split(", ")])

    state = "n long, asks long, verifies long, accepts long, invalid long, pending long"
    return stream.groupBy("user_id").applyInPandasWithState(step, REQUEST_SCHEMA, state, "update", GroupStateTimeout.NoTimeout)
