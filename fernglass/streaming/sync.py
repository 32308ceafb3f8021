"""Streams: continuous sync of documents into a versioned target, approvals that expire, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.incremental import VersionedTarget, one_per_key

#: Seconds that a request waits for approval, and that an approval holds.
REQUEST_SECONDS, GRANT_SECONDS = 120, 300


def sync_folder(spark: SparkSession, folder: str, schema: StructType, target: VersionedTarget, transform: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "doc_id") -> None:
    """Take every file of ``folder`` that has not been taken, and publish its rows in place of those of their keys; a batch writes no other rows.

    Of rows of one key in a batch the one that sorts last over its columns counts, whatever their order; rows without a key are left out. A batch that is run
    again after a crash publishes the same rows again, so nothing is skipped or doubled."""

    def publish(batch: DataFrame, number: int) -> None:
        order = [F.desc_nulls_last(c) for c, kind in batch.dtypes if c != key and not kind.startswith("map")]
        fresh = transform(one_per_key(batch, key, order or [F.col(key)]))
        target.apply(fresh, fresh.select(key), f"{number:08d}")

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_STATE = "status string, since double"
_OUT = "key string, at double, action string, decision string"


def decide(events: pd.DataFrame, state: tuple[str, float] | None) -> tuple[list[tuple[float, str, str]], tuple[str, float] | None]:
    """Decisions on the events ``at, action`` of one key in order of time. A request waits ``REQUEST_SECONDS``; an approval of a waiting one holds
    ``GRANT_SECONDS`` and is used up by one redemption, after which the next needs a new request."""
    out = []
    for at, action in sorted(zip(events["at"], events["action"])):
        if state and at - state[1] > (REQUEST_SECONDS if state[0] == "pending" else GRANT_SECONDS):
            state = None
        if action == "request" and state is None:
            state, said = ("pending", at), "pending"
        elif action == "request":
            said = state[0]
        elif action == "approve":
            said = "approved" if state and state[0] == "pending" else "refused"
            state = ("approved", at) if said == "approved" else state
        else:
            said = "allowed" if state and state[0] == "approved" else "refused"
            state = None if said == "allowed" else state
        out.append((at, action, said))
    return out, state


def approvals(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Decisions ``key, at, action, decision`` on a stream of ``key, at, action``, with state by key, which goes when the watermark has passed what it waits for.

    Events later than ``late`` are dropped."""

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        decisions, after = decide(pd.concat(list(frames)), state.get if state.exists else None)
        ends = int(1000 * (after[1] + (REQUEST_SECONDS if after[0] == "pending" else GRANT_SECONDS))) + 1 if after else 0
        if after and ends > state.getCurrentWatermarkMs():
            state.update(after)
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *d) for d in decisions], columns=["key", "at", "action", "decision"])

    timed = events.withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    return timed.groupBy("key").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def approvals_batch(events: DataFrame) -> DataFrame:
    """The same decisions on a table; a key is one group, as each decision needs the one before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(frame["key"].iloc[0], *d) for d in decide(frame, None)[0]], columns=["key", "at", "action", "decision"])

    return events.select("key", "at", "action").groupBy("key").applyInPandas(run, _OUT)


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` by tumbling event-time window, or by one that starts every ``slide``; on a stream, rows later than ``late`` are dropped and windows end."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, start, end, n`` of each user's runs of events with less than ``gap`` between neighbours; the end is the last event's time and the gap."""
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def followed_by(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``user_id, at, then``: events of ``first`` and those of ``second`` of the same user at most ``within`` later; on streams both sides' state ends by the watermark."""
    a = _timed(first, late).select("user_id", F.col("ts").alias("at"))
    b = _timed(second, late).select(F.col("user_id").alias("_user"), F.col("ts").alias("then"))
    return a.join(b, F.expr(f"user_id = _user and then >= at and then <= at + interval {within}")).select("user_id", "at", "then")
