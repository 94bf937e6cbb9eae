"""Request streams: the latest request of each key, generation drops, windowed counts.

These restate keyed queues as Structured Streaming; event-time windows are this library's own addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest_per_key(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, n_sent): each update replaces the pending request; out-of-order ones only count."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        at, last, n = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            now = (int(top["ts"].value), int(top["event_id"]))
            if at is None or now > (at, last):
                at, last = now
        state.update((at, last, n))
        yield pd.DataFrame([(*key, last, n)], columns=["user_id", "event_type", "event_id", "n_sent"])

    return events.groupBy("user_id", "event_type").applyInPandasWithState(
        step, "user_id long, event_type string, event_id long, n_sent long", "at long, last long, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per kind and tumbling window; rows later than ``late`` are dropped by the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Drive a stream over what is there to an in-memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def current_chunks(chunks: DataFrame) -> DataFrame:
    """Result chunks (query, token, ...) of each query's latest token; chunks of earlier searches are discarded. For batches and for a stream's micro-batches."""
    latest = chunks.groupBy("query").agg(F.max("token").alias("token"))
    return chunks.join(latest, ["query", "token"], "left_semi")


def download_states(events: DataFrame) -> DataFrame:
    """(id, state, done, total, n_events) of status events (id, seq, state, done, total): the latest by ``seq``, over a stream or a table; state is kept a key."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seq, last, done, total, n = state.get if state.exists else (-1, None, None, None, 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values("seq").iloc[-1]
            if int(top["seq"]) >= seq:
                seq, last, done, total = int(top["seq"]), top["state"], int(top["done"]), int(top["total"])
        state.update((seq, last, done, total, n))
        yield pd.DataFrame([(*key, last, done, total, n)], columns=["id", "state", "done", "total", "n_events"])

    return events.groupBy("id").applyInPandasWithState(step, "id string, state string, done long, total long, n_events long", "seq long, state string, done long, total long, n long", "update", GroupStateTimeout.NoTimeout)


def paced(requests: DataFrame, key: str, at: str, gap: float, cooldown: float = 60.0, retire: int = 3) -> DataFrame:
    """``requests`` (key, at in seconds, failed) with ``starts``: no sooner than ``gap`` after the key's last one, nor within ``cooldown`` of its last failure; null from the
    ``retire``-th failure in a row on, when the key is retired. A key's history is one sequence, walked in batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, misses = None, float("-inf"), 0
        for pdf in batches:
            out = []
            for k, t, bad in zip(pdf[key], pdf[at], pdf["failed"], strict=True):
                if k != now:
                    now, free, misses = k, float("-inf"), 0
                if misses >= retire:
                    out.append(None)
                    continue
                start = max(float(t), free)
                misses = misses + 1 if bad else 0
                free = start + (cooldown if bad else gap)
                out.append(start)
            yield pdf.assign(starts=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", starts double"
    return requests.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, fields)
