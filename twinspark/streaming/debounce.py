"""Streams: debounce by session, counts by window, checks of changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Streams get a watermark, which needs a time with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def trailing(events: DataFrame, key: str, ts: str = "ts", gap: str = "1500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The last event of each burst of a key: bursts end after `gap` without an event."""
    d = timed(events, ts, late)
    s = d.groupBy(F.session_window(ts, gap).alias("burst"), key).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return s.select(key, "last_ts", "n")


def leading(events: DataFrame, key: str, ts: str = "ts", gap_ms: int = 500) -> DataFrame:
    """The first event of a key, and each one `gap_ms` or more after the last that passed; those held back extend nothing.

    An event so long after the one before it always passes, so only the runs between such events are folded.
    """
    d = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us IS NOT NULL")
    if events.isStreaming:
        d = d.groupBy("key").applyInPandasWithState(_passed(gap_ms * 1000), d.schema, "us long", "append", "NoTimeout")
    else:
        w = W.partitionBy("key").orderBy("us")
        d = d.withColumn("opens", F.coalesce(F.col("us") - F.lag("us").over(w) >= gap_ms * 1000, F.lit(True)))
        d = d.withColumn("run", F.sum(F.col("opens").cast("int")).over(w)).groupBy("key", "run").agg(F.array_sort(F.collect_list("us")).alias("run_us"))
        late = lambda kept, us: F.try_element_at(kept, F.lit(-1)) + gap_ms * 1000 > us
        none = F.array().cast("array<bigint>")
        d = d.select("key", F.explode(F.aggregate("run_us", none, lambda kept, us: F.when(F.coalesce(late(kept, us), F.lit(False)), kept).otherwise(F.array_append(kept, us)))).alias("us"))
    return d.select(F.col("key").alias(key), F.timestamp_micros("us").alias(ts))


def _passed(gap: int):
    def run(key, batches, state):
        import pandas as pd

        last, out = state.get[0] if state.exists else None, []
        for us in sorted(us for pdf in batches for us in pdf["us"]):
            if last is None or us - last >= gap:
                last = us
                out.append((key[0], us))
        if out:
            state.update((last,))
            yield pd.DataFrame(out, columns=["key", "us"])

    return run


def tumbling(events: DataFrame, kind: str, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    d = timed(events, ts, late)
    return d.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def checked(stream: DataFrame, known: DataFrame, key: str, sink: str, checkpoint: str):
    """Every micro-batch's rows against a table of known hashes; matches go to a folder of their epoch, so a batch that is tried again replaces its own."""

    def batch(df, epoch):
        df.join(known, key).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
