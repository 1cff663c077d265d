"""Structured Streaming twins of the batch queries, and state that only a stream keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netweir.operators.recursions import streamed


def events_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, a few per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(packets: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Counts, bytes and sources of each (destination, window); windows close when the watermark passes them."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", width), "dst").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.approx_count_distinct("src", 0.01).alias("sources")).select("dst", F.col("window.start").alias("w"), "packets", "bytes", "sources")


def sliding(packets: DataFrame, width: str = "60 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The same over windows that overlap."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", width, step), "dst").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select("dst", F.col("window.start").alias("w"), "packets", "bytes")


def sessions(packets: DataFrame, keys: list[str], idle: str = "5 minutes", late: str = "10 seconds") -> DataFrame:
    """Flows or attack events: a key's packets without a gap of ``idle``, with their span and volume."""
    return packets.withWatermark("ts", late).groupBy(F.session_window("ts", idle), *keys).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.max("length").alias("peak")).select(*keys, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "packets", "bytes", "peak")


#: Cycles and factors of the anomaly state machine.
OPEN_AFTER, CLOSE_AFTER, COOL = 2, 3, 2
STATES = "dst long, w timestamp, state string, peak double"


def _advance(state: str, streak: int, peak: float, value: float, hot: bool) -> tuple[str, int, float]:
    """The next state of normal -> suspect -> attack -> cooling -> normal.

    Suspicion becomes an attack after ``OPEN_AFTER`` hot windows in a row; an attack cools after ``CLOSE_AFTER`` calm ones, unless
    traffic still is over half its peak, and ends after ``COOL`` more.
    """
    if state == "normal":
        return ("suspect", 1, value) if hot else ("normal", 0, 0.0)
    if state == "suspect":
        if not hot:
            return "normal", 0, 0.0
        return ("attack" if streak + 1 >= OPEN_AFTER else "suspect"), streak + 1, max(peak, value)
    if state == "attack":
        if hot or value > 0.5 * peak:
            return "attack", 0, max(peak, value)
        return ("cooling", 0, peak) if streak + 1 >= CLOSE_AFTER else ("attack", streak + 1, peak)
    if hot:
        return "attack", 0, max(peak, value)
    return ("normal", 0, 0.0) if streak + 1 >= COOL else ("cooling", streak + 1, peak)


def _walk(rows: pd.DataFrame, state: tuple[str, int, float]) -> tuple[pd.DataFrame, tuple[str, int, float]]:
    rows = rows.sort_values("w", kind="stable")
    states, peaks = [], []
    for value, hot in zip(rows["value"], rows["hot"], strict=True):
        state = _advance(*state, float(value), bool(hot))
        states.append(state[0])
        peaks.append(state[2])
    return rows[["dst", "w"]].assign(state=states, peak=peaks), state


def state_machine(windows: DataFrame) -> DataFrame:
    """State and peak of every window (dst, w, value, hot) in a batch: a destination's windows stream past its state."""

    def step(state: tuple[str, int, float], value: float, hot: bool) -> tuple:
        state = _advance(*state, value, hot)
        return state, (state[0], state[2])

    return streamed(windows.select("dst", "w", "value", "hot"), ["dst"], ["w"], lambda: ("normal", 0, 0.0), step, ["dst", "w"], "state string, peak double")


def state_machine_stream(windows: DataFrame) -> DataFrame:
    """The same over a stream of closed windows; a destination's state outlives batches and restarts, and goes when it is
    normal again, so idle destinations hold none."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else ("normal", 0, 0.0)
        rows = pd.concat(list(batches))
        out, current = _walk(rows, current)
        if current != ("normal", 0, 0.0):
            state.update(current)
        elif state.exists:
            state.remove()
        yield out

    return windows.groupBy("dst").applyInPandasWithState(step, STATES, "state string, streak int, peak double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has and return the rows as a table in memory, for small results and tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def adaptive_sampling(windows: DataFrame, keys: list[str], ts: str, hot: Column, slow: int = 60, after: int = 60) -> DataFrame:
    """Windows that a recorder keeps: all while hot and ``after`` seconds longer, else the first of every ``slow`` seconds."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.unix_timestamp(ts)
    last = F.max(F.when(hot, seconds)).over(w)
    quick = F.coalesce(seconds - last <= after, F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*keys, F.floor(seconds / slow)).orderBy(ts))
    return windows.withColumns({"_q": quick, "_n": nth}).filter(F.col("_q") | (F.col("_n") == 1)).drop("_q", "_n")


def flushed(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch of a stream to a table by day, once: a batch that is written again replaces only its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumns({"day": F.to_date("w"), "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
