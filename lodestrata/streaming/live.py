"""Streams of events and telemetry: a tail of a folder, rates by window, fixes regained by state, fields that come together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lodestrata.operators import relations


def tail(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come, at most `files` a batch; the query's checkpoint keeps the place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rates(events: DataFrame, time: str, keys: list[str], window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events and their rate by key and tumbling window; rows later than the watermark are dropped, closed windows leave the state."""
    found = events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
    seconds = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    return found.select(F.col("window.start").alias("start"), *keys, "n", (F.col("n") / seconds).alias("per_second"))


def glitches(points: DataFrame) -> DataFrame:
    """file, glitches: fixes regained after a loss, kept as three numbers of state for each file; points: file, seq, status.

    Rows of a batch are taken in order of seq, batches in order of arrival.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had, lost, n = state.get if state.exists else (False, False, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for status in rows["status"]:
            if status >= 3:
                n += bool(lost)
                had, lost = True, False
            elif status <= 1 and had:
                lost = True
        state.update((had, lost, n))
        yield pd.DataFrame({"file": [key[0]], "glitches": [n]})

    return points.groupBy("file").applyInPandasWithState(step, "file long, glitches long", "had boolean, lost boolean, n long", "update", GroupStateTimeout.NoTimeout)


class InOrder(StatefulProcessor):
    """Fixes regained after a loss in one file, whose rows are held until the watermark has passed their time.

    State: one value, as each read and write of a state costs more than a row: what has been counted (had, lost, n)
    up to the seq last taken, and the rows held (of rows of one seq the last counts). Rows that come after that
    seq was taken are left out, as they are later than the watermark.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "had boolean, lost boolean, n long, last long, seqs array<long>, ats array<long>, statuses array<long>")

    def _taken(self, key, watermark: int, new: dict[int, tuple[int, int]]) -> Iterator[Row]:
        had, lost, n, last, *rows = self.seen.get() or (False, False, 0, -(1 << 63), [], [], [])
        held = {seq: (at, status) for seq, at, status in zip(*rows)}
        held.update(new)
        ready = sorted((seq, status) for seq, (at, status) in held.items() if at <= watermark)
        for seq, status in ready:
            if seq < last:
                continue
            last = seq
            if status >= 3:
                n += bool(lost)
                had, lost = True, False
            elif status <= 1 and had:
                lost = True
        if new or ready:
            rest = [(seq, at, status) for seq, (at, status) in held.items() if at > watermark]
            self.seen.update((had, lost, n, last, *(list(map(list, zip(*rest))) or [[], [], []])))
        if ready:
            yield Row(file=key[0], glitches=n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = {row.seq: (row.at, row.status) for row in rows}
        if new:
            self.handle.registerTimer(max(at for at, _ in new.values()) + 1)
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs(), {})

    def close(self) -> None:
        pass


def glitches_in_order(points: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """file, glitches of a stream of points (file, seq, status and a time after 1970 that rises with seq within a file), whatever order they come in.

    A row is counted when the watermark, `late` behind the latest time, has passed it: rows that come no later
    are put in order of seq first. A file's state is three numbers and the rows of that time; each output
    row has the file's count so far. Needs the RocksDB state store, which is set for the session here.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = points.where("seq is not null and status is not null")
    rows = whole.select("file", F.col("seq").cast("long").alias("seq"), F.col("status").cast("long").alias("status"), F.unix_millis(F.col(time)).alias("at"), F.col(time).alias("_time"))
    rows = rows.withWatermark("_time", late)
    return rows.groupBy("file").transformWithState(InOrder(), "file long, glitches long", "append", "EventTime")


def pair_counts(events: DataFrame, paths: Column) -> DataFrame:
    """path_a, path_b, n: how many events have both of each pair of their paths (an array), each path (path_b null), and all events (both null).

    The counts are the state of a stream, which grows with the pairs of paths, not with the events; a
    pair is made within an event, as wide as the event itself.
    """
    p = F.array_sort(F.array_distinct(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    none = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("path_a"), b.alias("path_b"))
    alone = F.transform("p", lambda x: pair(x, none))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: pair(x, y))))
    each = events.select(p.alias("p")).select(F.explode(F.concat(F.array(pair(none, none)), alone, pairs)).alias("pair"))
    return each.select("pair.*").groupBy("path_a", "path_b").agg(F.count("*").alias("n"))


def information(counts: DataFrame) -> DataFrame:
    """path_a < path_b, both_count, mutual_information of the pairs of a table of `pair_counts`."""
    single = counts.where("path_a is not null and path_b is null")
    total = counts.where("path_a is null").select(F.col("n").alias("_all"))  # one row
    both = counts.where("path_b is not null").join(single.select("path_a", F.col("n").alias("_a")), "path_a")
    both = both.join(single.select(F.col("path_a").alias("path_b"), F.col("n").alias("_b")), "path_b").crossJoin(total)
    bits = relations.mutual_information(F.col("n"), F.col("_a"), F.col("_b"), F.col("_all"))
    return both.select("path_a", "path_b", F.col("n").alias("both_count"), bits.alias("mutual_information"))


def watch_pairs(events: DataFrame, paths: Column, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A writer of a stream that hands the `information` of all events so far, and the number of the batch, to `write` after each batch."""
    counts = pair_counts(events, paths).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return counts.foreachBatch(lambda table, batch: write(information(table), batch))
