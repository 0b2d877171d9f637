"""Events in files as a Spark data source, read in batches or as a stream, and the health of a source.

`register(spark)` makes the format known; `spark.read.format("lodestrata_events")` and `spark.readStream` of the
same name take the options path, pattern (of file names), source_id, inject (put _index and _id into the
payload), split_bytes, and position (start or end: where a new stream begins). Rows have the columns of
SCHEMA: index and at (file and offset of the line, which give the order), id (both as one), the payload as text, and
error for a line that isn't a JSON object; such lines are rows too, blank ones aren't.

Large files are cut at lines and read by many tasks, small ones are read together. Filters `index = ..` and
`index in (..)` choose files before any is opened.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.streaming.listener import StreamingQueryListener

from .places import lines, listed, located, ranges

NAME = "lodestrata_events"
SCHEMA = "source_id string, index string, at long, id string, payload string, received_at timestamp, error string"
ROWS = 5_000


class Part(InputPartition):
    """Byte ranges (name, start, end) that a task reads."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class Options:
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the option path must name a folder")
        self.pattern, self.source_id = options.get("pattern", "*"), options.get("source_id", "")
        self.inject = options.get("inject", "false").lower() == "true"
        self.split, self.position = int(options.get("split_bytes", 64 << 20)), options.get("position", "start")
        if self.position not in ("start", "end"):
            raise ValueError("the option position is start or end")


def event(line: bytes, index: str, id: str, inject: bool) -> tuple[str, str | None]:
    """The text of a line, with _index and _id last where asked for (the last of equal names counts), and what is wrong with it."""
    try:
        text = line.decode().strip()
        found = json.loads(text)
    except ValueError:
        return line.decode("utf-8", "replace"), "no JSON"
    if not isinstance(found, dict):
        return text, "no JSON object"
    if inject:
        more = json.dumps({"_index": index, "_id": id}, ensure_ascii=False)[1:]
        text = text[:-1].rstrip() + (", " if found else "") + more
    return text, None


def batches(options: Options, files: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of the lines that begin in the ranges."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    system, base = located(options.path)

    def made(rows):
        now = datetime.datetime.now(datetime.timezone.utc)
        columns = [(options.source_id, index, at, id, text, now, error) for index, at, id, text, error in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns), kinds)], names)

    rows = []
    for name, start, end in files:
        with system.open_input_file(f"{base.rstrip('/')}/{name}") as file:
            for at, line in lines(file, start, end):
                if line.strip():
                    id = f"{name}:{at}"
                    rows.append((name, at, id, *event(line, name, id, options.inject)))
                    if len(rows) == ROWS:
                        yield made(rows)
                        rows = []
    if rows:
        yield made(rows)


class EventReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options, self.only = options, None

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("index",):
                yield f
            else:
                self.only = set(values) if self.only is None else self.only & set(values)

    def partitions(self):
        files = [(name, 0, size) for name, size in listed(self.options.path, self.options.pattern) if self.only is None or name in self.only]
        return [Part(r) for r in ranges(files, self.options.split)] or [Part([])]

    def read(self, partition):
        return batches(self.options, partition.files)


class EventStream(DataSourceStreamReader):
    """New lines of a folder's files, which grow at their ends and whose number may grow.

    An offset has the bytes read of each file, up to a line's end: a line without one is left until it is
    whole. A file that became shorter was begun anew and is read from its start.
    """

    def __init__(self, options: Options):
        self.options, self.known = options, {}

    def _whole(self, name: str, size: int) -> int:
        """Bytes of a file up to its last line end."""
        system, base = located(self.options.path)
        known = self.known.get(name, 0)
        if known == size:
            return size
        with system.open_input_file(f"{base.rstrip('/')}/{name}") as file:
            end = size
            while end > 0:
                start = max(0, end - (1 << 16))
                file.seek(start)
                at = file.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def initialOffset(self):
        return self.latestOffset() if self.options.position == "end" else {}

    def latestOffset(self):
        self.known = {name: self._whole(name, size) for name, size in listed(self.options.path, self.options.pattern)}
        return dict(self.known)

    def partitions(self, start, end):
        files = []
        for name, to in sorted(end.items()):
            at = start.get(name, 0)
            if at != to:
                files.append((name, at if at < to else 0, to))
        return [Part(r) for r in ranges(files, self.options.split)]

    def read(self, partition):
        return batches(self.options, partition.files)

    def commit(self, end):
        pass  # the query's checkpoint has the offsets, and files aren't the stream's to delete


class EventSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EventReader(Options(self.options))

    def streamReader(self, schema):
        return EventStream(Options(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventSource)


def sample(events: DataFrame, n: int = 1000) -> DataFrame:
    """The first n whole events in order of file and line, numbered by seq from 0; fewer where there are fewer."""
    first = events.where("error is null").orderBy("index", "at").limit(n)
    return first.withColumn("seq", F.row_number().over(Window.orderBy("index", "at")).cast("long") - 1)  # of n rows at most


# ---- health ---------------------------------------------------------------------------------------

HEALTH = "source_id string, query_id string, batch long, state string, delivered long, errors long, last_event_at string, message string, checked_at timestamp"


def counters() -> list[Column]:
    """delivered, errors, last_event_at of rows of SCHEMA."""
    whole = F.col("error").isNull()
    return [F.count_if(whole).alias("delivered"), F.count_if(~whole).alias("errors"), F.max(F.when(whole, F.col("received_at").cast("string"))).alias("last_event_at")]


def observed(events: DataFrame, name: str = "health") -> DataFrame:
    """events, whose counters are reported with each batch of a stream under the name."""
    return events.observe(name, *counters())


def connect(options: dict[str, str]) -> tuple[str, str]:
    """State of a source by its options, connected or failed, and why; never raises."""
    try:
        listed(Options(options).path)
        return "connected", ""
    except Exception as e:  # whatever a file system says
        return "failed", str(e)


def delivered(events: DataFrame, action) -> dict:
    """Counters of a batch: action (of the DataFrame, such as a write) runs once, and is counted as it runs."""
    seen = Observation()
    action(events.observe(seen, *counters()))
    return dict(seen.get)


class HealthListener(StreamingQueryListener):
    """Adds a row of HEALTH to a folder for each batch of the queries whose events are `observed`, and one when a query ends.

    A batch that is run again after a failure has a second row; `health` counts the last of each.
    """

    def __init__(self, spark: SparkSession, path: str, source_id: str, name: str = "health"):
        self.spark, self.path, self.source_id, self.name, self.ids = spark, path, source_id, name, set()

    def _add(self, query, batch, state, delivered=0, errors=0, last=None, message=""):
        now = datetime.datetime.now(datetime.timezone.utc)
        row = (self.source_id, str(query), batch, state, delivered, errors, last, message, now)
        self.spark.createDataFrame([row], HEALTH).coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and event.progress.numInputRows:
            self.ids.add(event.progress.id)
            state = "degraded" if seen["errors"] else "connected"
            self._add(event.progress.id, event.progress.batchId, state, seen["delivered"], seen["errors"], seen["last_event_at"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.id in self.ids or event.exception:
            self._add(event.id, None, "failed" if event.exception else "disconnected", message=(event.exception or "")[:1000])


def health(spark: SparkSession, path: str) -> DataFrame:
    """source_id, state (the latest), delivered, errors, last_event_at, message, checked_at from the rows that listeners added."""
    rows = spark.read.schema(HEALTH).json(path)
    batch = rows.where("batch is not null").groupBy("source_id", "query_id", "batch").agg(F.max_by(F.struct("delivered", "errors", "last_event_at"), "checked_at").alias("b"))
    sums = batch.groupBy("source_id").agg(F.sum("b.delivered").alias("delivered"), F.sum("b.errors").alias("errors"), F.max("b.last_event_at").alias("last_event_at"))
    last = rows.groupBy("source_id").agg(F.max_by(F.struct("state", "message"), "checked_at").alias("s"), F.max("checked_at").alias("checked_at"))
    return last.join(sums, "source_id", "left").select("source_id", "s.state", F.coalesce("delivered", F.lit(0)).alias("delivered"), F.coalesce("errors", F.lit(0)).alias("errors"), "last_event_at", "s.message", "checked_at")
