"""Folders of binary logs, read by many tasks each.

A log can be cut anywhere, though where records begin is known only from the start: it is read in ranges of
bytes. One pass finds the descriptions of types, which may stand anywhere. In a second one every range but the
first starts some way before its bytes, where it falls in step with the records, and tells where it enters its
range and where it leaves it. Ranges that don't enter where the one before left are walked again from there, so
the places are those of a single walk through the file, whatever is in it. A third pass decodes the records
of each range by type, as columns. A file that can't be read that way has a row with `error`; no job fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dataflash
from .dataflash import CODES, DEGREES, DESCRIPTION, HUNDREDTHS, SYNC
from .places import listed, located, stored

#: Bytes of a range; bytes before it in which a walk falls in step; the most that a record or a description reaches beyond its start.
SPLIT, BEFORE, REACH = 32 << 20, 1 << 16, 300
#: Bytes of a whole description.
DESCRIBED = 3 + dataflash.DESCRIBED.size
ROWS = 20_000
TYPES = "array<struct<type_id:int,length:int,name:string,format:string,columns:array<string>>>"
#: NumPy's codes of the format characters.
NUMPY = {c: f"S{s[:-1]}" if s[-1] == "s" else np.dtype(s).newbyteorder("<").str for c, s in CODES.items()}


def ranges(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """path, start, end, size: the ranges of every `*.BIN` and `*.bin` below a folder, dealt out to tasks; their bytes aren't read."""
    found = [(f"{folder.rstrip('/')}/{name}", size) for name, size in listed(folder) if name.endswith((".BIN", ".bin"))]
    files = spark.createDataFrame(found, "path string, size long")
    cut = files.select("path", F.explode(F.expr(f"sequence(0, greatest(size - 1, 0), {split})")).alias("start"), "size")
    return dealt(cut.select("path", "start", F.least(F.col("start") + split, "size").alias("end"), "size"), tasks(spark, [size for _, size in found], split))


def tasks(spark: SparkSession, sizes: list[int], split: int) -> int:
    """Tasks for the ranges of files of these sizes: one for each range, but no more than a shuffle has or than there are SPLIT bytes."""
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes) // SPLIT)
    return max(1, min(sum(-(-size // split) for size in sizes), most))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Ranges in n tasks. A number keeps Spark from putting them together again, as their rows are small whatever bytes they stand for."""
    return rows.repartition(n, "path", "start")


def read(path: str, start: int, end: int) -> bytes:
    system, place = located(path)
    with system.open_input_file(place) as file:
        file.seek(start)
        return file.read(end - start)


def described(cuts: DataFrame) -> DataFrame:
    """path, size, types: of each file its last description of every type, as many as 256; without any, an empty array."""

    def run(batches):
        mark, whole = SYNC + bytes([DESCRIPTION]), DESCRIBED
        for batch in batches:
            for row in batch.to_pylist():
                data, out = read(row["path"], row["start"], min(row["end"] + whole, row["size"])), []
                at = data.find(mark)
                while 0 <= at < row["end"] - row["start"]:
                    found = dataflash.description(data[at + 3 : at + whole]) if at + whole <= len(data) else None
                    if found:
                        kind, (length, name, form, fields, _) = found
                        out.append({"at": row["start"] + at, "type_id": kind, "length": length, "name": name, "format": form, "columns": [n for n, _ in fields]})
                    at = data.find(mark, at + 1)
                if out:
                    yield pa.RecordBatch.from_pylist([{"path": row["path"]} | o for o in out], pa.schema([("path", pa.string()), ("at", pa.int64()), ("type_id", pa.int32()), ("length", pa.int32()), ("name", pa.string()), ("format", pa.string()), ("columns", pa.list_(pa.string()))]))

    found = cuts.mapInArrow(run, "path string, at long, type_id int, length int, name string, format string, columns array<string>")
    last = found.groupBy("path", "type_id").agg(F.max_by(F.struct("type_id", "length", "name", "format", "columns"), "at").alias("t"))
    types = last.groupBy("path").agg(F.array_sort(F.collect_list("t")).alias("types"))  # 256 at most
    return cuts.where("start = 0").select("path", "size").join(types, "path", "left").withColumn("types", F.coalesce("types", F.array().cast(TYPES)))


class Walk:
    """Steps through a range's bytes as through the whole file."""

    def __init__(self, path: str, start: int, end: int, size: int, types: list[dict], before: int = BEFORE):
        self.start, self.end, self.size = start, end, size
        self.first = max(0, start - before)
        self.data = read(path, self.first, min(end + REACH, size))
        self.types = {}
        for t in types:
            codes = [c for c in t["format"] if c in CODES]
            layout = np.dtype({"names": [f"f{i}" for i in range(len(codes))], "formats": [NUMPY[c] for c in codes]})
            self.types[t["type_id"]] = (t["length"], t["name"], list(zip(t["columns"], codes)), layout)

    def from_(self, at: int, found: list[tuple[int, int]] | None = None, end: int | None = None) -> int:
        """Walk from an offset of the file to the range's end (or `end`); (offset, type id) of records are added to found; where the walk goes on."""
        data, base, last = self.data, self.first, (self.end if end is None else end) - self.first
        at = data.find(SYNC, at - base)
        next_ = at
        while 0 <= at < last and at + base < self.size - 2:
            kind, step = data[at + 2], 3
            t = self.types.get(kind)
            if kind == DESCRIPTION:
                step = DESCRIBED
            elif t and t[0]:
                if at + base + t[0] > self.size:
                    step = 1
                else:
                    step = t[0] if t[0] > 3 else 4
                    if found is not None and t[0] - 3 >= t[3].itemsize:
                        found.append((at + base, kind))
            next_ = at + step
            at = data.find(SYNC, next_)
        return max(next_ + base, last + base)

    def entered(self) -> int:
        return self.start if self.start == 0 else self.from_(self.first, end=self.start)

    def columns(self, found: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(type id, places in found, offsets, columns) of each type among found; all records of a type are decoded at once."""
        if not found:
            return
        offsets, kinds = (np.array(x, np.int64) for x in zip(*found))
        raw = np.frombuffer(self.data, np.uint8)
        for kind in np.unique(kinds).tolist():
            _, _, fields, layout = self.types[kind]
            where = np.flatnonzero(kinds == kind)
            if layout.itemsize:
                body = raw[(offsets[where] - self.first + 3)[:, None] + np.arange(layout.itemsize)]
                table = np.ascontiguousarray(body).view(layout).ravel()
            yield kind, where, offsets[where], [decoded(table[f"f{i}"], c) for i, (_, c) in enumerate(fields)]


def decoded(column: np.ndarray, code: str):
    """A column of values: texts as a list, floats widened, scaled numbers divided."""
    if column.dtype.kind == "S":
        return [dataflash.text(v) for v in column.tolist()]
    if code in HUNDREDTHS:
        return column / 100.0
    return column / 1e7 if code in DEGREES else column.astype(np.float64) if column.dtype.kind == "f" else column


class Logs:
    """The logs of a folder: `types`, `records` of all types, and `typed` columns of one; passes whose tables are small are made once."""

    def __init__(self, spark: SparkSession, folder: str, split: int = SPLIT, before: int = BEFORE):
        self.split, self.before = split, before
        self.cuts = ranges(spark, folder, split)
        self.tasks = tasks(spark, [size for name, size in listed(folder) if name.endswith((".BIN", ".bin"))], split)
        self.described = stored(described(self.cuts), "types")
        self.walked = self._walked()

    def _passed(self, rows: DataFrame) -> DataFrame:
        """path, start, end, size, types, entry (given, or found by falling in step), exit, n (records) of ranges."""
        before = self.before

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    walk, found = Walk(row["path"], row["start"], row["end"], row["size"], row["types"], before), []
                    entry = walk.entered() if row["entry"] is None else row["entry"]
                    left = entry if entry >= row["end"] > row["start"] else walk.from_(entry, found)
                    columns = [[row["path"]], [row["start"]], [entry], [left], [len(found)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 4))], ["path", "start", "entry", "exit", "n"])

        done = dealt(rows.select("path", "start", "end", "size", "types", "entry"), self.tasks).mapInArrow(run, "path string, start long, entry long, exit long, n long")
        return rows.drop("entry", "exit", "n").join(done, ["path", "start"])

    def _walked(self) -> DataFrame:
        within = Window.partitionBy("path").orderBy("start")  # a row for each range
        whole = self.described.where("size > 2 and size(types) > 0").select("path", "types")
        rows = self._passed(self.cuts.join(whole, "path").withColumn("entry", F.lit(None).cast("long")))
        while True:
            rows = stored(rows.withColumn("left", F.lag("exit", 1, 0).over(within)), "walks")
            wrong = rows.where("entry <> left")
            if wrong.isEmpty():
                break
            again = self._passed(wrong.withColumn("entry", F.col("left")))
            rows = rows.where("entry = left").unionByName(again).drop("left")
        first = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("first", first).select("path", "start", "end", "size", "types", "entry", "first").where("entry < end")

    def types(self) -> DataFrame:
        """file, type_id, length, name, format, columns of every described type."""
        return self.described.select(_file(), F.explode("types").alias("t")).select("file", "t.*")

    def errors(self) -> DataFrame:
        """file, error of the files without records that can be known."""
        error = F.when(F.col("size") < 3, "too small").when(F.size("types") == 0, "no description")
        return self.described.select(_file(), error.alias("error")).where("error is not null")

    def _decoded(self, made, schema: str, rows: DataFrame | None = None) -> DataFrame:
        """Batches that `made` (of a walk, its records and the number of the first) gives for each range."""
        before = self.before

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    walk, found = Walk(row["path"], row["start"], row["end"], row["size"], row["types"], before), []
                    walk.from_(row["entry"], found)
                    for at in range(0, len(found), ROWS):
                        yield from made(walk, row["path"], found[at : at + ROWS], row["first"] + at)

        rows = self.walked if rows is None else rows
        return dealt(rows, self.tasks).mapInArrow(run, schema).withColumn("file", _file()).drop("path")

    def records(self) -> DataFrame:
        """file, seq, offset, name, t (TimeUS where positive), fields (JSON), error: every record, and a row for each broken file."""

        def made(walk, path, found, first):
            n = len(found)
            names, times, texts = [None] * n, [None] * n, [None] * n
            for kind, where, _, columns in walk.columns(found):
                _, name, fields, _ = walk.types[kind]
                keys = [f for f, _ in fields]
                values = [c if isinstance(c, list) else c.tolist() for c in columns]
                at = max((i for i, k in enumerate(keys) if k == "TimeUS"), default=None)
                for j, i in enumerate(where.tolist()):
                    names[i], texts[i] = name, json.dumps(dict(zip(keys, (v[j] for v in values))))
                    t = values[at][j] if at is not None else None
                    times[i] = int(t) if isinstance(t, (int, float)) and 0 < t < 2**63 else None
            columns = [pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array([o for o, _ in found], pa.int64()), pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "seq", "offset", "name", "t", "fields"])

        rows = self._decoded(made, "path string, seq long, offset long, name string, t long, fields string")
        whole = rows.select("file", "seq", "offset", "name", "t", "fields", F.lit(None).cast("string").alias("error"))
        return whole.unionByName(self.errors(), allowMissingColumns=True)

    def typed(self, *names: str) -> DataFrame:
        """file, seq, offset, name and a column for each field of the types of these names, decoded without any text between.

        Whole numbers are longs (unsigned 64-bit ones decimals), floats and scaled numbers doubles; a field that
        files describe unlike one another is a double, or a string if one of them says so; absent fields are null.
        """
        kinds: dict[str, set[str]] = {}
        forms = self.types().where(F.col("name").isin(*names)).select("format", "columns").distinct()
        for form, columns in forms.collect():  # as many as there are layouts
            for column, code in zip(columns, (c for c in form if c in CODES)):
                text, real = CODES[code][-1] == "s", code in HUNDREDTHS or code in DEGREES or CODES[code] in "fd"
                kinds.setdefault(column, set()).add("string" if text else "double" if real else "decimal(20,0)" if code == "Q" else "long")
        kind = {c: next(iter(k)) if len(k) == 1 else "string" if "string" in k else "double" for c, k in kinds.items()}
        own = {"path", "seq", "offset", "name", "file"}
        label = {c: c + "_" * (c.lower() in own) for c in kind}
        arrow = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}

        def made(walk, path, found, first):
            for kind_, where, offsets, columns in walk.columns(found):
                _, name, fields, _ = walk.types[kind_]
                if name not in names:
                    continue
                have = {f: c for (f, _), c in zip(fields, columns)}
                out = [pa.array([path] * len(where)), pa.array(first + where), pa.array(offsets), pa.array([name] * len(where))]
                for column, to in kind.items():
                    values = have.get(column)
                    if values is None:
                        out.append(pa.nulls(len(where), arrow[to]))
                    elif to == "string":
                        out.append(pa.array(values if isinstance(values, list) else [str(v) for v in values.tolist()], pa.string()))
                    else:
                        out.append(pa.array(values).cast(arrow[to], safe=False))
                yield pa.RecordBatch.from_arrays(out, ["path", "seq", "offset", "name", *label.values()])

        schema = ", ".join(["path string, seq long, offset long, name string", *(f"`{label[c]}` {k}" for c, k in kind.items())])
        # files that don't describe the types have none of their records
        rows = self.walked.where(F.exists("types", lambda t: t["name"].isin(*names)))
        found = self._decoded(made, schema, rows)
        return found.select("file", *(c for c in found.columns if c != "file"))


def _file():
    return F.element_at(F.split("path", "/"), -1).alias("file")


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """`records` of a folder: file, seq, offset, name, t, fields, error."""
    return Logs(spark, folder).records()


def read_types(spark: SparkSession, folder: str) -> DataFrame:
    """file, type_id, length, name, format, columns of every described type in a folder."""
    return described(ranges(spark, folder)).select(_file(), F.explode("types").alias("t")).select("file", "t.*")


def write_logs(records: DataFrame, folder: str, types: list[tuple[int, str, str, str]]) -> None:
    """Write a file `<file>.BIN` for each value of `file`: records have file, seq, type_id and values (an array of numbers), which are written in order of seq.

    A file is one group, as it is one file. A task that runs again writes the same bytes again.
    """

    def run(key, table):
        head, body = dataflash.written(types, []), laid_out(table, types)
        system, place = located(folder)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{key[0].as_py()}.BIN") as out:
            out.write(head)
            out.write(body)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    records.groupBy("file").applyInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def laid_out(table: pa.Table, types: list[tuple[int, str, str, str]]) -> memoryview:
    """Bytes of the records of a table (seq, type_id, values) in order of seq, then type and values; all records of a type are encoded at once.

    ValueError for a type that isn't among the types or has texts, nulls, and values that its columns don't hold.
    """
    lists = table["values"].combine_chunks()
    flat = lists.flatten()
    if table["seq"].null_count or table["type_id"].null_count or lists.null_count or flat.null_count:
        raise ValueError("a record has nulls")
    seqs, kinds, values = table["seq"].to_numpy(), table["type_id"].to_numpy(), flat.to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((kinds, seqs))
    same = np.flatnonzero((np.diff(seqs[order]) == 0) & (np.diff(kinds[order]) == 0))
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:  # records alike but for their values
        part = order[run[0] : run[-1] + 2]
        order[run[0] : run[-1] + 2] = sorted(part.tolist(), key=lambda i: values[starts[i] : starts[i] + lengths[i]].tolist())
    layouts = {}
    for kind, _, form, _ in types:
        codes = [NUMPY[c] for c in form if c in CODES]
        layouts[kind] = np.dtype([("mark", "S2"), ("kind", "u1"), *((f"f{i}", code) for i, code in enumerate(codes))])
    kinds, lengths, starts = kinds[order], lengths[order], starts[order]
    sizes = np.zeros(len(kinds), np.int64)
    for kind in np.unique(kinds).tolist():
        if kind not in layouts:
            raise ValueError(f"no type {kind}")
        sizes[kinds == kind] = layouts[kind].itemsize
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for kind in np.unique(kinds).tolist():
        layout, where = layouts[kind], np.flatnonzero(kinds == kind)
        names = layout.names[2:]
        if (lengths[where] != len(names)).any():
            raise ValueError(f"type {kind} has {len(names)} values")
        rows = np.zeros(len(where), layout)
        rows["mark"], rows["kind"] = SYNC, kind
        for i, name in enumerate(names):
            column, to = values[starts[where] + i], layout[name]
            if to.kind == "S":
                raise ValueError(f"type {kind} has texts")
            if to.kind in "iu":
                column, about = np.trunc(column), np.iinfo(to)
                if not ((column >= float(about.min)) & (column < float(about.max + 1))).all():
                    raise ValueError(f"type {kind} has values beyond its columns")
            elif to.itemsize < 8 and (np.isfinite(column) & (np.abs(column) > np.finfo(to).max)).any():
                raise ValueError(f"type {kind} has values beyond its columns")
            rows[name] = column
        out[(ends[where] - layout.itemsize)[:, None] + np.arange(layout.itemsize)] = rows.view(np.uint8).reshape(len(where), -1)
    return out.data
