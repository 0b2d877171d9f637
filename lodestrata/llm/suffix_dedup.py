"""Repeated passages by a sparse suffix array.

Every window of WINDOW words holds one anchor: the position, among those at which K words of the window
start, whose hash is least.  Only suffixes at anchors are kept.  They are sorted over the whole corpus and
compared with their neighbours; where K words agree, both are extended left and right to all windows
that have them as anchor, and these windows, sorted and compared with their neighbours in turn, are the
repeats: a window repeats if an equal one comes before it, in order of doc_id and position.  Equal
windows have their anchors at the same place, so no repeat is missed; hashes of two unlike functions
must agree for one to be found.

Sorting is by range on (hash, doc_id, position), so that a passage shared by very many documents is
spread over tasks; of each range, only its first and last row are looked at outside its task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .shingles import GOLDEN, mixed, word_hash

#: Words of a passage that count as a repeat; words by which suffixes are sorted.
WINDOW, K = 50, 25


def hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` as they are written."""
    words = (text or "").encode().split()
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all k consecutive words."""
    n = len(h) - k + 1
    word = mixed(h + mixed(np.full(1, seed, np.uint64)))
    total = word[:n]
    for i in range(1, k):
        total = total * GOLDEN + word[i : n + i]
    return mixed(total)


def anchors(h: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at least `window` words: hash and position of each anchor, first window and number of windows that have it."""
    gram = grams(h, k, 1)
    at = np.lib.stride_tricks.sliding_window_view(gram, window - k + 1).argmin(axis=1) + np.arange(len(h) - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return gram[at[first]], at[first], first, np.diff(np.append(first, len(at)))


def windows(h: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """Hashes of all windows, by another function than that of the anchors."""
    half = grams(h, k, 2)
    n = len(h) - window + 1
    return mixed(mixed(half[:n]) * GOLDEN + half[window - k : window - k + n] + np.uint64(window))


def _anchored(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            digests, sizes, columns = [], [], ([], [], [])
            for text in batch.column("text").to_pylist():
                h = hashes(text)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                if len(h) >= window:
                    gram, _, first, count = anchors(h, window, k)
                else:
                    gram, first, count = (np.zeros(0, np.int64),) * 3
                for column, value in zip(columns, (gram.view(np.int64), first.astype(np.int32), count.astype(np.int32))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32())))],
                ["doc_id", "digest", "n_words", "gram", "first", "count"],
            )

    return docs.mapInArrow(run, "doc_id long, digest binary, n_words long, gram array<long>, first array<int>, count array<int>")


def _sorted_neighbours(rows: DataFrame, key: str) -> DataFrame:
    """Rows in ranges of (key, doc_id, at), with _before and _after: whether the neighbours have the same key (null at the edge of a range), and the doc_id before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, key, "doc_id", "at").sortWithinPartitions(key, "doc_id", "at")
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _part int, _before boolean, _after boolean, _doc_before long"

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        # the last row of a batch waits for the first of the next

        def flagged(table, before, doc_before, after):
            keys, docs = table.column(key).to_numpy(), table.column("doc_id").to_numpy()
            same = keys[1:] == keys[:-1]
            columns = [pa.array(np.full(len(keys), part, np.int32)), pa.array([before, *same.tolist()], pa.bool_()), pa.array([*same.tolist(), after], pa.bool_()), pa.array([doc_before, *docs[:-1].tolist()], pa.int64())]
            return pa.RecordBatch.from_arrays([*table.columns, *columns], [*names, "_part", "_before", "_after", "_doc_before"])

        last = None  # key and doc_id of the last row passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
            if len(table) > 1:
                body, held = table.slice(0, len(table) - 1), table.slice(len(table) - 1)
                first, next_ = body.column(key)[0].as_py(), held.column(key)[0].as_py()
                end = body.column(key)[len(body) - 1].as_py()
                yield flagged(body, None if last is None else last[0] == first, None if last is None else last[1], end == next_)
                last = end, body.column("doc_id")[len(body) - 1].as_py()
            else:
                held = table
        if held is not None:
            first = held.column(key)[0].as_py()
            yield flagged(held, None if last is None else last[0] == first, None if last is None else last[1], None)

    return ranged.mapInArrow(run, schema)


def _numbered(docs: DataFrame, by: str, row: str = "_row") -> DataFrame | None:
    """docs with numbers `row`, in order of `by` (null last) and a hash of the text, where rows share a value of `by`; None where none do."""
    if docs.where(F.col(by).isNotNull()).groupBy(by).count().where("count > 1").isEmpty():
        return None
    return stored(docs.orderBy(F.col(by).asc_nulls_last(), F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id()), "rows")


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, start_word, end_word, n_words, source_id: the spans of words covered by repeated windows.

    Words from start_word up to end_word (not included) of the text lie in windows of `window` words of
    which an equal one comes before, in order of doc_id and position; touching windows are one span.
    source_id: the document of the occurrence before the span's first window.  Texts of fewer words, null
    and empty ones have no spans; rows without doc_id are left out; rows that share one are documents of
    their own, in order of a hash of their texts (equal rows: one is the first), with spans under the same doc_id.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    rows = _numbered(docs, "doc_id")
    if rows is None:
        return _repeats(docs, window, k)
    spans = _repeats(rows.select(F.col("_row").alias("doc_id"), "text"), window, k)
    ids = rows.select("_row", F.col("doc_id").alias("_id"))
    named = spans.join(ids, F.col("doc_id") == F.col("_row")).withColumn("doc_id", F.col("_id")).drop("_row", "_id")
    return named.join(ids, F.col("source_id") == F.col("_row")).withColumn("source_id", F.col("_id")).drop("_row", "_id")


def _repeats(docs: DataFrame, window: int, k: int) -> DataFrame:
    """`repeats` of rows of which each has a doc_id of its own."""
    table = stored(_anchored(docs, window, k), "anchors")
    # texts of the same words are looked at once; all but the first are repeats as a whole
    kept = stored(table.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("source_id")), "texts")
    same = table.where(F.col("n_words") >= window).select("doc_id", "digest", "n_words").join(kept, "digest").where("doc_id <> source_id")
    copies = same.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.min("source_id").alias("source_id")).select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), "n_words", "source_id")
    only = table.join(kept.withColumnRenamed("source_id", "doc_id"), ["doc_id", "digest"], "left_semi")
    each = only.select("doc_id", F.explode(F.arrays_zip("gram", "first", "count")).alias("a")).select("doc_id", F.col("a.gram").alias("gram"), F.col("a.first").cast("long").alias("at"), F.col("a.count").alias("count"))
    suffixes = _sorted_neighbours(each, "gram").where("coalesce(_before, true) or coalesce(_after, true)")
    found = suffixes.groupBy("doc_id").agg(F.collect_list(F.struct("at", "count")).alias("runs"))

    def extended(batches):
        for batch in batches:
            ids, ats, keys = [], [], []
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                h = hashes(text)
                at = np.concatenate([np.arange(run["at"], run["at"] + run["count"]) for run in runs])
                at = np.sort(at[at <= len(h) - window])
                if len(at):
                    ids.append(np.full(len(at), doc_id)), ats.append(at), keys.append(windows(h, window, k)[at].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, ids, ats)], ["key", "doc_id", "at"])

    every = stored(docs.join(found, "doc_id").mapInArrow(extended, "key long, doc_id long, at long"), "windows")
    marked = stored(_sorted_neighbours(every, "key").where("coalesce(_before, true) or _after is null"), "repeats")
    # the first row of a range repeats if the last one of the range before it (some are empty) has its key
    edges = marked.where("_before is null or _after is null").select("_part", "_before", "_after", "key", "doc_id", "at").orderBy("_part", "key", "doc_id", "at").collect()
    first, end = [], None
    for row in edges:  # two for each range at most
        if row._before is None and end is not None and end.key == row.key and (end.doc_id, end.at) != (row.doc_id, row.at):
            first.append((row.doc_id, row.at, end.doc_id))
        if row._after is None:
            end = row
    inner = marked.where("_before").select("doc_id", "at", F.col("_doc_before").alias("source_id"))
    edge = docs.sparkSession.createDataFrame(first, "doc_id long, at long, source_id long")
    starts = inner.unionByName(edge).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "source_id"))).alias("starts"))

    def joined(batches):
        for batch in batches:
            rows = []
            for doc_id, starts in zip(batch.column("doc_id").to_pylist(), batch.column("starts").to_pylist()):
                begin, end, source = None, None, None
                for x in starts:
                    if end is not None and x["at"] <= end:
                        end = x["at"] + window
                        continue
                    if end is not None:
                        rows.append((doc_id, begin, end, end - begin, source))
                    begin, end, source = x["at"], x["at"] + window, x["source_id"]
                rows.append((doc_id, begin, end, end - begin, source))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["doc_id", "start_word", "end_word", "n_words", "source_id"])

    return starts.mapInArrow(joined, "doc_id long, start_word long, end_word long, n_words long, source_id long").unionByName(copies)


FOUND = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of `spans` and the blanks behind them."""
    starts = [m.start() for m in FOUND.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : starts[min(start, len(starts) - 1)]])
        at = starts[min(end, len(starts) - 1)]
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, window: int = WINDOW, by: str | None = None) -> DataFrame:
    """docs with repeated passages cut out of `text`, of which the first occurrence stays.

    The order is that of doc_id, and of a hash of the text among rows that share one: each row is cut by itself, and of
    equal rows one stays whole. by: a column that numbers the rows and gives the order instead. All rows
    and columns are kept, n_chars follows the text; rows without a number stay as they are.
    """
    if by is None:
        by, row = "doc_id", fresh(docs, "_row")
        rows = _numbered(docs, by, row)
        if rows is not None:
            lone = rows.withColumn(row, F.when(F.col(by).isNotNull(), F.col(row)))
            return without_repeats(lone, window, row).select(*docs.columns)
    key, found = fresh(docs, "_key"), fresh(docs, "_spans")
    numbers = docs.select(F.col(by).cast("long").alias("doc_id"), "text").where("doc_id is not null")
    spans = _repeats(numbers, window, K)
    spans = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(found))

    @F.pandas_udf("string")
    def cleaned(texts, spans):
        return texts.combine(spans, lambda text, found: text if text is None or found is None or len(found) == 0 else cut(text, [(x["start_word"], x["end_word"]) for x in found]))

    joined = docs.join(spans, F.col(by) == F.col(key), "left")
    joined = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(cleaned("text", found)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return joined.select(*docs.columns)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """repeats in all documents: spans of words that an earlier document or place holds; rows without doc_id are left out."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
