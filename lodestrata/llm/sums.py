"""Sums over the units of documents of values from a table, where the table is too large to broadcast.

Units frequent in the corpus, up to a bound on their number, are joined by broadcast inside the scan;
every other (document, unit, frequency) row goes through a shuffle join on the unit.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, stored

#: Distinct units, and characters of texts, that one Python worker counts before it passes their counts on.
FLUSH, CHARACTERS = 300_000, 1 << 26
#: Most units that are broadcast; frequency up to which frequencies are told apart exactly, beyond it by steps of a hundredth.
HOT, EXACT = 600_000, 10_000


def unit_counts(docs: DataFrame, split: Callable[[], Callable[[str], Iterable[str]]], units: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(unit, n): how often each unit comes in all texts.

    split: makes, in a worker, the function from a text to its words; units: from a word to its units (itself, if None).
    """

    def run(batches):
        words, seen, size = split(), Counter(), 0

        def counted():
            found = seen
            if units is not None:
                found = Counter()
                for word, n in seen.items():
                    for unit in units(word):
                        found[unit] += n
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["unit", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(words(text or ""))
                size += len(text or "")
                if len(seen) > FLUSH or size > CHARACTERS:
                    yield counted()
                    seen.clear()
                    size = 0
        yield counted()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


#: The broadcast table that this worker used last.
KNOWN: dict = {}


def values(key: str, table) -> dict:
    """The broadcast values by unit, made once in a worker."""
    if key not in KNOWN:
        KNOWN.clear()
        KNOWN[key] = dict(zip(table.value.column("unit").to_pylist(), table.value.column("value").to_pylist()))
    return KNOWN[key]


def level(exact: int = EXACT):
    """A whole number that rises with the frequency n: n itself up to `exact`, then one for each hundredth more."""
    return F.when(F.col("n") <= exact, F.col("n")).otherwise(exact + 1 + F.floor(F.log(F.greatest("n", F.lit(exact)) / F.lit(float(exact))) / F.log(F.lit(1.01))))


def commonest(table: DataFrame, hot: int, exact: int = EXACT) -> int:
    """The least level at which no more than `hot` units of table (unit, n) remain; beyond all levels if the highest alone has more."""
    least, total = 1 << 60, 0
    for n, count in table.groupBy(level(exact).alias("l")).count().orderBy(F.desc("l")).collect():  # a row for each level
        total += count
        if total > hot:
            break
        least = n
    return least


def unit_sums(docs: DataFrame, split, units, table: DataFrame, size: Callable[[str], int], hot: int = HOT, exact: bool = True) -> DataFrame:
    """doc_id, the other columns of docs but text, size (of the text) and total: the sum over the text's units of frequency times value.

    table: (unit, n, value) of all units, n being the frequency in the corpus; exact: values are whole
    numbers. At most `hot` units, the commonest, are broadcast.
    """
    spark = docs.sparkSession
    kind, arrow = ("long", pa.int64()) if exact else ("double", pa.float64())
    least = commonest(table, hot)
    key, known = uuid.uuid4().hex, spark.sparkContext.broadcast(table.where(level() >= least).select("unit", "value").toArrow())
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    names = ["row", "doc_id", *(f.name for f in others), "size", "unit", "total", "n"]
    schema = ", ".join(["row long", "doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in others), "size long", "unit string", f"total {kind}", "n long"])

    def run(batches):
        """A row without unit for each document, with the sum over its frequent units; a row for each of its other units."""
        from pyspark import TaskContext

        have, row = values(key, known), TaskContext.get().partitionId() << 40

        def valued(word):
            found = [word] if units is None else units(word)
            values = [have.get(unit) for unit in found]
            return sum(v for v in values if v is not None), tuple(unit for unit, v in zip(found, values) if v is None)

        words, memo = split(), Memo(valued, 400_000)
        for batch in batches:
            base, rest = [], []
            for text in batch.column("text").to_pylist():
                row += 1
                text, total, cold = text or "", 0, Counter()
                for word in words(text):
                    value, missing = memo[word]
                    total += value
                    if missing:
                        cold.update(missing)
                base.append((row, len(rest), size(text), total))
                rest += [(row, unit, n) for unit, n in cold.items()]
            nulls = [None] * len(rest)
            columns = list(zip(*base)) if base else [()] * 4
            empty = [None] * len(base)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(batch.column(c) for c in names[1 : 2 + len(others)]), pa.array(columns[2], pa.int64()), pa.array(empty, pa.string()), pa.array(columns[3], arrow), pa.array(empty, pa.int64())], names)
            if rest:
                ids, missing, ns = zip(*rest)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(nulls, batch.column(c).type) for c in names[1 : 2 + len(others)]), pa.array(nulls, pa.int64()), pa.array(missing, pa.string()), pa.array(nulls, arrow), pa.array(ns, pa.int64())], names)

    rows = stored(docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", *(f.name for f in others), "text").mapInArrow(run, schema), "frequencies")
    joined = rows.where("unit is not null").select("row", "unit", "n").join(table.where(level() < least).select("unit", "value"), "unit")
    joined = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("_rest"))
    whole = rows.where("unit is null").drop("unit", "n").join(joined, "row", "left")
    return whole.withColumn("total", F.col("total") + F.coalesce("_rest", F.lit(0).cast(kind))).drop("row", "_rest")
