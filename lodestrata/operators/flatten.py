"""Nested events to rows (seq, path, value): typed columns by their schema, JSON text by variants, level by level."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(column: Column, kind: T.DataType, path: str) -> list[Column]:
    """Arrays of (path, value), one for each scalar below a column of a fixed shape."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(column[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        inner = F.transform(column, lambda x, i: F.flatten(F.array(*_leaves(x, kind.elementType, "")) if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else F.array(F.array(F.struct(F.lit("").alias("path"), x.cast("string").alias("value"))))))
        named = F.transform(column, lambda x, i: i)
        joined = F.flatten(F.zip_with(named, inner, lambda i, leaves: F.transform(leaves, lambda leaf: F.struct(F.concat(F.lit(f"{path}." if path else ""), i.cast("string"), F.when(leaf["path"] == "", "").otherwise(F.concat(F.lit("."), leaf["path"]))).alias("path"), leaf["value"].alias("value")))))
        return [F.coalesce(joined, F.array().cast("array<struct<path:string,value:string>>"))]
    value = F.initcap(column.cast("string")) if isinstance(kind, T.BooleanType) else column.cast("string")
    return [F.array(F.struct(F.lit(path).alias("path"), value.alias("value")))]


def flatten_columns(events: DataFrame, seq: str) -> DataFrame:
    """(seq, path, value) of every scalar of every row; explicit nulls have a row, empty arrays none.

    The paths are known from the schema, so this is one explode of an array built per row: no shuffle.
    """
    leaves = [leaf for f in events.schema.fields if f.name != seq for leaf in _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)]
    return events.select(F.col(seq).alias("seq"), F.explode(F.flatten(F.array(*leaves))).alias("leaf")).select("seq", "leaf.path", "leaf.value")


def _walk(value, path: str, found: dict[str, str | None] | None = None) -> dict[str, str | None]:
    """Text by path of every scalar; of one path the last stays."""
    found = {} if found is None else found
    if isinstance(value, dict):
        for key, inner in value.items():
            _walk(inner, f"{path}.{key}" if path else key, found)
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            _walk(inner, f"{path}.{i}" if path else str(i), found)
    else:
        found[path] = None if value is None else str(value)
    return found


def _walked(events: DataFrame) -> DataFrame:
    """(seq, path, value) of (seq, payload) by a walk of each row in Python."""

    def run(batches):
        for batch in batches:
            seqs, paths, values = [], [], []
            for number, text in zip(batch["seq"].tolist(), batch["payload"]):
                try:
                    found = _walk(json.loads(text), "")
                except (ValueError, RecursionError):
                    continue
                found.pop("", None)
                seqs += [number] * len(found)
                paths += found
                values += found.values()
            yield pd.DataFrame({"seq": pd.Series(seqs, dtype="int64"), "path": pd.Series(paths, dtype=object), "value": pd.Series(values, dtype=object)})

    return events.mapInPandas(run, "seq long, path string, value string")


#: What has another text as a variant than in Python: exponents, -0, more digits than a double or a long surely keeps, numbers near 0.
UNLIKE = r"[0-9][eE]|-0(?:\.0*)?(?![0-9.])|[0-9.]{17,}|(?<![0-9])0\.0000"
#: Keys without a letter or with a dot (the strings emptied but for it), whose paths may be those of other keys.
EMPTY, DOTTED = r'""\s*:', r'"\."\s*:'
#: Other texts have no paths; and those from one bracket to another, with nothing around them.
OPENED, CLOSED = r"^[ \t\n\r]*[\[{]", r"[\]}][ \t\n\r]*\z"
#: Levels that are counted; Spark parses 1,000. So many, which most texts have at most, without a loop.
LEVELS, FEW = 1000, 5


def _once(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used: a filter computes its parts wherever they stand."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _pairs(brackets: Column) -> Column:
    """Brackets without the innermost pairs: what is balanced loses its lowest level, and nothing is left after as many as it has."""
    return F.replace(brackets, F.lit("()"), F.lit(""))


def _plain(payload: Column, inner) -> Column:
    """inner(brackets within the outer ones) of a text whose values and paths a variant tells, null of others.

    A value that ends before the text does leaves brackets within that aren't balanced, or no bracket at the end.
    """

    def emptied(bare: Column) -> Column:
        brackets = F.translate(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "[{]}", "(())")
        numbers = F.regexp_replace(bare, "[^-.0-9eE]+", " ")
        dotted = F.contains(bare, F.lit('"."')) & bare.rlike(DOTTED)
        return F.when(bare.rlike(CLOSED) & ~dotted & ~numbers.rlike(UNLIKE), inner(F.substring(brackets, F.lit(2), F.length(brackets) - 2)))

    def escaped(plain: Column) -> Column:
        empty = F.contains(plain, F.lit('""')) & plain.rlike(EMPTY)
        return F.when(~empty, _once(F.regexp_replace(plain, r'"[^".]*+(\.?+)[^"]*+"', '"$1"'), emptied))

    # a run of backslashes is taken in pairs from its start; no other escape has a quote
    plain = F.replace(F.replace(payload, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    return F.when(~F.contains(payload, F.lit("\\u00")), _once(plain, escaped))


def _depth(brackets: Column, levels: int = 1) -> Column:
    """Levels of a text by the brackets within its outer ones; null if they aren't balanced, or too deep for Spark."""
    if levels <= FEW:
        return F.when(brackets == "", levels).otherwise(_once(_pairs(brackets), lambda left: _depth(left, levels + 1)))

    def step(s, _):
        return F.when(s["left"] == "", s).otherwise(F.struct(_pairs(s["left"]).alias("left"), (s["levels"] + 1).alias("levels")))

    most = F.least(F.floor(F.length(brackets) / 2).cast("int"), F.lit(LEVELS))
    return F.aggregate(F.sequence(F.lit(0), most), F.struct(brackets.alias("left"), F.lit(levels).alias("levels")), step, lambda s: F.when(s["left"] == "", s["levels"]))


def flatten_json(events: DataFrame, seq: str, payload: str, depth: int | None = None) -> DataFrame:
    """(seq, path, value) of every scalar in JSON text; of paths that collide the last wins, empty objects, broken and null texts have no rows.

    Texts are parsed into variants, of which a level is exploded after another in one stage without a shuffle. Rows
    with number forms that variants don't keep, keys that can collide, or that are no JSON for Spark, are walked in
    Python; if there are none, the plan has no Python. depth: levels that are exploded, deeper rows go to
    Python; None measures the levels, and whether Python is needed, by a pass over the texts (not for a stream).
    """
    rows = events.select(F.col(seq).cast("long").alias("seq"), F.col(payload).alias("payload"))
    given, variant = F.col("payload"), F.try_parse_json("payload")
    opened = given.rlike(OPENED)
    levels, odd, refused = depth, True, True
    if depth is None:
        # levels of a row, 0 where Spark doesn't parse it, -1 where its text tells already
        kind = _once(F.coalesce(_plain(given, _depth), F.lit(-1)), lambda n: F.when(n < 0, n).when(variant.isNotNull(), n).otherwise(0))
        kinds = rows.select(F.when(opened, kind).alias("levels"))
        levels, odd, refused = kinds.agg(F.max("levels"), F.count_if(F.col("levels") < 1) > 0, F.count_if(F.col("levels") == 0) > 0).first()
        levels = max(levels or 0, 0)
    here = F.coalesce(_plain(given, lambda inner: reduce(lambda c, _: _pairs(c), range(levels - 1), inner) == ""), F.lit(False)) if levels else F.lit(False)
    # rows are chosen without filters, which would be moved below what the texts are made by and make them again; other rows have a null, which has no path
    found = rows.select("seq", F.when(opened & here, variant).alias("v"), F.lit("").alias("path"))
    below = """SELECT seq, CASE WHEN e.pos IS NULL THEN d.v ELSE e.value END v,
        CASE WHEN e.pos IS NULL THEN path ELSE concat(path, if(path = '', '', '.'), coalesce(e.key, cast(e.pos AS string))) END path
        FROM {d} d, LATERAL variant_explode_outer(d.v) e"""
    for _ in range(levels):
        found = events.sparkSession.sql(below, d=found)
    # empty objects and arrays are left as such
    text = found.select("seq", "path", "v", F.to_json("v").alias("j")).where("path <> '' and j not in ('{}', '[]')")
    number = F.when(F.schema_of_variant("v") == "BIGINT", F.col("j")).when(F.contains("j", F.lit(".")), F.col("j")).otherwise(F.concat("j", F.lit(".0")))
    value = F.when(F.startswith("j", F.lit('"')), F.col("v").cast("string")).when(F.col("j").isin("true", "false"), F.initcap("j")).when(F.col("j") != "null", number)
    out = text.select("seq", "path", value.alias("value"))
    rest = ~here | variant.isNull() if refused else ~here
    return out.unionByName(_walked(rows.select("seq", F.explode(F.when(opened & rest, F.array(given))).alias("payload")))) if odd else out


def field_counts(leaves: DataFrame, events: DataFrame, seq: str) -> DataFrame:
    """path, sample_count, null_count, unique_count: a path counts from the event that first has it on.

    Events before that one are not counted as nulls, later ones without the path are. The places where
    paths come first, one for each path of the schema at most, cut the events into ranges; events are
    counted by range (a binary search for each), so nothing is sorted or paired with the paths.
    """
    first = leaves.groupBy("path").agg(F.min("seq").alias("first"), F.count("*").alias("present"), F.count("value").alias("filled"), F.countDistinct("value").alias("unique_count"))
    marks = sorted(r["first"] for r in first.select("first").distinct().collect())
    cut = Bucketizer(splits=[float("-inf"), *map(float, marks), float("inf")], inputCol="_at", outputCol="_k", handleInvalid="skip")
    counts = {int(r["_k"]): r["n"] for r in cut.transform(events.select(F.col(seq).cast("double").alias("_at"))).groupBy("_k").agg(F.count("*").alias("n")).collect()} if marks else {}
    # events with i marks passed at most come before mark i
    later = [(m, sum(n for k, n in counts.items() if k > i)) for i, m in enumerate(marks)]
    rank = events.sparkSession.createDataFrame(later, "first long, n long")
    out = first.join(F.broadcast(rank), "first")
    return out.select("path", F.col("n").alias("sample_count"), (F.col("n") - F.col("filled")).alias("null_count"), "unique_count")
