import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.operators import flatten

TEXT = st.text(st.sampled_from(['a', 'B', '"', '\\', '.', ' ', '{', ']', 'é', '😀', '\n', '0', 'e', '1', '-', ':', ',', '/']), max_size=6)
NUMBERS = st.one_of(st.integers(-10**20, 10**20), st.integers(-9, 9), st.floats(allow_nan=True), st.sampled_from([1.0, -0.0, 0.0, 0.1, 1.5, 100.25, 1e-4, 0.00012, 1e5, 123456789.125, 1e16, 2.5e-7]))
VALUES = st.recursive(st.one_of(st.none(), st.booleans(), NUMBERS, TEXT), lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(TEXT, v, max_size=3)), max_leaves=8)
RAW = ['{"a": 1} x', '{"a": 1}{}', '[1][2]', '{"a": 1} "]"', '{"a": {"b": 1}}}', '5 6', '{"a": 1}{', '{"a": 1, "a": {"b": 2}}', '{"a.b": 1, "a": {"b": 2}}', '{"a": {"b": 2}, "a.b": 1}', '{"": 1, "a": {"": 2}}', "[]", "{}", "5", '"x"', "null", "", " ", "[1.50, -0, -0.0, 1e5, 01]", "[1.50, -0, -0.0, 1E5, 10.0, 0.00001]",
       "[NaN, Infinity]", '{"a": "\n"}', '{"a": "\\u002e", "\\u002eb": 1}', '["1e5", "-0", "a.b", "12345678901234567890", "{", "]"]', "[12345678901234567890123456789012345678901234567890, 0.1234567890123456789]", '{"a":[{"b":[[1,[]],{"c":{}}]}]}', '﻿{"a":1}', "[1,]", "{'a':1}", '[true, false, null, "true", "null"]', "[" * 40 + "1" + "]" * 40]


def walked(text):
    try:
        return {p: v for p, v in dict(flatten._walk(json.loads(text), "")).items() if p}
    except ValueError:
        return {}


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "n long, text string")
    got = {}
    for r in flatten.flatten_json(df, "n", "text", **options).collect():
        assert (r.seq, r.path) not in got
        got[r.seq, r.path] = r.value
    assert got == {(i, p): v for i, t in enumerate(texts) for p, v in walked(t).items()}


def test_texts_of_all_kinds(spark):
    check(spark, RAW)
    for depth in (0, 1, 3):
        check(spark, RAW, depth=depth)


@settings(max_examples=6, deadline=None)
@given(st.lists(VALUES, min_size=150, max_size=300), st.booleans())
def test_as_a_walk_in_python(spark, values, ascii):
    check(spark, [json.dumps(v, ensure_ascii=ascii) for v in values])


def test_plain_texts_stay_in_the_jvm(spark):
    plain = [json.dumps({"a": i, "b": {"c": [i / 4, True, None, {"d": "x.y 1e5"}]}, "e": {}, "f": "-0"}) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(plain)), "n long, text string")
    plan = flatten.flatten_json(df, "n", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan and plan.count("variant_explode") == 4
    odd = df.union(spark.createDataFrame([(99, "[1e5]")], "n long, text string"))
    assert "MapInPandas" in flatten.flatten_json(odd, "n", "text")._jdf.queryExecution().executedPlan().toString()
    assert flatten.flatten_json(df.limit(0), "n", "text").count() == 0


def test_ends_of_texts(spark):
    check(spark, ['{"a": 1}\x0b', '{"a": 1}\u2028', '{"a": 1}\x85', '{"a": 1}\n\n', " \t\r\n[1] ", "[1]], [[2]", "[[1]", "[1]]", '{"a": {"b": 1}', "[x}", "[1}", "{}[1]", "[[[[[[[1]]]]]], 2]", '{"a": "]"}', '{"a": "\\\\"}'])


def test_texts_are_made_once_for_each_branch(spark):
    made = lambda number: spark.range(9).select("id", F.format_string('{"a": %s, "b": [{"c": "x"}]}', number).alias("text"))
    plan = lambda df: flatten.flatten_json(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan(made(F.col("id"))).count("format_string") == 1
    assert plan(made(F.when(F.col("id") > 4, "1e5").otherwise("1"))).count("format_string") == 2
