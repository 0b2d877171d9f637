import hashlib
import math
import random
import struct

from pyspark.sql import functions as F

from lodestrata.functions.numbers import shortest
from lodestrata.operators import checks


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(4)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(60_000)]
    values += [rng.uniform(-1, 1) for _ in range(20_000)] + [rng.randrange(10**6) / rng.choice([1, 2, 7, 10, 1000]) for _ in range(20_000)] + [rng.lognormvariate(0, 20) for _ in range(10_000)] + [rng.uniform(1, 10) * 10 ** rng.randrange(15, 31) for _ in range(30_000)]
    values += [0.0, -0.0, math.inf, -math.inf, math.nan, None, 1e16, 9999999999999998.0, 1e15, 1e-4, 1e-5, 9.999e-5, 2e23, 1e23, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**-44, 0.1 + 0.2, 100.0, 1e7, 1.0e-3, 2.0e-3, 123456789.0, 9007199254740993.0, 1e22, 8.41e21]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", shortest(F.col("v")).alias("t")).collect()
    wrong = [(r.v, r.t) for r in got if (r.t != repr(r.v) if r.v is not None else r.t is not None)]
    assert not wrong, (len(wrong), wrong[:10])


def test_vector_ids_are_of_the_text_in_python(spark):
    vector = [0.0, 1.0, 0.1, 1e-05, 1 / 3, 1e16, -2.5]
    df = spark.createDataFrame([("s", "a.b", vector)], "s string, p string, v array<double>")
    want = hashlib.sha256(f"s:a.b:{vector!r}".encode()).hexdigest()[:16]
    assert df.select(checks.vector_id("s", "p", "v").alias("id")).first().id == want
