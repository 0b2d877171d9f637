"""Whitening of embeddings: scores of vectors on unit-variance principal components of the corpus.

Entries become whole numbers, equal vectors are one row, and one aggregation of generated SQL expressions sums
the centred product of every pair of dimensions (the upper triangle). The covariance, as large as the
square of the dimensions whatever the number of rows, is decomposed by LAPACK; the scores are again
generated SQL over every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Pairs of dimensions whose sums are columns of one row: an expression each for the 2,080 pairs of 64 dimensions
#: in a row of their own is beyond what Spark compiles, so the row of dimension i holds WIDTH others.
WIDTH = 32
#: Entries reach this far from 0 at most, so that whole numbers fit a long; a part of the variance under which a component has none.
FAR, NONE = 2.0**54, 1e-13


@dataclass
class Whitening:
    """n fitted vectors, their sums by dimension (exact) and largest absolute entry, eigenvalues by falling size, unit eigenvectors (columns) and the trace."""

    n: int
    sums: list[int]
    top: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]  # of whole numbers of any size, rounded once


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry as a long; null where the vector is null or an entry is null, not finite or beyond a long."""
    entry = F.transform(embedding, lambda c: c.cast("double") * F.lit(float(scale)))
    whole = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < F.lit(FAR)))  # NaN is larger than any number
    return F.when(whole, F.transform(entry, lambda c: F.floor(c)))


def vectors(df: DataFrame, embedding: str, scale: int = 256) -> tuple[DataFrame, DataFrame, int]:
    """The rows of df with x, their quantised vector; the fit list, each distinct x once, stored; the dimensions.

    Rows without a vector are left out, as are those of another length than the commonest one (of ties,
    the longest); empty vectors too.
    """
    rows = df.withColumn("x", quantised(F.col(embedding), scale)).where("size(x) > 0")
    fit = stored(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")  # copies combine before the shuffle
    found = fit.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = found[0]["d"] if found else 0
    return rows.where(F.size("x") == d), fit.where(F.size("x") == d), d


def products(fit: DataFrame, means: list[float]) -> DataFrame:
    """i, block, s0, s1 ..: sums over the rows of centred x[i] times centred x[WIDTH * block + k] (null beyond the last dimension)."""
    d = len(means)
    blocks = [f"struct({i} as i, {b} as block)" for i in range(d) for b in range(i // WIDTH, -(-d // WIDTH))]
    centred = fit.selectExpr(f"array({', '.join(f'x[{i}] - {m!r}D' for i, m in enumerate(means))}) as c", f"array({', '.join(blocks)}) as blocks")
    rows = centred.selectExpr("c", "inline(blocks)")
    return rows.groupBy("i", "block").agg(*(F.expr(f"sum(c[i] * get(c, block * {WIDTH} + {k}))").alias(f"s{k}") for k in range(WIDTH)))


def fitted(fit: DataFrame, d: int) -> Whitening | None:
    """Covariance of the fit list's x (divisor n, centred before multiplying) and its eigenvectors; None without rows."""
    n, top = fit.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    if not n:
        return None
    kind = "bigint" if n * top < 2**62 else "decimal(38,0)"
    sums = [int(s) for s in fit.selectExpr(*(f"sum(cast(x[{i}] as {kind}))" for i in range(d))).first()]
    covariance = np.zeros((d, d))
    for r in products(fit, [total / n for total in sums]).collect():  # as many rows as d * d / WIDTH
        for k in range(min(WIDTH, d - WIDTH * r["block"])):
            i, j = r["i"], WIDTH * r["block"] + k
            if i <= j:
                covariance[i, j] = covariance[j, i] = r[f"s{k}"] / n
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, found = np.maximum(values[order], 0.0), found[:, order]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(d)])  # the entry of largest size is positive
    return Whitening(n, sums, top, values, found, float(np.trace(covariance)))


def scores(model: Whitening, k: int) -> list[Column]:
    """Columns with the whitened score of x on each of the first k components; 0 on a component without variance."""
    out = []
    for j in range(min(k, len(model.sums))):
        if model.values[j] <= NONE * model.trace:
            out.append(F.lit(0.0))
        else:
            weights = model.vectors[:, j] / np.sqrt(model.values[j])
            out.append(F.expr(" + ".join(f"(x[{i}] - {m!r}D) * {float(w)!r}D" for i, (m, w) in enumerate(zip(model.means, weights)))))
    return out


def deviation(model: Whitening) -> Column:
    """Sum over the dimensions of (n * x - sum) squared, exact; null where it is beyond a long."""
    small = len(model.sums) * (2 * model.n * model.top) ** 2 < 2**62
    kind = "bigint" if small else "decimal(38,0)"
    parts = [f"(cast(x[{i}] as {kind}) * {model.n} - {s})" for i, s in enumerate(model.sums)]
    if small:
        return F.expr(" + ".join(f"{p} * {p}" for p in parts))
    squares = ", ".join(f"try_cast({p} as decimal(38,0))" for p in parts)
    bound = f"cast({2**63 - 1} as decimal(38,0))"
    # a part beyond 2^32 alone makes the sum too large, so squares are taken of smaller ones only
    squared = f"case when abs(v) < 4294967296 then cast(v as decimal(19,0)) * cast(v as decimal(19,0)) end"
    total = f"aggregate(array({squares}), cast(0 as decimal(38,0)), (a, v) -> cast(a + {squared} as decimal(38,0)))"
    return F.expr(f"case when {total} <= {bound} then cast({total} as bigint) end")


def identity_error(fit: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the covariance of the fit list's first k scores, less the identity."""
    columns = scores(model, k)
    table = fit.select(*(c.alias(f"w{j}") for j, c in enumerate(columns)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = table.selectExpr(*(f"covar_pop(w{i}, w{j})" for i, j in pairs)).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))


def whitened(df: DataFrame, id: str, embedding: str, components: int = 4, scale: int = 256) -> DataFrame:
    """`id`, component (from 1), n, deviation, whitened, explained, identity_error of every row of df with a whole vector.

    Rows whose vector is null or empty, or has null or non-finite entries, or has another length than most, are
    left out; a null id is carried through; repeated rows have repeated results but count once in the fit.
    There are as many components as dimensions at most. A component without variance (equal vectors only)
    has scores and a share of 0, which shows in identity_error as 1. Without rows there is no result.
    """
    rows, fit, d = vectors(df.select(F.col(id).alias("id"), F.col(embedding).alias("embedding")), "embedding", scale)
    model = fitted(fit, d) if d else None
    if model is None:
        schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema).withColumn("id", F.col("id").cast(df.schema[id].dataType)).withColumnRenamed("id", id)
    share = model.values / model.trace if model.trace > 0 else model.values * 0
    error = identity_error(fit, model, components)
    each = [
        F.struct(F.lit(j + 1).alias("component"), score.alias("whitened"), F.lit(float(share[j])).alias("explained"))
        for j, score in enumerate(scores(model, components))
    ]
    out = rows.select("id", deviation(model).alias("deviation"), F.explode(F.array(*each)).alias("s"))
    return out.select(
        F.col("id").alias(id), "s.component", F.lit(model.n).cast("long").alias("n"), "deviation",
        "s.whitened", "s.explained", F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """whitened of all embeddings: scores on the first four components of the distinct vectors' covariance.

    Vectors with null or non-finite entries have no rows; other cases as in `whitened`.
    """
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
