"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters, N-grams lie within a word: each word is led by N - 1 start marks and ended by
a stop mark, so a text's code length is the sum over its words' N-grams.  Counts of trusted N-grams
come from documents labelled good, RESERVED of every PARTS of which are kept out of the model; lower
orders count the distinct symbols before a gram, or, of a gram led by a start mark, its occurrences.
Discounts, context totals and probabilities are aggregations and joins on the gram, sharded by it; the
grams of all documents are joined to them, each once, and their costs to the documents' frequencies.
A document is kept if its log-perplexity is at most the threshold of its language: the QUANTILE of the
trusted documents of that language that the model has not seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sums import unit_counts, unit_sums

N, START, STOP = 4, "\x02", "\x03"
#: The quantile of trusted documents outside the model that is the threshold; how many of them a language has one of its own from.
QUANTILE, ENOUGH = 0.98, 50
#: Of the trusted documents, the share RESERVED / PARTS is kept out of the model.
RESERVED, PARTS = 1, 4
#: Most labelled rows whose ids are broadcast; more are joined by shuffle.
BROADCAST = 2_000_000


def split():
    return str.split


def grams(word: str) -> list[str]:
    """The N-grams of a word, one for each of its characters and the stop mark."""
    marked = START * (N - 1) + word + STOP
    return [marked[i : i + N] for i in range(len(word) + 1)]


def _discounts(counts: list[int]) -> tuple[float, float, float]:
    """Of grams seen once, twice, oftener; from the numbers of grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2 or not n3:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def costs(trusted: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (unit, n) with value: minus the natural logarithm of the probability of the gram's last symbol after the others.

    trusted: (unit, n), the counts of N-grams. Symbols never seen have the probability 1 / (symbols + 1) at order 0.
    """
    orders = {N: trusted.select(F.col("unit").alias("g"), F.col("n").alias("c"))}
    for k in range(N - 1, 0, -1):
        occurs = F.when(F.expr("substring(g, 2, 1)") == START, F.col("c")).otherwise(1)  # nothing but a start mark comes before one
        orders[k] = stored(orders[k + 1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.sum(occurs).alias("c")), f"grams{k}")
    spread = [orders[k].agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).select(F.lit(k).alias("k"), "*") for k in orders]
    found = {row.k: list(row)[1:] for row in reduce(DataFrame.unionByName, spread).collect()}  # N rows
    symbols = orders[1].count()
    out, p = wanted.select("unit", "n"), F.lit(1.0 / (symbols + 1))
    for k in range(1, N + 1):
        d1, d2, d3 = _discounts(found[k])
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = orders[k].groupBy(F.expr(f"substring(g, 1, {k - 1})").alias("h")).agg(F.sum("c").alias("t"), F.sum(taken).alias("r"))
        gram = orders[k].select(F.col("g").alias("g"), (F.col("c") - taken).alias("m"))
        out = out.withColumn("p", p).withColumn("g", F.expr(f"substring(unit, {N - k + 1})")).withColumn("h", F.expr(f"substring(unit, {N - k + 1}, {k - 1})"))
        out = out.join(gram, "g", "left").join(context, "h", "left")
        p = F.when(F.col("t").isNull(), F.col("p")).otherwise((F.coalesce("m", F.lit(0.0)) + F.col("r") * F.col("p")) / F.col("t"))
        out = out.select("unit", "n", p.alias("p"))
        p = F.col("p")
    return out.select("unit", "n", (-F.log("p")).alias("value"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, the other columns of docs but text, size (symbols) and total (their cost); trusted: texts to learn from."""
    model = stored(unit_counts(trusted, split, grams), "trusted")
    table = stored(costs(model, stored(unit_counts(docs, split, grams), "wanted")), "costs")
    return unit_sums(docs, split, grams, table, lambda text: sum(map(len, words := text.split())) + len(words), exact=False)


def reserved():
    """Whether a document is kept out of the model if it is trusted; by a hash of doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PARTS)) < RESERVED


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, trusted, n_symbols, perplexity, threshold, kept of each row of docs (doc_id, text, lang).

    trusted: labelled of quality 1 (labels: doc_id, quality). Null, empty and blank texts have no symbols,
    a null perplexity and are not kept. A language (null is one) with fewer than ENOUGH reserved trusted
    documents gets the threshold of those of all languages; without any of these everything with symbols
    is kept.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    small = good.limit(BROADCAST + 1).count() <= BROADCAST
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")).alias("lang"), "text")
    trusted = docs.join(F.broadcast(good) if small else good, "doc_id", "left_semi")
    table = perplexities(docs, trusted.where(~reserved()))
    table = table.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    table = stored(table.withColumn("x", F.when(F.col("size") > 0, F.col("total") / F.col("size"))), "perplexities")
    seen, bound = table.where("trusted and x is not null").where(reserved()), F.percentile_approx("x", quantile, F.lit(20_000))
    # a row for each language in a stored table: broadcast while it is small, by its size
    by_lang = stored(seen.groupBy("lang").agg(F.count("*").alias("n"), bound.alias("own")).where(F.col("n") >= ENOUGH).drop("n"), "thresholds")
    overall = seen.agg(bound).first()[0]
    out = table.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.col("x").isNotNull() & F.coalesce(F.col("x") <= F.col("threshold"), F.lit(True))
    lang = F.when(F.col("lang") != "null", F.expr("substring(lang, 2)")).alias("lang")
    return out.select("doc_id", lang, "trusted", F.col("size").alias("n_symbols"), F.exp("x").alias("perplexity"), F.exp("threshold").alias("threshold"), kept.alias("kept"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """quality of all documents, learnt from the folder's labels; texts without symbols aren't kept."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
