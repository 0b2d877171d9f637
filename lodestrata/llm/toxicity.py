"""Toxicity by cumulative-link ordinal regression.

P(grade > k) is the logistic function of w.x - theta_k with one w for all of the ordered thresholds
theta_1 < theta_2 < ..; the expected severity is the sum of these probabilities.  x is sparse: words
of the text and beginnings of words (4 to 6 letters, so that one weight serves all forms of a stem)
that go with the toxic label, each as one plus the logarithm of its frequency, and the logarithm of
the number of words.

Labels say toxic or not.  Grades come from them and from the words: 0 for a document labelled clean;
toxic ones get 1 to GRADES by how much they hold of the words that are much commoner under the
label (equal parts of the toxic documents, by the sum of those words' features).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, dropped, stored

#: Most labelled rows that are learnt from; most words and beginnings with a weight of their own; grades above 0.
SAMPLE, FEATURES, GRADES = 20_000, 2_000, 3
#: Documents that a word is in at least; steps of the fit; weight of the squared norm.
LEAST, STEPS, RIDGE = 3, 400, 1e-4
#: Rows that a step of the fit takes at a time.
ROWS = 4_000
#: Likelihood ratio statistic of a word with the label for a weight (chance 1 in 2,000) and for marking a toxic text (1 in 10 million).
WEIGHED, MARKED = 12.0, 28.0

#: Chance of a grade above 0 from which a text is taken for toxic.
CUT = 0.4

WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """The word and its proper beginnings of 4 to 6 letters, which end in a hyphen."""
    return [word, *(word[:n] + "-" for n in range(4, min(7, len(word))))]


def hits(found: list[str], known: Memo) -> Counter:
    """Frequency of each feature, by its number; known: numbers of the features with a weight of a word."""
    out: Counter = Counter()
    for word, n in Counter(found).items():
        for feature in known[word]:
            out[feature] += n
    return out


def fit(rows: list[list[tuple[int, float]]], grades: np.ndarray, size: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that fit `grades` to sparse rows of (feature, value)."""
    ends = np.cumsum([0, *map(len, rows)])
    return fit_sparse(ends, np.array([f for r in rows for f, _ in r], np.int32), np.array([v for r in rows for _, v in r], np.float32), grades, size, steps)


def fit_sparse(ends: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, size: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood; row i has the features `column` and their `value` from ends[i] to ends[i + 1]."""
    n, levels = len(ends) - 1, np.arange(GRADES)
    w, raw = np.zeros(size), np.concatenate([[2.0], np.full(GRADES - 1, 0.5)])  # first threshold; logarithms of the gaps
    state = [np.zeros(size + GRADES), np.zeros(size + GRADES)]

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def thresholds(raw):
        return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    for step in range(1, steps + 1):
        theta = thresholds(raw)
        g_w, g_theta = RIDGE * w, np.zeros(GRADES)
        for at in range(0, n, ROWS):  # rows at a time: the fit holds little besides the rows
            last = min(n, at + ROWS)
            part, grade = slice(ends[at], ends[last]), grades[at:last]
            where, c, v = np.repeat(np.arange(last - at), np.diff(ends[at : last + 1])), column[part], value[part]
            score = np.bincount(where, v * w[c], last - at) if len(c) else np.zeros(last - at)
            above = sigmoid(score[:, None] - theta[None, :])  # P(grade > k)
            full = np.concatenate([np.ones((last - at, 1)), above, np.zeros((last - at, 1))], axis=1)
            p = np.maximum(full[np.arange(last - at), grade] - full[np.arange(last - at), grade + 1], 1e-12)
            slope = above * (1 - above)
            # d p / d(score - theta_k): + where the grade is just above k, - where it is k itself
            sign = (levels[None, :] == grade[:, None] - 1).astype(float) - (levels[None, :] == grade[:, None])
            push = -sign * slope / p[:, None] / n
            if len(c):
                g_w = g_w + np.bincount(c, v * push.sum(axis=1)[where], size)
            g_theta -= push.sum(axis=0)
        g_raw = np.concatenate([[g_theta.sum()], [g_theta[i:].sum() * np.exp(raw[i]) for i in range(1, GRADES)]])
        g = np.concatenate([g_w, g_raw])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:size], raw - move[size:]
    return w, thresholds(raw)


def row_of(counts: dict[int, int], n_words: int) -> list[tuple[int, float]]:
    """The sparse row of a document; feature 0 is the length."""
    return [(0, np.log1p(n_words) / 10)] + [(feature, 1 + np.log(n)) for feature, n in counts.items()]


def vocabulary(texts: DataFrame, features: int) -> tuple[dict[str, int], set[int]]:
    """Numbers, from 1, of the `features` words and beginnings that go most with the label either way, and those that mark a toxic text.

    texts: text and toxic. The statistic is counted and ranked by Spark; at most `features` rows come to the driver.
    """

    def spread(batches):
        count = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                count[int(toxic > 0)].update({f for word in set(words(text)) for f in features_of(word)} | {""})
        seen = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([count[y][x] for x in seen], pa.int64()) for y in (1, 0))], ["word", "a", "b"])

    table = texts.mapInArrow(spread, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    table = stored(table.where((F.col("word") == "") | (F.col("a") + F.col("b") >= LEAST)), "words")
    whole = table.where("word = ''").first()  # the documents of either kind
    if whole is None:
        return {}, set()
    a, b, all_a, all_b = F.col("a"), F.col("b"), F.lit(float(whole.a)), F.lit(float(whole.b))
    n, share, rest = a + b, all_a / (all_a + all_b), all_a + all_b - a - b

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g2 = 2 * (part(a, n * share) + part(b, n * (1 - share)) + part(all_a - a, rest * share) + part(all_b - b, rest * (1 - share)))
    rate = ((a + 0.5) / (all_a + 1)) / ((b + 0.5) / (all_b + 1))
    best = table.where("word <> ''").select("word", g2.alias("g2"), rate.alias("rate")).where(F.col("g2") > WEIGHED)
    found = best.orderBy(F.desc("g2"), "word").limit(features).collect()
    dropped(table)
    return {r.word: i for i, r in enumerate(found, 1)}, {i for i, r in enumerate(found, 1) if r.g2 > MARKED and r.rate > 4}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers by word, weights and thresholds; learnt from the `sample` labelled rows with the least hash of doc_id.

    What comes to the driver is one row for each feature, and for each document of the sample its numbers
    and frequencies of features, as Arrow arrays.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    texts = stored(texts, "sample")
    number, marked = vocabulary(texts, features)

    def counted(batches):
        known = Memo(lambda word: [number[f] for f in features_of(word) if f in number])
        for batch in batches:
            found = [words(text) for text in batch.column("text").to_pylist()]
            counts = [hits(x, known) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(map(len, found), pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "toxic", "n", "features", "counts"])

    rows = texts.mapInArrow(counted, "doc_id long, toxic int, n long, features array<int>, counts array<int>").toArrow().sort_by([("doc_id", "ascending"), ("n", "ascending")]).combine_chunks()
    dropped(texts)
    if not len(rows):
        return {}, np.zeros(1), np.full(GRADES, 40.0)
    features_, counts, n = (rows.column(c).combine_chunks() for c in ("features", "counts", "n"))
    own = np.append(0, np.cumsum(features_.value_lengths().to_numpy()))
    column, value = features_.flatten().to_numpy(), 1 + np.log(counts.flatten().to_numpy().astype(np.float32))
    mark = np.zeros(len(number) + 1, np.float32)
    mark[list(marked)] = 1
    much = np.bincount(np.repeat(np.arange(len(rows)), np.diff(own)), mark[column] * value, len(rows)).round(4)
    toxic = rows.column("toxic").to_numpy() > 0
    cuts = np.quantile(much[toxic], np.arange(1, GRADES) / GRADES) if toxic.any() else np.zeros(GRADES - 1)
    grades = np.where(toxic, 1 + np.searchsorted(cuts, much, "left"), 0)
    # the length, feature 0, comes first in every row
    column, value = np.insert(column, own[:-1], 0), np.insert(value, own[:-1], np.log1p(n.to_numpy()) / 10)
    w, theta = fit_sparse(own + np.arange(len(own)), column, value, grades, len(number) + 1)
    return number, w, theta


def scorer(docs: DataFrame, labels: DataFrame, sample: int):
    """A function, for use in workers, from texts to their chances of a grade above 0, above 1, .."""
    number, w, theta = train(docs, labels, sample)  # FEATURES words and numbers at most: sent with the tasks

    def score(texts: list) -> np.ndarray:
        if score.known is None:
            score.known = Memo(lambda word: [number[f] for f in features_of(word) if f in number])
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = words(text)
            scores[i] = sum(v * w[f] for f, v in row_of(hits(found, score.known), len(found)))
        return 1 / (1 + np.exp(np.clip(theta[None, :] - scores.reshape(-1, 1), -40, 40)))

    score.known = None
    return score


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_severity (0 to GRADES), p_toxic (chance of a grade above 0), toxic (p_toxic >= cut) of each row.

    Null and empty texts have no words, and get what their length alone gives; without labels every
    severity is close to 0.
    """
    score = scorer(docs, labels, sample)

    def run(batches):
        for batch in batches:
            above = score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cut)], ["doc_id", "expected_severity", "p_toxic", "toxic"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, toxic boolean")


def not_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't taken for toxic."""
    score = scorer(docs, labels, sample)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text").to_pylist())[:, 0] < cut))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """toxicity of all documents, learnt from the folder's labels; nulls, ties and empty tables as there."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
