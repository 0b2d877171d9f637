"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts (up to ORDER bytes back, within a word and the blank before
it) holds how often each byte followed.  A byte unseen in a context costs an escape, with probability
distinct / (total + distinct), and is coded in the next shorter context without the bytes that the
longer one has seen; below the empty context all bytes are alike.  The statistics are frozen after
training, so a text's exact code length in bits is the sum over its words, each the same wherever it
stands; the language of the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, stored

#: Bytes of context; most documents of a language from which its tree is made.
ORDER, SAMPLE = 4, 500


def contexts(words: Counter) -> Counter:
    """(context, byte) counts of all orders of words that end in a blank and follow one."""
    out: Counter = Counter()
    for word, n in words.items():
        data = b" " + word + b" "
        for at in range(1, len(data)):
            for order in range(min(at, ORDER) + 1):
                out[data[at - order : at], data[at]] += n
    return out


class Trees:
    """Code lengths under several trees at once."""

    def __init__(self, rows):
        """rows: (lang, context, byte, n)"""
        rows = list(rows)
        self.langs = sorted({row[0] for row in rows})
        self.trees: list[dict[bytes, list]] = [{} for _ in self.langs]
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, context, byte, n in rows:
            node = self.trees[number[lang]].setdefault(bytes(context), [0, {}])
            node[0] += n
            node[1][byte] = n
        self.bytes = Rows(lambda key: [self.bits(tree, key[:-1], key[-1]) for tree in self.trees], len(self.langs), 600_000)
        self.words = Rows(self._word, len(self.langs), 500_000)

    @staticmethod
    def bits(tree: dict, context: bytes, byte: int) -> float:
        """Bits of a byte after a context."""
        total, seen = 0.0, None
        for start in range(len(context) + 1):
            node = tree.get(context[start:])
            if node is None:
                continue
            count, counts = node
            distinct = len(counts)
            if seen:
                rest = [n for b, n in counts.items() if b not in seen]
                count, distinct = sum(rest), len(rest)
                if not distinct:
                    continue
            n = counts.get(byte)
            if n:
                return total + log2((count + distinct) / n)
            total += log2((count + distinct) / distinct)
            seen = seen | counts.keys() if seen else counts.keys()
        return total + log2(256 - len(seen or ()))

    def _word(self, word: bytes) -> np.ndarray:
        data = b" " + word + b" "
        short = range(1, min(ORDER, len(data)))
        return self.bytes.sum([data[: at + 1] for at in short] + [data[at : at + ORDER + 1] for at in range(len(data) - ORDER)])

    def predict(self, text: str) -> tuple[str, float]:
        """Language and the posterior probability of it, languages being equally likely before."""
        words = text.lower().encode().split()
        if not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        lengths = self.words.sum(words)
        best = int(lengths.argmin())
        return self.langs[best], float(1 / np.exp2(np.minimum(lengths[best] - lengths, 0)).sum())


def trained(docs: DataFrame, sample: int = SAMPLE) -> pa.Table:
    """lang, context, byte, n of the documents (doc_id, text, lang) with a language.

    At most `sample` documents of a language, those with the least hash of doc_id: the rows that come to
    the driver are bounded by them. Of a common language, only hashes under a bound by its number of
    documents, at which twice `sample` are left, are looked at.
    """
    known = docs.where("lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a row for each language in a stored table: broadcast while it is small, by its size
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("_all")), "languages")
    under = F.xxhash64("doc_id") / F.lit(2.0**63) <= 4.0 * sample / F.col("_all") - 1
    few = stored(known.select("doc_id", "lang").join(counts, "lang").where(under).select("doc_id", "lang"), "candidates")
    chosen = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("doc_id", "lang").distinct()

    def counted(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().encode().split())
        for lang, count in words.items():
            found = contexts(count)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["lang", "context", "byte", "n"])

    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # at most `sample` rows of a language
    return texts.select("lang", "text").mapInArrow(counted, "lang string, context binary, byte int, n long").groupBy("lang", "context", "byte").agg(F.sum("n").alias("n")).select("lang", "context", "byte", "n").toArrow()


def language_id(docs: DataFrame, train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text), learnt from `train` (doc_id, text, lang).

    `und`, 0 for null texts, texts without letters, and where `train` has no language.
    """
    spark = docs.sparkSession
    rows = spark.sparkContext.broadcast(trained(train, sample))
    key = uuid.uuid4().hex

    def run(batches):
        trees = planted(key, rows)
        for batch in batches:
            found = [trees.predict(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return out.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


#: Trees of the last model used in this worker.
TREES: dict = {}


def planted(key: str, rows) -> Trees:
    """The trees of broadcast rows, made once in a worker."""
    if key not in TREES:
        TREES.clear()
        TREES[key] = Trees(zip(*(rows.value.column(c).to_pylist() for c in ("lang", "context", "byte", "n"))))
    return TREES[key]


def held_out():
    """Whether crc32 of doc_id as text leaves 2 modulo 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """language_id of all documents, learnt from those that aren't held out; `und` without letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, docs.where(~held_out()))
