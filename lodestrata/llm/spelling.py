"""Groups of spelling variants: words that differ by one code point, and the common form that rare ones stand for.

The words of the corpus are counted; their bigrams are ordered by how many words hold them. An edit of one
code point touches two neighbouring bigrams at most, so two near words share one of the three rarest bigrams
of each, in order of (frequency, bigram, position), moved by one position at most. Only these are joined.

The limits on position are used in full: the edit lies to one side of the shared bigram, so on the other side
the words agree, up to their start or their end; and of the side with the edit, whose length is known but for
one, either the first half agrees or the last. So rows meet by (bigram and the side without edit, length, half),
not by the bigram alone: few bigrams, each with thousands of words, would otherwise pair them all. Whatever
meets is verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Letters of a word; distinct words, and characters of texts, that a Python worker counts before it passes the counts on.
RUN, FLUSH, CHARACTERS = re.compile("[A-Za-zÀ-ÿ]+"), 300_000, 1 << 26
#: Rare bigrams of a word that are joined: one edit touches two at most, and one more must be shared.
RAREST = 3


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, edit: Callable[[int, str], int | None] | None = None) -> DataFrame:
    """(word, n): runs of letters of all texts, with A-Z lower-cased, of `shortest` code points and more that come `least` times or more.

    edit: from a doc_id and a word to the position of a code point that is deleted first (None: none is).
    Workers count what they see, and sums are combined before they are shuffled.
    """

    def run(batches):
        seen, size = Counter(), 0

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = Counter(RUN.findall((text or "").encode().lower().decode()))  # bytes: only A-Z change
                for word, n in found.items():
                    at = edit(doc_id, word) if edit and doc_id is not None else None
                    if at is not None:
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        seen[word] += n
                size += len(text or "")
                if len(seen) > FLUSH or size > CHARACTERS:
                    yield counted()
                    seen.clear()
                    size = 0
        yield counted()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def dropped_letter(doc_id: int, word: str, every: int = 31) -> int | None:
    """Position of the letter that a word of a document loses: by the checksum of `doc_id:word`, where `every` divides it."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return h % len(word) if h % every == 0 else None


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of each bigram in order of (number of words, bigram): as many as the square of the letters at most (8,100)."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("g"))
    counts = grams.groupBy("g").count().orderBy("count", "g")
    return {r["g"]: i for i, r in enumerate(counts.collect())}


def keys(word: str, ranks: dict[str, int]) -> list[tuple[bool, int]]:
    """(longer, key) by which a word meets those an edit away; longer: as the one of the two with no fewer code points.

    For each of its rarest bigrams and each side of it that may hold the edit: the bigram with the other
    side whole, the length of the longer one's side, and half of the side.
    """
    out = []
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    for at in sorted(range(len(grams)), key=lambda i: (ranks[grams[i]], i))[:RAREST]:
        for side, fixed, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
            for longer, length in ((True, len(rest)), (False, len(rest) + 1)):
                half = length // 2
                if length:
                    out.append((longer, f"{side}{fixed}\n{length}<{rest[:half]}"))
                if half:  # an edit in the first half leaves the last one, and so the longer side's code points from `half` on
                    out.append((longer, f"{side}{fixed}\n{length}>{rest[len(rest) - (length - half) :]}"))
    return [(longer, xxhash.xxh3_64_intdigest(key.encode()) - (1 << 63)) for longer, key in out]


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each unordered pair of the words (word, n) that differ by one inserted, deleted or replaced code point, once.

    Words of under four code points have too few bigrams and aren't compared.
    """
    words = words.where(F.char_length("word") > RAREST)
    ranks = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for longer, key in keys(word, ranks.value):
                    for column, value in zip(rows, (key, longer, word, n)):
                        column.append(value)
            columns = [pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.bool_(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "longer", "word", "n"])

    rows = stored(words.mapInArrow(run, "key long, longer boolean, word string, n long"), "rare-bigrams")
    left = rows.where("longer").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    # two of one length meet as longer ones, in one order; of two lengths, the longer is on the left
    met = left.join(right, "key").where((F.col("longer") & (F.col("a") < F.col("b"))) | (~F.col("longer") & (F.length("a") > F.length("b"))))
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    return near.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the words (word, n), n counting words once each.

    form: the near word of largest n (of ties the smallest), if that is at least `times` the word's own;
    Words of under four code points have none near. root: where a chain of forms ends, the word itself without a form. Forms rise by a factor, so a
    chain has no more links than n has digits (times = 10), and a few joins that double the links walked reach its end.
    """
    words = stored(words, "words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("best"))
    has = F.col("best").isNotNull() & (-F.col("best.less") >= times * F.col("n"))
    found = words.join(best, "word", "left").select(
        "word", F.when(has, F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "forms")
    top = found.agg(F.max("n")).first()[0] or 1
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    walked, most = 1, math.log(top, times) + 1
    while walked < most:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
        walked *= 2
    out = found.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """variants of the words of all documents, of at least 7 code points and 2 occurrences, some of whose letters are dropped by a checksum.

    A null text has no words, words of rows without doc_id lose no letter, repeated rows count each time,
    and without documents there are no rows.
    """
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=dropped_letter))
