"""SimHash fingerprints: every term's hash votes, with the term's weight, for or against each bit.

Terms are the 2-word shingles of a text (the word itself where there is one), weighted by one plus the
logarithm of their frequency.  Fingerprints within a Hamming radius are found by block tables: with
the bits cut into `blocks` and at most `radius` bits different, blocks - radius blocks agree, so
permuting each choice of so many blocks to the front gives a table in which the two meet.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import GOLDEN, mixed, word_hashes

BITS = 128
#: Radius of the search, blocks of its tables; rows whose doc_id is a multiple of EVERY are looked for.
RADIUS, BLOCKS, EVERY = 3, 6, 20
#: Terms whose votes are added up at a time.
BLOCK = 32_768


def fingerprint(text: str | None) -> np.ndarray:
    """BITS bits as bytes; all zero for a text without words. Equal texts have equal fingerprints."""
    h = word_hashes(text)
    if len(h) == 0:
        return np.zeros(BITS // 8, np.uint8)
    terms = mixed(mixed(h[:-1] * GOLDEN) + h[1:]) if len(h) > 1 else mixed(h)
    terms, counts = np.unique(terms, return_counts=True)
    weights, votes = 1 + np.log(counts), np.zeros(BITS)
    for at in range(0, len(terms), BLOCK):
        hashes = mixed(terms[at : at + BLOCK, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * GOLDEN)
        votes += weights[at : at + BLOCK].astype(np.float32) @ np.unpackbits(hashes.view(np.uint8), axis=1).astype(np.float32)
    return np.packbits(2 * votes > weights.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary) of each row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(x).tobytes() for x in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, fingerprint binary")


def class_pairs(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(asked, fingerprint, distance): each fingerprint of queries and every one of prints at most `radius` bits away, itself too.

    Rows with equal fingerprints are one class, so that many copies meet no more often than one.
    """
    tables = list(combinations(range(blocks), blocks - radius))
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def keyed(batches):
        for batch in batches:
            raw = batch.column("fingerprint").to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BITS // 8), axis=1)
            keys, which = [], []
            for number, chosen in enumerate(tables):
                front = np.packbits(np.concatenate([bits[:, edges[b] : edges[b + 1]] for b in chosen], axis=1), axis=1)
                keys += [bytes([number]) + x.tobytes() for x in front]
                which += raw
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(which, pa.binary())], ["key", "fingerprint"])

    schema = "key binary, fingerprint binary"
    classes, wanted = prints.select("fingerprint").distinct(), queries.select("fingerprint").distinct()
    rows, asked = classes.mapInArrow(keyed, schema), wanted.mapInArrow(keyed, schema).withColumnRenamed("fingerprint", "asked")

    def near(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("asked", "fingerprint"))
            distance = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int32)
            keep = pa.array(distance <= radius)
            yield pa.RecordBatch.from_arrays([batch.column("asked").filter(keep), batch.column("fingerprint").filter(keep), pa.array(distance).filter(keep)], ["asked", "fingerprint", "distance"])

    return asked.join(rows, "key").select("asked", "fingerprint").distinct().mapInArrow(near, "asked binary, fingerprint binary, distance int")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, other_id, distance) for every query row and every other row at most `radius` bits away.

    prints, queries: doc_id and fingerprint. As many rows as there are pairs: `neighbours` counts them without.
    """
    found = queries.select("doc_id", F.col("fingerprint").alias("asked")).join(class_pairs(prints, queries, radius, blocks), "asked")
    return found.join(prints.select(F.col("doc_id").alias("other_id"), "fingerprint"), "fingerprint").where("doc_id <> other_id").select("doc_id", "other_id", "distance")


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint, n_near, nearest for each fingerprint of queries, whose rows are rows of prints.

    n_near: other rows at most `radius` bits away, copies included; nearest: the least of their distances,
    null if there are none. Copies are counted by class and not expanded.
    """
    counts = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    others = F.col("n") - F.when(F.col("distance") == 0, 1).otherwise(0)
    found = class_pairs(prints, queries, radius, blocks).join(counts, "fingerprint").withColumn("others", others)
    return found.groupBy(F.col("asked").alias("fingerprint")).agg(F.sum("others").alias("n_near"), F.min(F.when(F.col("others") > 0, F.col("distance"))).alias("nearest"))


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow of `run` over ranges of doc_id in rising order, each followed by the row that comes next.

    Batches have doc_id, text and _copy; the row with _copy = 1 that ends a range is the first one of the
    next range (of the first range for the last). The ranges' first ids, one for each, go through the driver.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    place = F.coalesce("doc_id", F.lit(-(2**63)))  # null comes first
    firsts = docs.select(place.alias("p")).repartitionByRange(n, "p").groupBy(F.spark_partition_id()).agg(F.min("p").alias("p"))
    starts = np.array(sorted({row.p for row in firsts.collect()}), np.int64)

    def ranged(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()
            at = np.searchsorted(starts, ids, "right") - 1
            first = np.flatnonzero(starts[at] == ids)
            for rows, to, copy in ((np.arange(len(ids)), at, 0), (first, (at[first] - 1) % len(starts), 1)):
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(np.full(len(rows), copy, np.int32)), *part.columns], ["_range", "_copy", "doc_id", "text"])

    dealt = docs.mapInArrow(ranged, "_range long, _copy int, doc_id long, text string").repartition(n, "_range")
    return dealt.sortWithinPartitions("_range", "_copy", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is the next row in order of doc_id (null first; rows of one id by text), the first one
    after the last; a lone row is its own next.  Null texts are empty, with the fingerprint of all zeros.
    """

    def run(batches):
        range_, before, out = None, None, []

        def row(doc_id, text, own, following, other):
            new = edited(text, following)
            mark = fingerprint(new)
            return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.tobytes().hex(), mark.tobytes().hex(), likeness(own, mark), likeness(own, other)

        for batch in batches:
            for at, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "_copy", "doc_id", "text"))):
                text = text or ""
                if at != range_:
                    range_, before = at, None
                elif before is None:
                    continue  # further rows with the id that starts the next range
                own = fingerprint(text)
                if before is not None:
                    out.append(row(*before, text, own))
                before = None if copy else (doc_id, text, own)
            columns = list(zip(*out)) if out else [()] * 7
            out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], OUT)

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def searched(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, every: int = EVERY) -> DataFrame:
    """edit_likeness of docs, with n_near and nearest (see neighbours) of rows with doc_id % every = 0 among all rows; null for the others."""
    rows = stored(edit_likeness(docs), "likeness")
    prints = rows.select("doc_id", F.unhex("fingerprint").alias("fingerprint"))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = neighbours(prints, prints.where(asked), radius, blocks).withColumn("fingerprint", F.lower(F.hex("fingerprint")))
    rest = rows.where(~asked).withColumn("n_near", F.lit(None).cast("long")).withColumn("nearest", F.lit(None).cast("int"))
    return rows.where(asked).join(found, "fingerprint", "left").select(*rest.columns).unionByName(rest)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """searched for all documents: likenesses of each row, neighbours of those with doc_id % EVERY = 0."""
    return searched(spark.read.parquet(f"{sf_dir}/documents.parquet"))
