"""Token ids of documents as ORC files.

Documents are cut into ranges of ascending doc_id, each of which becomes a file: ids as lists of integers,
which ORC writes in its run-length encoding, with row indexes and a Bloom filter on doc_id. A reader may split
a file at its stripes, and skips files, stripes and groups of rows that can't hold the doc_ids it asks for.
Each row also has the number of ids before it in its file, so that its place among all ids needs only the
sums of the files.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PLAIN, words
from .common import Recent, shared_dir

#: Rows of a group of the row index; bytes of a stripe before compression; share of doc_ids that a Bloom filter takes in wrongly.
GROUP, STRIPE, WRONG = 1_000, 16 << 20, 0.01


class TextIds:
    """Ids of texts by a tokenizers file with a byte-level vocabulary, special strings as the library takes them by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()) or "(?!)")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.words = Recent(self.word)
        sample = "Ab é's  12 ..a\n\n'll x_y \t z "
        # words may be encoded one by one, by the model alone, if the vocabulary's own splitter cuts where the pattern does
        self.by_word = self.whole(sample) == b"".join(map(self.word, words(sample)))

    def word(self, word: str) -> bytes:
        """Ids of a word without its splitter; the model has a letter for each byte."""
        return array("I", [t.id for t in self.model.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word or PLAIN.search(text) or self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, words(text)))


@lru_cache(2)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = 0, group: int = GROUP, stripe: int = STRIPE) -> None:
    """Write the ids of all texts, with `end` behind each, as ORC files in a folder: doc_id, place (ids before it in the file), n_tokens, ids.

    Files, and rows in them, are in ascending order of doc_id, null last; rows of one doc_id keep the order of
    the input and may go on in the next file, so that no id is too frequent. A null text is the end alone.
    """

    def run(batches):
        ids_of, last, place = text_ids(vocabulary), np.array([end], "<u4").tobytes(), 0
        for batch in batches:
            places, ends, sizes, parts = [], [0], [], []
            for text in batch.column("text").to_pylist():
                ids = ids_of(text or "") + last
                places.append(place)
                parts.append(ids)
                sizes.append(len(ids) // 4)
                place += sizes[-1]
                ends.append(ends[-1] + sizes[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            columns = [batch.column("doc_id"), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n_tokens", "ids"])

    order = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {
        "compression": "lz4", "orc.create.index": "true", "orc.row.index.stride": str(group), "orc.stripe.size": str(stripe),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(WRONG),
    }
    ordered.mapInArrow(run, "doc_id long, place long, n_tokens long, ids array<int>").write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, part (number of the file), place, n_tokens, ids of a folder of `write_ids`; doc_ids: only of these documents.

    The doc_ids asked for go to the files' own statistics and Bloom filters, so what can't hold them isn't decoded.
    """
    rows = spark.read.schema("doc_id long, place long, n_tokens long, ids array<int>").orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return rows.select("doc_id", part.alias("part"), "place", "n_tokens", "ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, first: the ids in the files before each, from a row for each file."""
    rows = read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    out, total = [], 0
    for part, n in rows.orderBy("part").collect():  # a row for each file
        out.append((part, total))
        total += n
    return spark.createDataFrame(out, "part int, first long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in a folder of `write_ids`."""

    def run(batches):
        for batch in batches:
            ids, crc, n = batch.column("ids"), [], []
            raw, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            for a, b in zip(ends, ends[1:]):
                crc.append(zlib.crc32(raw[a:b].tobytes()))
                n.append(b - a)
            columns = [batch.column(c) for c in ("doc_id", "part", "place")]
            names = ["doc_id", "part", "place", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names)

    rows = read_ids(spark, path).mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    placed = rows.join(F.broadcast(starts(spark, path)), "part")
    return placed.select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """digests of the ids of all documents, written with id 0 behind each and read back from the ORC files.

    A null or empty text is the end id alone; a null doc_id comes last; rows of one doc_id stand in the order of
    the table; without documents there are no rows.
    """
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
