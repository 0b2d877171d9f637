"""Token counts by distinct pre-token.

A byte-fallback piece model whose pieces never hold a space after another character cannot merge
across the start of a run of spaces, and one whose pieces hold no line feed cannot merge across
line feeds.  Texts therefore fall apart into pre-tokens that are encoded independently; the pieces
of each distinct pre-token are counted once, and a document's count is the sum over its pre-tokens
of frequency times pieces.  No list of ids is ever made for a document.

Pre-tokens are counted over all documents with a map-side combine; `sums` joins the pieces of each
to the frequencies in the documents.
"""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sums import HOT, unit_counts, unit_sums


class Pieces:
    """Pre-tokens of a text and pieces of a pre-token under a sentencepiece model or a tokenizers file."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            # without knowledge of its splitting rules, a text is one pre-token
            self.split = lambda text: [text] if text else []
            self.count = lambda token: len(model.encode(token, add_special_tokens=False).ids)
            return
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        whole = any(re.search("[^▁]▁", x) or "\n" in x for x in pieces) or model.encode("\n", out_type=str) != ["▁", "<0x0A>"]
        if whole or model.normalize(" a  b\n") not in ("▁▁a▁▁b\n",):
            self.split = lambda text: [text] if text else []
            self.count = lambda token: len(model.encode(token))
            return
        found = re.compile(" *[^ \n]+| +|\n").findall
        # the model puts a space before the text, and takes U+2581 for one
        self.split = lambda text: found(" " + text.replace("▁", " ")) if text else []

        def count(token: str) -> int:
            if token == "\n" or token == " ":
                return 1
            if token[0] == " ":
                return len(model.encode(token[1:]))
            return len(model.encode("\n" + token)) - 2

        self.count = count


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    No begin, end or added special tokens; null and empty texts have 0 bytes and 0 tokens; rows that
    repeat are counted one by one.
    """

    def split():
        return pieces(path).split

    def measured(batches):
        count = pieces(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(count, batch.column("unit").to_pylist()), pa.int64())], [*batch.schema.names, "value"])

    docs = docs.select("doc_id", "text")
    vocabulary = stored(unit_counts(docs, split).mapInArrow(measured, "unit string, n long, value long"), "vocabulary")
    out = unit_sums(docs, split, None, vocabulary, lambda text: len(text.encode()), hot)
    return out.select("doc_id", F.col("size").alias("n_bytes"), F.col("total").alias("n_tokens"), (F.col("total") > limit).alias("over_limit"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts of all documents by the piece vocabulary; null and repeated rows as there."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
