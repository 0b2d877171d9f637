"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A byte string has one BPE encoding, and every prefix of that encoding is the encoding of the
prefix it spells.  So each byte prefix has exactly one token that its encoding can end with:
the candidate t (a token that is a suffix of the prefix) for which the token before it, already
known for the shorter prefix, and t stay apart when their bytes are merged by rank.  Storing that
last token per prefix gives the encoding by walking back; appending bytes only adds entries, and
an edit at byte p keeps all entries before p.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo


#: Bytes at the start of a word whose entries are kept for the next word that starts so.
SHARED = 6
#: Characters for which FAST splits text as public_tokenizers.PATTERN does; `re` is several times faster than `regex`.
PLAIN = re.compile("[^\\x00-\\x7f\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f]")
LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
FAST = re.compile(rf" ?[{LETTER}]++|'(?:[stmd]|re|ve|ll)| ?[^\t-\r {LETTER}0-9]++| ?[0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def words(text: str, pattern: str = public_tokenizers.PATTERN) -> list[str]:
    """All matches of `pattern` in a text."""
    if pattern == public_tokenizers.PATTERN and not PLAIN.search(text):
        return FAST.findall(text)
    return regex.findall(pattern, text)


class Bpe:
    """Ranks of a vocabulary, and encodings by last token per prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.apart = Memo(self._apart, 500_000)
        self.split = lru_cache(100_000)(self._split)
        self.begun = Memo(self.prefixes, 100_000)

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        token = self.bytes_of[rank]
        if len(token) == 1:
            return None
        below = [(token[i : i + 1]) for i in range(len(token))]
        parts = self._merge(below, rank)
        if len(parts) != 2:
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _merge(self, parts: list[bytes], below: int) -> list[bytes]:
        """Merge the lowest-ranked neighbours while their rank is under `below`."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of two tokens by rank gives these two tokens again.

        Undoes the merges of both sides in falling order of rank; at every step, a merge across the
        border that comes before the last undone merge would have been made first.
        """
        left, right = pair
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, parts = left, self.split(left)
                if parts is None:
                    limit, parts = right, self.split(right)
                    if parts is None:
                        return True
                    right = parts[0]
                else:
                    left = parts[1]
            else:
                limit, parts = right + 1, self.split(right)
                if parts is None:
                    limit, parts = left, self.split(left)
                    if parts is None:
                        return True
                    left = parts[1]
                else:
                    right = parts[0]

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Last token of each prefix of `data`; `last`: entries already known for its first prefixes."""
        last = [-1] if last is None else last
        rank_of, apart = self.ranks.get, self.apart
        for end in range(len(last), len(data) + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                token = rank_of(data[start:end])
                if token is not None and (start == 0 or (last[start] >= 0 and apart[last[start], token])):
                    last.append(token)
                    break
            else:
                last.append(-1)
        return last

    def ids(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Ids of the encoding of `data`, from the entries of its prefixes.

        The entries of beginnings of SHARED bytes are kept; those of `data` are appended to a copy.
        """
        if last is None:
            last = self.prefixes(data, self.begun[data[:SHARED]].copy())
        out, end = [], len(data)
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def edited(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """`data` with `removed` bytes at `at` replaced, and its entries: those up to `at` are kept."""
        new = data[:at] + added + data[at + removed :]
        return new, self.prefixes(new, last[: at + 1])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> Bpe:
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@lru_cache(2)
def memo(path: str) -> Memo:
    bpe = load(path)
    return Memo(lambda word: tuple(bpe.ids(word.encode())), 300_000)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encode each text by the rank file at `path` and decode it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if `with_ids`.  Each match of
    `pattern` is encoded by itself; no token is special.  Null and empty texts have no tokens and the
    digests of nothing.  Work is by row, in the partitions of the scan: there is no shuffle.
    """

    def run(batches):
        bpe, known = load(path), memo(path)
        import numpy as np

        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids: list[int] = []
                for word in words(text or "", pattern):
                    ids += known[word]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """encode of all documents by the byte-level ranks; a null text has no tokens."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
