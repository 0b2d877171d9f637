"""Quality rules: counts of words, symbols and repeats, and the fertility of public vocabularies.

A text that vocabularies for natural language cut into unusually short or long pieces, spell in
single bytes, or cover with few or too evenly spread pieces is seldom prose.  Four measures of
each whole text -- characters per token of a piece vocabulary and of a byte-level one, share of
byte-fallback tokens (line feeds and tabs aside) and entropy in bits of the pieces -- are held against
one band per language.  Length is taken out of the
measures: their trend and the logarithm of their spread are curves in log2 of the number of tokens,
fitted to all lengths of the language at once (least absolute deviations, so that a class of length
full of junk, or one that holds a single document, neither bends them nor has a band of its own).
Languages with too few documents for a spread are held against the band of their script.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load, words
from .common import Memo, stored
from .shingles import GOLDEN, mixed, word_hash
from .token_counts import pieces

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words of a window that may be found again; half the width of a band in standard deviations: Tukey's far-out fence, a quartile and 3 quartile distances.
WINDOW, WIDTH = 5, 0.6745 + 3 * 1.349
#: Documents that pass the base rules from which a language (a script) has a band of its own; share of them at either end of the lengths beyond which curves go on level.
ENOUGH, ENDS = 8, 0.005
#: Characters of a text that are encoded at a time.
CHARACTERS = 100_000
#: Degrees of the curves in the logarithm of the length: trend; logarithm of the spread.
TREND, SPREAD = 2, 1
#: First code points of the ranges that tell scripts apart: Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai and so on, Latin again, Han and kana, Hangul, others.
SCRIPTS = np.array([0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1E00, 0x2E80, 0xAC00, 0xD7B0], np.uint32)
#: Least deviation of each measure.
LEAST = {"chars_per_token": 0.02, "byte_share": 0.004, "token_entropy": 0.08, "chars_per_byte_token": 0.02}


def word_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    found = text.encode().split()
    n = len(found)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(word_hash, found), np.uint64, n)
        window = h[: n - WINDOW + 1]
        for i in range(1, WINDOW):
            window = mixed(window * GOLDEN) + h[i : n - WINDOW + 1 + i]
        _, which, count = np.unique(window, return_inverse=True, return_counts=True)
        if len(count) < len(window):
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(count[which] > 1)
            edge[at] += 1
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def script(text: str) -> int:
    """The number of the range of SCRIPTS that most letters of the text are in; 0 for Latin and none."""
    if text.isascii():
        return 0
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = int(np.bincount(np.searchsorted(SCRIPTS, points[points >= ord("A")], "right"), minlength=1).argmax())
    return 0 if found == 8 else found


@lru_cache(2)
def fertility(path: str, ranks: str):
    """A function of a text: tokens, characters per token, byte-fallback share, token entropy under the pieces of `path`; characters per token under the byte-level `ranks`."""
    import sentencepiece
    import tiktoken

    model, split = sentencepiece.SentencePieceProcessor(model_file=path), pieces(path).split
    fallback = np.zeros(model.vocab_size() + 1, bool)
    for i in range(model.vocab_size()):
        fallback[i] = model.is_byte(i) and model.id_to_piece(i) not in ("<0x0A>", "<0x09>", "<0x0D>")
    whole = split("a\nb") != [" a", "\n", "b"]  # a vocabulary whose texts can't be split

    def ids(text: str) -> np.ndarray:
        """Ids of the text; a long one is cut at words, across which no piece goes, so that the library's memory is bounded."""
        if whole or len(text) <= CHARACTERS:
            return np.array(model.encode(text), np.int32)
        parts, part, size = [], [], 0
        for word in split(text):
            part.append(word)
            size += len(word)
            if size > CHARACTERS:
                parts.append("".join(part))
                part, size = [], 0
        parts.append("".join(part))
        return np.concatenate([np.array(model.encode(x[1:]) if x[0] == " " else model.encode("\n" + x)[2:], np.int32) for x in parts if x])

    by_bytes = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load(ranks).ranks, special_tokens={})
    n_ids = Memo(lambda word: len(by_bytes._encode_single_piece(word)), 250_000)  # each match of the pattern by itself
    def measures(text: str) -> tuple[int, float, float, float, float]:
        found = ids(text)
        if not len(found):
            return 0, 0.0, 0.0, 0.0, 0.0
        share = np.unique(found, return_counts=True)[1] / len(found)
        n_bytes = max(1, sum(map(n_ids.__getitem__, words(text))))
        return len(found), len(text) / len(found), float(fallback[found].mean()), float(-(share * np.log2(share)).sum()), len(text) / n_bytes

    return measures


def measured(docs: DataFrame, path: str, ranks: str) -> DataFrame:
    """The counts and measures of each row's whole text; lang is the language behind a mark, and another mark where it is null."""

    def run(batches):
        measures = fertility(path, ranks)
        for batch in batches:
            rows = [(*word_counts(text or ""), *measures(text or ""), script(text or "")) for text in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c, k) for c, k in zip(columns, kinds))], NAMES)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")).alias("lang"), "text")
    return found.mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_byte_token double, script int")


NAMES = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "chars_per_byte_token", "script"]


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients, constant first, of the polynomial in x with the least weighted sum of absolute deviations from y."""
    powers, ridge, w = np.vander(x, degree + 1, increasing=True), 1e-3 * np.eye(degree + 1), weight.astype(float)
    for _ in range(30):
        root = np.sqrt(w)
        found = np.linalg.lstsq(np.vstack([powers * root[:, None], ridge]), np.concatenate([y * root, np.zeros(degree + 1)]), rcond=None)[0]
        w = weight / np.maximum(np.abs(y - powers @ found), 0.01)
    return found


def curves(rows: DataFrame, degree: int, logarithm: bool) -> DataFrame:
    """band, documents, low, high and an array of coefficients for each measure, from the medians of the measures by class of length.

    rows: band, length and the measures; a row for each band and class of length is what is fitted.
    """
    medians = [F.percentile_approx(name, 0.5, F.lit(20_000)).alias(name) for name in LEAST]
    classes = rows.groupBy("band", F.floor("length").alias("size_class")).agg(F.count("*").alias("n"), F.avg("length").alias("x"), *medians)

    def fit(part):
        part = part.sort_values("size_class")
        n, x = part["n"].to_numpy(), part["x"].to_numpy()
        low, high = x[np.cumsum(n) >= ENDS * n.sum()][0], x[np.cumsum(n[::-1])[::-1] >= ENDS * n.sum()][-1]
        at, out = np.clip(x, low, high) - MIDDLE, {"band": [part["band"].iloc[0]], "documents": [n.sum()], "low": [low], "high": [high]}
        for name, least in LEAST.items():
            y = part[name].to_numpy()
            out[name] = [curve(at, np.log(np.maximum(1.4826 * y, least / 4)) if logarithm else y, n, degree)]
        return pd.DataFrame(out)

    return stored(classes.groupBy("band").applyInPandas(fit, "band string, documents long, low double, high double, " + ", ".join(f"{name} array<double>" for name in LEAST)), "curves")


#: Curves are powers of log2 of the tokens less this.
MIDDLE = 8


def on(curve: str, degree: int):
    """The value at the row's length of the curve in a column."""
    at = F.least(F.greatest("length", "low"), F.col("high")) - MIDDLE
    return sum((F.col(curve)[i] * F.pow(at, F.lit(i)) for i in range(1, degree + 1)), F.col(curve)[0])


def bands(table: DataFrame) -> DataFrame:
    """lang, script, low, high, t_ and s_ curves of each measure: the trend and the spread's logarithm to hold a document of that language and script against."""
    each = F.explode(F.array(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"), F.lit("all"))).alias("band")
    rows = table.where("not base_failed").select(each, "length", *LEAST)
    trend = curves(rows, TREND, False).select("band", "documents", "low", "high", *(F.col(name).alias(f"t_{name}") for name in LEAST))
    off = rows.join(trend, "band").select("band", "length", *(F.abs(F.col(name) - on(f"t_{name}", TREND)).alias(name) for name in LEAST))
    spread = curves(off, SPREAD, True).select("band", *(F.col(name).alias(f"s_{name}") for name in LEAST))
    whole = trend.join(spread, "band").select("band", F.struct("documents", "low", "high", *(f"{c}_{name}" for c in "ts" for name in LEAST)).alias("b"))
    enough, out = whole.where(F.col("b.documents") >= ENOUGH), table.select("lang", "script").distinct()
    out = out.withColumn("l", F.concat(F.lit("lang "), "lang")).withColumn("s", F.concat(F.lit("script "), "script")).withColumn("a", F.lit("all"))
    for key, of in (("l", enough), ("s", enough), ("a", whole)):
        out = out.join(of.select(F.col("band").alias(key), F.col("b").alias(f"b{key}")), key, "left")
    return stored(out.select("lang", "script", F.coalesce("bl", "bs", "ba").alias("b")).select("lang", "script", "b.*"), "bands")


def quality_rules(docs: DataFrame, path: str, width: float = WIDTH, ranks: str | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures.

    A row for each row of docs (doc_id, text, lang); path: of the pieces, ranks: of the byte-level vocabulary.  base_failed: under 10 words, or over 20 % of them
    in 5-word windows found twice or more; null and empty texts fail so.  kept: not base_failed, and
    every measure within its band; documents of a null language form a language of their own.  A language
    of under ENOUGH documents is held against its script, a script of under ENOUGH against all documents.
    """
    table = stored(measured(docs, path, ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), "measures")
    table = table.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    table = table.withColumn("length", F.log2(F.greatest("n_tokens", F.lit(1)).cast("double")))
    # a row for each language and script (some tens of them) in a stored table: broadcast while it is small, by its size
    out, within = table.join(bands(table), ["lang", "script"], "left"), F.lit(True)
    for name, least in LEAST.items():
        deviation = F.greatest(F.exp(on(f"s_{name}", SPREAD)), F.lit(least))
        within = within & (F.abs(F.col(name) - on(f"t_{name}", TREND)) <= width * deviation)
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_tokens", *LEAST)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """quality_rules of all documents; null and empty texts fail the base rules."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
