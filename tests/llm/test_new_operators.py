import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import spelling, token_files, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)
VECTORS = "vec_id long, embedding array<float>, label int, x string"

# ---- whitening ------------------------------------------------------------------------------------


def whole(rows):
    """(id, x) of the rows with a whole vector, x of the commonest length."""
    out = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = Counter(len(x) for _, x in out).most_common(1)[0][0]
    return [(i, x) for i, x in out if len(x) == d]


def checked(got, rows, k=4):
    kept = whole(rows)
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, len(values))
    assert len(got) == k * len(kept)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        scores = (np.array(x, float) - (sums / n).astype(float)) @ vectors[:, :k] / np.sqrt(values[:k])
        for j in range(k):
            found = by_id[i][j + 1]
            assert any(r.deviation == deviation and r.n == n and abs(abs(r.whitened) - abs(scores[j])) < 1e-9 * max(1, abs(scores[j])) for r in found)
            assert all(r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9 for r in found)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whitening.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    checked(got, [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 1 + i % 3, 5)]) for i in range(60)]
    rows += [rows[0]] * 40 + [(100 + i, rows[1][1]) for i in range(30)] + [(7, rows[2][1]), (None, rows[3][1])]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, math.nan, 0.0, 0.0, 0.0]), (204, [math.inf] * 5), (205, [1.0, 2.0]), (206, [-0.0, 0.001, -0.001, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], VECTORS)
    got = whitening.whitened(df, "vec_id", "embedding").collect()
    checked(got, rows)
    assert {r.vec_id for r in got}.isdisjoint(range(200, 206)) and sum(r.vec_id is None for r in got) == 4
    # in several blocks, the same
    most, whitening.WIDTH = whitening.WIDTH, 2
    try:
        checked(whitening.whitened(df, "vec_id", "embedding").collect(), rows)
    finally:
        whitening.WIDTH = most


def test_whitening_of_extremes(spark):
    equal = spark.createDataFrame([(i, [1.0, 2.0], 1, "") for i in range(5)], VECTORS)
    got = whitening.whitened(equal, "vec_id", "embedding").collect()
    assert len(got) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, 0.0, 1.0)}
    # beyond a long: exact where it fits, null where it doesn't
    large = [(0, [1e12, 0.0, 1.0]), (1, [-1e12, 1.0, 0.0]), (2, [0.0, 0.5, 0.25])]
    got = {r.vec_id: r.deviation for r in whitening.whitened(spark.createDataFrame([(i, v, 1, "") for i, v in large], VECTORS), "vec_id", "embedding").collect()}
    x = [np.array([math.floor(256 * float(np.float32(c))) for c in v], object) for _, v in large]
    want = [int(((3 * a - sum(x)) ** 2).sum()) for a in x]
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    assert want[0] > 2**63 > want[2]
    for rows in ([], [(1, None, 1, "")]):
        none = whitening.whitened(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
        assert none.count() == 0 and none.columns == whitening.whitened(equal, "vec_id", "embedding").columns


# ---- files of token ids ---------------------------------------------------------------------------


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def expected(rows):
    """doc_id -> sorted (start, n, crc) of rows in order, ids null last."""
    out, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        found = ids(text)
        out.setdefault(doc_id, []).append((start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    return out


TEXTS = st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "é", "日", "<|endoftext|>", ".", "###", "\x00", "\x1c", "\x85", "😀", "İ", "'s", "'S", "12", "²", "　", "ab", "x_y", "\r\n", "ſ", "’"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_text_ids_as_the_library(text):
    assert np.frombuffer(token_files.text_ids(BYTES)(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_token_files_of_the_table(spark, small):
    got = {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in token_files.op12_token_files(spark, "/root/testdata/sf0.001").collect()}
    assert got == expected([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])


@pytest.fixture
def many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_token_files_odd(spark, odd, empty, tmp_path, many_files):
    hot = spark.createDataFrame([(5, f"text {i}") for i in range(300)] + [(None, "nothing")] * 3 + [(9, "last"), (1, "first")], "doc_id long, text string")
    for name, docs in (("odd", odd), ("hot", hot)):
        path = f"file://{tmp_path}/{name}"
        token_files.write_ids(docs.repartition(3), path, BYTES)
        got = token_files.digests(spark, path).collect()
        spans = sorted((r.start, r.start + r.n_tokens) for r in got)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        want = expected([(r.doc_id, r.text) for r in docs.collect()])
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, n, crc) for i, found in want.items() for _, n, crc in found)
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is None, i or 0))
    assert len({r.part for r in token_files.read_ids(spark, path).where("doc_id = 5").select("part").distinct().collect()}) > 1  # one doc_id in several files
    path = f"file://{tmp_path}/empty"
    token_files.write_ids(empty, path, BYTES)
    assert token_files.digests(spark, path).count() == 0


def scanned(df):
    """Rows that the scan of a collected frame gave on, and its splits."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    node = df._jdf.queryExecution().executedPlan()
    found = node.collectLeaves()
    return found.head().metrics().get("numOutputRows").get().value(), plan


def test_token_files_are_split_and_pruned(spark, tmp_path):
    texts = spark.range(40_000).selectExpr("id * 3 doc_id", "concat('some words of number ', id) text")
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(texts.coalesce(1), path, BYTES, group=1_000, stripe=100_000)
    whole = token_files.read_ids(spark, path)
    assert whole.count() == 40_000
    rows, plan = scanned(token_files.read_ids(spark, path, [3 * 20_000]))
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan
    assert 1 <= rows <= 2_000  # the row index leaves a group or two
    rows, _ = scanned(token_files.read_ids(spark, path, [3 * 20_000 + 1]))
    assert rows == 0  # between two doc_ids of a group: only the Bloom filter can tell
    found = token_files.read_ids(spark, path, [3, 60_000, 119_997]).collect()
    assert {r.doc_id: [x & 0xFFFFFFFF for x in r.ids] for r in found} == {i: ids(f"some words of number {i // 3}") for i in (3, 60_000, 119_997)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        split = token_files.read_ids(spark, path).selectExpr("doc_id", "part", "spark_partition_id() task").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(split) == 40_000 and len({(r.part, r.task) for r in split}) > len({r.part for r in split})  # stripes of a file in several tasks


# ---- spelling variants ----------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n, times=10):
    """word -> (form, root, n, n_near, form_n), every pair of words compared."""
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w in n:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= times * n[w] else None, len(others))

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, root(w), n[w], k, n[form] if form else None) for w, (form, k) in out.items()}


def counted(rows, shortest=7, least=2):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: k for w, k in seen.items() if len(w) >= shortest and k >= least}


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_of_the_table(spark, small):
    got = as_dict(spelling.op13_spelling(spark, "/root/testdata/sf0.001"))
    words = counted([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    assert len(words) > 1_000 and got == grouped(words)
    assert any(form for form, *_ in got.values())


def test_word_counts_odd(spark, odd, empty):
    got = {r.word: r.n for r in spelling.word_counts(odd, shortest=1, least=1, edit=spelling.dropped_letter).collect()}
    assert got == counted([(r.doc_id, r.text) for r in odd.collect()], 1, 1)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    short = spark.createDataFrame([("abc", 30), ("abcd", 3), ("abce", 30), ("", 4)], "word string, n long")
    assert {w: r[0] for w, r in as_dict(spelling.variants(short)).items()} == {"abc": None, "abcd": "abce", "abce": None, "": None}
    nulls = spark.createDataFrame([(None, "Ünique ÜNIQUE unique")] * 3, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(nulls, 6, edit=lambda i, w: 0).collect()} == {"Ünique": 6, "unique": 3}
    assert spelling.word_counts(spark.createDataFrame([(1, "x" * 400_000 + " " + "word " * 200_000)], "doc_id long, text string"), 4).collect()[0].n == 200_000


def test_chains_ties_and_hot_forms(spark):
    n = {"aaaaaaa": 10**6, "aaaaaab": 10**5, "aaaaabb": 10**4, "aaaabbb": 10**3, "aaabbbb": 100, "aabbbbb": 10, "abbbbbb": 1}  # each an edit from the one before
    n |= {"letters": 50, "lettres": 5, "lettera": 50, "letterz": 5, "lettersz": 5, "aletters": 4, "ltters": 4, "leetters": 5, "bletters": 6}
    hot = "commonword"
    n |= {hot: 10**6} | {hot[:i] + c + hot[i:]: 2 for i in range(len(hot) + 1) for c in "abcdefghijklmnopqrstuvwxyzéüß"}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = as_dict(spelling.variants(df))
    assert got == grouped(n)
    assert got["abbbbbb"][:2] == ("aabbbbb", "aaaaaaa") and got["letterz"][0] == "lettera" and got[hot][3] == sum(near(hot, w) for w in n)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=4, max_size=12), st.integers(0, 12), st.integers(0, 2), st.sampled_from("abéz"), st.lists(st.text("abéz", min_size=4, max_size=12), max_size=6))
def test_near_words_always_meet(word, at, how, letter, others):
    at %= len(word)
    other = word[:at] + ("" if how == 0 else letter) + word[at + (how < 2) :]
    words = {word, other, *others}
    grams = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    ranks = {g: i for i, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (x[1], x[0])))}
    keys = {w: spelling.keys(w, ranks) for w in words}
    if other != word and len(other) >= 4:
        a, b = sorted((word, other), key=len, reverse=True)
        longer = {k for long, k in keys[a] if long}
        assert any(k in longer and long == (len(a) == len(b)) for long, k in keys[b])
