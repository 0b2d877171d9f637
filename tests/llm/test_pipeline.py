import public_tokenizers

import corpus_pipeline
from lodestrata.llm import near_dedup, quality_rules, toxicity


def test_stages(spark, small, labels, tmp_path):
    """Each stage, on what the one before it kept, gives what its operator says; the last packs every token."""
    sf, docs, seen = "/root/testdata/sf0.001", small, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality rules":
            want = {r.doc_id for r in quality_rules.quality_rules(before, public_tokenizers.path("piece_bpe_32k.model")).where("kept").collect()}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(before, labels).where("not toxic").collect()}
        elif name == "near-dedup":
            want = {r.doc_id for r in near_dedup.near_duplicates(before, 2, 80).where("kept").collect()}
        else:
            want = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids == want
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == small.columns
        seen.append(name)
    assert seen == ["quality rules", "toxicity", "near-dedup", "suffix-array dedup", "packing"]


def test_last_stages_against_plain_python(spark, small, tmp_path):
    """Near-dedup by all pairs, passages by cutting repeated windows, packing by the library's ids, each on the stage's own input."""
    import zlib

    import numpy as np
    from test_documents import linked, repeated
    from tokenizers import Tokenizer

    from lodestrata.llm import suffix_dedup

    sf, docs = "/root/testdata/sf0.001", small
    kept = corpus_pipeline.deduplicated(spark, docs, sf)
    kept.write.parquet(str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a"))
    groups = linked([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    want = {i for i, (n, first) in groups.items() if first == i or n == 0}
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want) < docs.count()
    corpus_pipeline.without_passages(spark, docs, sf).write.parquet(str(tmp_path / "b"))
    cut = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    spans = {}
    for (i, start), end in repeated([(r.doc_id, r.text) for r in docs.collect()]).items():
        spans.setdefault(i, []).append((start, end))
    assert spans
    for r in docs.collect():
        text = suffix_dedup.cut(r.text, spans[r.doc_id]) if r.doc_id in spans else r.text
        assert cut[r.doc_id].text == text and cut[r.doc_id].n_chars == (len(text) if r.doc_id in spans else r.n_chars)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            pieces[r.doc_id, n] = (at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))
    got = corpus_pipeline.packed(spark, docs, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)


def test_odd_rows_pass(spark, odd, empty, tmp_path):
    clash = odd.withColumnsRenamed({"kept": "_row", "n_tokens": "_key"})
    for name, docs in (("odd", odd), ("empty", empty), ("clash", clash)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))


def test_rows_are_judged_by_their_own_text(spark, small):
    """Rows with a null or a shared doc_id aren't kept for another row's sake, lose their copies and passages like all others."""
    prose = [r.text for r in small.where("lang = 'en' and n_chars between 1500 and 4000").orderBy("doc_id").limit(3).collect()]
    columns = small.columns
    odd = [(None, "", "en", "s", 0), (None, "one two", "en", "s", 7), (None, "for " * 300, "en", "s", 1200), (7_000_000, prose[0], "en", "s", 1), (7_000_000, "one", "en", "s", 3)]
    rows = spark.createDataFrame(odd + [(None, prose[1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    got = corpus_pipeline.quality(spark, small.select(*columns).unionByName(rows), "")
    texts = {r.text for r in got.where("doc_id is null or doc_id = 7000000").collect()}
    assert texts == {prose[0], prose[1]} and got.columns == columns

    words = [f"a{i} b{i * i}" for i in range(90)]
    base, other = " ".join(words), " ".join(f"z{i} y{i}" for i in range(90))
    many = [(None, base), (None, base + " end"), (5, base), (5, other), (None, other), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in many], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.deduplicated(spark, docs, "").collect()))
    assert got == sorted([(5, base), (5, other), (0, ""), (0, "")])

    passage = " ".join(f"p{i}" for i in range(60))
    many = [(None, f"{passage} u v"), (9, f"{passage} s t"), (9, f"k l {other}"), (3, f"a b {passage}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in many], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.without_passages(spark, docs, "").collect()))
    assert got == sorted([(0, "u v"), (9, "s t"), (9, f"k l {other}"), (3, f"a b {passage}")])
