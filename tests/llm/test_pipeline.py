"""The pipeline against its stages applied by brute force."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import language_id
from framewright.session import table
from tests.llm.test_documents import brute_hits, brute_lines
from tests.llm.test_near_dedup import exact_classes


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    told = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r in rows if told[r[0]]["lang_pred"] != "und" and told[r[0]]["score"] >= corpus_pipeline.LEAST_SCORE]
    assert len(rows) > 0.9 * docs.count()
    rows = [(i, t) for i, t, *_ in brute_lines(rows, 10)]
    classes = exact_classes(rows)
    rows = [r for r in rows if classes[r[0]] == r[0]]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [r for r in rows if not brute_hits(r[1], items, 10)[-1]]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (ids := lib.encode(t, add_special_tokens=False).ids, lib.decode(ids, skip_special_tokens=False)) for i, t in rows}
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_stages_take_empty_tables_and_odd_rows(spark, sf_dir, odd, nothing):
    for docs in (nothing, odd):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf_dir)
            assert name == "bpe" or made.columns == corpus_pipeline.COLUMNS
            made.count()


def test_one_row_stays_of_exact_copies(spark, sf_dir):
    rows = [(k, f"copies of {n}", "en", "s", 1) for n, first in ((10, 0), (1000, 100)) for k in range(first, first + n)]
    rows += [(5000, "another text of its own", "en", "s", 1), (5001, "\n", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_stage(spark, corpus_pipeline.line_stage(spark, docs, sf_dir), sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(0, ""), (5000, "another text of its own"), (5001, "\n")]
