import corpus_pipeline
from sievemark.llm.shared import table, written

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, SF), name)
        assert after.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids and 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_odd_documents_pass_through(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "some words in a text without a copy", "en", None, None), (3, "!!", "en", "s", 2), (4, "a b c d e f " * 5000, "en", "s", 1), (4, "a b c d e f " * 5000, "en", "s", 1), (5, "wholly other words that no other text has", "de", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "own", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, piece string, __key string, own string, __lines int")
    for some in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            some = written(stage(spark, some, SF), name)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = written(stage(spark, left, SF), name)
        assert left.columns == docs.columns
    assert all((r.row, r["__key"], r.own, r["__lines"]) == ("x", "z", "own", 1) for r in left.collect())
    assert sorted(str(r.doc_id) for r in left.collect()) == ["4", "5", "None"]
