"""The pipeline's stages, each held against a plain version of what it should keep."""

import re

import corpus_pipeline
from basalt.llm import linededup, queries
from tests import oracle
from tests.llm.test_contract import jaccard, leaks

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(str(tmp_path / f"{k}"))
        after = {r.doc_id: r for r in docs.collect()}
        assert {*after} <= {*before}
        if name != "bpe_encoding":
            assert docs.columns == columns
        if name == "quality_classifier":
            good = {r.doc_id for r in queries.op1_quality_classifier(spark, SF).where("predicted = 1").collect()}
            assert {*after} == good
        elif name == "line_dedup":
            c = oracle.duckdb.connect()
            c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k - 1}/*.parquet')")
            want = {i: t for i, t, n in c.execute(linededup.SQL).fetchall() if not n or t.strip()}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        elif name == "ngram_jaccard_join":
            comp = jaccard([(i, r.text) for i, r in before.items()])
            assert {*after} == {i for i, (_, c) in comp.items() if c == i}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {*after} == {*before} - {i for i, _ in leaks([(i, r.text) for i, r in before.items()], items)}
        else:
            from tokenizers import Tokenizer

            from basalt.llm.bpe import default_vocabulary

            ref = Tokenizer.from_file(default_vocabulary())
            assert {*after} == {*before}
            for r in after.values():
                assert len(r.token_ids) == 4 * r.n_tokens and r.n_tokens == len(ref.encode(r.text, add_special_tokens=False).ids)


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "token_ids", "n_tokens"} <= {*out.columns}
    assert not re.search("MapInArrow", out._jdf.queryExecution().toString())


def test_stages_on_edges(spark):
    """Nulls, repeated ids, empty and equal texts, extra columns and no n_chars; then no rows at all."""
    rows = [(k, t, "en", k) for k, t in enumerate([None, "", " \n", "x", "one two three four five six. " * 40, "one two three four five six. " * 40, "a\nb\nc\nd", "a\nb\nc\nd"])]
    rows += [(None, "no id at all", None, None), (3, "x", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n_removed long")
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, stage(spark, at, SF)
            if name != "bpe_encoding":
                assert at.columns == start.columns
            if name == "quality_classifier":  # its decision is not the matter here: the next stages see every row
                assert at.count() <= before.count()
                at = before
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_tokens) for r in at.collect())
        if start is docs:
            assert [g[:2] for g in got] == [(False, k) for k in (0, 1, 2, 3, 3, 4, 6)] + [(True, 0)]
            assert all(n == 0 for _, _, t, n in got if not t)
        else:
            assert got == []
