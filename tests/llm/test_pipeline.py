"""The pipeline's stages one after another; the registered queries and their contract."""


import corpus_pipeline as pipeline
import __spark_entry__ as E
from tabulo.llm import linededup, neardup
from tabulo.llm.common import table


SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.stored(stage(spark, docs, SF))
        assert after.columns == docs.columns, name
        if name == "line_dedup":
            assert after.count() == docs.count()
            assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in linededup.remove_similar_lines(docs).collect()}
        if name == "near_dedup":
            kept = {r.doc_id for r in neardup.near_duplicates(docs).collect() if not r.n_shingles or r.doc_id == r.component_id}
            assert {r.doc_id for r in after.collect()} == kept
        if name == "decontaminate":
            left = {r.doc_id for r in after.collect()}
            assert all((r.doc_id not in left) == any(i in r.text for i in items) for r in docs.collect())
        docs = after
    done = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in docs.collect()} == {r.doc_id: r.decoded for r in done} and all(r.n_tokens == len(r.ids) for r in done)


def test_empty_and_odd_tables(spark, odd, nothing):
    documents = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (nothing, odd):
        for _, stage in pipeline.STAGES:
            docs = pipeline.stored(stage(spark, docs.select(*documents) if "text" in docs.columns else docs, SF))
        assert docs.count() <= odd.count()


def test_queries_are_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names

