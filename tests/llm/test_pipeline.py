import corpus_pipeline as C
from strandflow.llm import lm, neardup, pii
from strandflow.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString(), name
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= set(seen) and len(rows) > 0.7 * len(seen), name
        if name == "near_dedup":
            kept = {r.doc_id for r in neardup.near_duplicates(docs, 5).where("kept").collect()}
            assert set(rows) == kept
        if name == "pii":
            again = pii.digest(pii.find(spark.createDataFrame(list(rows.values()), docs.schema))).collect()
            assert all(r.n_email == r.n_ip == r.n_card == r.n_phone == 0 for r in again)
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text != seen[r.doc_id].text)
        else:
            assert all(rows[i] == seen[i] for i in rows)
        docs, seen = spark.createDataFrame(list(rows.values()), docs.schema), rows
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(seen)
    assert sum(p.length for p in pieces if p.sequence_id == 0) == 4096


def test_run_equals_its_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {p.doc_id: p.doc_tokens for p in C.STAGES[-1][1](spark, docs, SF).collect()}
    assert {p.doc_id: p.doc_tokens for p in C.run(spark, SF).collect()} == want


def test_odd_and_empty_tables(spark, odd_docs):
    for name, stage in C.STAGES[1:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns and 0 < out.count() <= odd_docs.count(), name
        assert stage(spark, odd_docs.limit(0), SF).count() == 0, name
    assert lm.held_out_fold(4, 2) is not None
