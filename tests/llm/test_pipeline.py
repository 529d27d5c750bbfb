"""The pipeline against its stages done one after the other in plain Python."""

import os
import sys

import pyarrow as pa
import pytest

import corpus_pipeline
from newstide.llm import packing, quality, toxicity
from tests.llm.test_near_dups import brute
from tests.llm.test_quality import plain

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dups", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.assess(docs, labels).collect()}
    left = [r for r in docs.collect() if score[r.doc_id] < 0.7]
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in left)
    refs = quality.references(quality.histograms(first))
    kept = {r.doc_id for r in quality.judge(quality.measure(first), refs).where("kept").collect()}
    assert kept <= {r.doc_id for r in left if not plain(r.text)[5]}
    left = [r for r in left if r.doc_id in kept]
    left = {i for i, _, c in brute([(r.doc_id, r.text) for r in left]) if i == c}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == left
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i in left)


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"the word{k}" for k in range(80))
    rows = [(None, text, None, None, None), (1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, None, None, "s", 0), (4, "", "xx", None, 0), (5, " ".join(f"of x{k}" for k in range(3000)), "de", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == {None, 1, 5}
    empty = corpus_pipeline.STAGES
    for _, stage in empty:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert packing.WINDOW == 2048


def test_workers_drop_the_tables_of_other_operators(spark):
    """Each worker that scores holds nothing of the packing before; else executors grow from stage to stage."""
    docs = spark.createDataFrame([(k, f"the word{k} of it") for k in range(40)], "doc_id long, text string").repartition(4)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in sys.__dict__.get("_newstide_kept", {})]})

    def kinds():
        return {r.kind for r in docs.mapInArrow(held, "kind string").collect()}

    packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    assert "hf" in kinds()
    for _ in range(3):  # every idle worker takes a task
        toxicity.score(docs, toxicity.fit([], [])).collect()
    assert "hf" not in kinds()
