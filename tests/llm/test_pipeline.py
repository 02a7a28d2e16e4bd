"""The pipeline's stages on the smallest tables, each against what its operator decides on its own input."""

import re

import pytest

import corpus_pipeline
from quadrille.llm import decontamination, packing, simhash, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(base / str(k)))
        after = spark.read.parquet(str(base / str(k)))
        out.append((docs, after))
        docs = after
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(after.dtypes == columns for _, after in stages[:-1])


def test_each_stage_keeps_what_its_operator_keeps(spark, stages):
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    before, after = stages[0]
    assert ids(after) == ids(toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0"))
    before, after = stages[1]
    assert ids(after) == ids(simhash.near_duplicates(before).where("doc_id = component_id"))
    before, after = stages[2]
    spans = {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.repeated_spans(before).collect()}
    assert {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after.collect()} == spans
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = stages[3]
    found = set(ids(decontamination.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")))) 
    assert found and ids(after) == [d for d in ids(before) if d not in found]
    before, after = stages[4]
    assert set(ids(after)) == set(ids(before)) and after.count() == packing.pack(before).count()


def test_run_gives_the_last_stage(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1][1])
