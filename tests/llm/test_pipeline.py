import pytest

import corpus_pipeline
from leadlake.llm import decontaminate, mixing, quality, shingle_join, token_files
from leadlake.llm.work import saved

from . import tables


def test_stages_take_effect(spark, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = saved(stages["quality"](spark, docs, sf_small), "t")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}

    first = saved(stages["near_duplicates"](spark, kept, sf_small), "t")
    groups = shingle_join.shingle_components(kept).collect()
    assert {r.doc_id for r in first.collect()} == {r.component_id for r in groups}

    clean = saved(stages["decontamination"](spark, first, sf_small), "t")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in decontaminate.contamination(first, bench).where("not contaminated").collect()}

    mixed = saved(stages["mixing"](spark, clean, sf_small), "t")
    plan = {r.doc_id: r.repeats for r in mixing.mix(clean).collect() if r.repeats}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == plan
    for df in (kept, first, clean, mixed):
        assert df.columns == columns

    last = sorted(tuple(r) for r in stages["token_files"](spark, mixed, sf_small).collect())
    assert last == sorted(tuple(r) for r in token_files.encode_documents(mixed, token_files.word_bpe()).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_small).collect()) == last


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, sf_small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, tables.none(spark), sf_small).collect() == []
    got = stage(spark, tables.awkward(spark), sf_small)
    if name != "token_files":
        assert got.columns == tables.awkward(spark).columns
    got.collect()


def test_entry_registers_all(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {k.split("_")[0] for k in names}
    assert set(entry.oracle_sql()) <= set(names)
