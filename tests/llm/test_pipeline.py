from collections import Counter
from itertools import pairwise

import corpus_pipeline
from moraine.llm import decontaminate, jaccard, mixing, pii, quality


def test_stages_one_by_one(spark, small, tmp_path):
    """Each stage's rows against its operator over what the stage before it left."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], small).write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(o.columns == docs.columns for o in out[:-1]) and out[-1].columns == [*docs.columns, "copy"]
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in out]
    assert all(b <= a for a, b in pairwise(ids))
    assert ids[1] == {r.doc_id for r in quality.clean(docs).collect()}
    assert ids[1] - ids[2] == {r.doc_id for r in jaccard.near_copies(out[1]).collect()}
    assert jaccard.near_copies(out[2]).isEmpty()
    assert ids[2] - ids[3] == {r.doc_id for r in decontaminate.leaks(out[2], spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] and pii.identifiers(out[4]).isEmpty() and not pii.identifiers(out[3]).isEmpty()
    whole = Counter(r.doc_id for r in mixing.mix(out[4]).select("doc_id").collect())
    assert Counter(r.doc_id for r in out[5].select("doc_id").collect()) == whole
    run = Counter(map(str, corpus_pipeline.run(spark, small).collect()))
    assert run == Counter(map(str, out[5].collect()))


def test_odd_documents(spark, odd, none, small, tmp_path):
    for k, docs in enumerate((odd, none)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
        assert set(docs.columns) == set(odd.columns)
        docs.collect()
