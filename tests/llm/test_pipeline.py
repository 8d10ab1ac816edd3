import os
from collections import Counter

import corpus_pipeline
import pytest
from millrace.llm import common, langid, tokens
from millrace.llm.decontaminate import benchmark_overlaps
from millrace.llm.mixing import plan_mix


def test_stages_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            out = out.cache()
        seen[name] = (docs, out)
        docs = out
    before, after = seen["language_id"]
    assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    before, after = seen["benchmark_decontamination"]
    bad = {r["id"] for r in benchmark_overlaps(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()} - bad
    before, after = seen["source_mixing"]
    assert Counter(r[0] for r in after.select("doc_id").collect()) == Counter({r["id"]: r["passes"] for r in plan_mix(before).collect() if r["passes"]})
    before, after = seen["token_output"]
    own = tokens.Encoder(tokens.default_tokenizer())
    want = Counter((r["doc_id"], len(own.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in before.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in after.collect()) == want
    assert spark.read.parquet(f"{sf}/documents.parquet").count() > seen["simhash_near_dedup"][1].count()


def test_language_stage_rejects_what_has_no_letters(spark, odd):
    kept = corpus_pipeline.language_id(spark, odd, "")
    assert kept.columns == odd.columns
    assert {r[0] for r in kept.select("doc_id").collect()}.isdisjoint({3, 4, 5, 11}) and langid.UNDETERMINED == "und"


def test_every_stage_takes_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "/root/testdata/sf0.001").count()


def test_token_files_are_in_training_order(spark, texts, tmp_path):
    rows = [(k, texts(k, 5 + k * 7 % 60), f"s{k % 3}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    mixed.write.parquet(f"{tmp_path}/mixed")
    positions = [p for r in plan_mix(docs).collect() for p in r["positions"]]
    want = [r["doc_id"] for r in mixed.collect()]
    assert len(want) == len(positions) and want != sorted(want)
    for table in (spark.read.parquet(f"{tmp_path}/mixed"), mixed):
        assert [r["doc_id"] for r in corpus_pipeline.token_output(spark, table, "").orderBy("start").collect()] == want


def test_intermediate_data_can_be_cleared(spark):
    made = common.cut(spark.range(5).toDF("x"), "clear-test")
    assert made.count() == 5 and common.clear(spark) >= 1
    assert not os.path.exists(made.inputFiles()[0].removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
