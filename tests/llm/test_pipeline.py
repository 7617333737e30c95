"""The pipeline's stages, each with its effect, and the registered queries."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from textloom.llm import ngram_join, packing  # noqa: E402


def test_stages_are_named_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "secrets", "packing"]
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names


def test_run_equals_the_stages_by_hand(spark, data):
    import public_tokenizers

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, data)
        assert made.columns == columns, name
        docs = spark.createDataFrame(made.collect(), docs.schema)
    ids = {r["doc_id"] for r in docs.collect()}
    assert 0 < len(ids) < 200
    assert all(r["n_links"] == 0 for r in ngram_join.near_texts(docs).collect() if r["doc_id"] in ids)
    encode = packing.encoder(packing.json_ranks(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN).encode_ordinary
    want = {r["doc_id"]: len(encode(r["text"])) + 1 for r in docs.collect()}
    found = {}
    for r in corpus_pipeline.run(spark, data).collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == want


def test_toxic_documents_go_and_clean_ones_stay(spark, labelled, tmp_path):
    docs, labels = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert np.mean([i in kept for i, t in toxic.items() if not t]) > 0.97
    assert np.mean([i in kept for i, t in toxic.items() if t]) < 0.1
