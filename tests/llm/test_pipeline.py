import corpus_pipeline
from intronaut.scratch import materialize


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, size = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "substring_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= size
        size = docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.select("doc_id").distinct().count() == size


def test_empty_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
    assert docs.count() == 0
