"""The mix of rows whose ids repeat or are null."""

from collections import Counter

from intronaut.llm import mixing

DOCS = "doc_id long, text string, source string, target string"


def test_mix_emits_each_rows_own_copies(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(10))
    # one source far over its share: a rate well below 1
    rows = [(None, text(i), "z", "t") for i in range(400)] + [(7, text(i), "z", "t") for i in range(400, 500)] + [(i, text(i), "a", "t") for i in range(1000, 1020)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = mixing.mix_sources(docs).groupBy("source").sum("copies").collect()
    got = mixing.emitted(docs)
    assert got.columns == [*docs.columns, "copy"]
    got = got.collect()
    assert Counter(r.source for r in got) == {r[0]: r[1] for r in want}
    assert 0 < sum(r.doc_id is None for r in got) < 400
    assert Counter((r.doc_id, r.text, r.source, r.target) for r in got).keys() <= set(rows)
