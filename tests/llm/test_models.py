"""Toxicity and language identification: accuracy on held-out rows, gradients, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from intronaut.llm import language_id, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxic_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert (hit.predicted == 1).mean() > 0.8 and (clean.predicted == 1).mean() < 0.01
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_toxicity_edge_cases(spark):
    rnd, rows, labels = random.Random(2), [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([*(rnd.choice("abcdefgh") for _ in range(20)), *(["idiot"] if bad else [])]), "en", "s", 0.5))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0.1), (None, "an idiot", "en", "s", 0.1), (5, "a b c", "en", "s", 0.2)]
    labels += [(None, 1, 1), (1000, 1, None), (2000, 0, 1), (5, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxic_documents(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert by[1000].score == by[1001].score and by[None].predicted == 1
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    blind = toxicity.toxic_documents(docs, marks.limit(0)).collect()
    assert {(r.score, r.predicted) for r in blind} == {(0.0, 0)}
    assert toxicity.toxic_documents(docs.limit(0), marks).count() == 0


def test_network_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_id.initial(3, rng).items()}
    data, lengths, labels = rng.integers(0, 256, (4, 10)).astype(np.uint8), np.array([10, 4, 7, 1]), np.array([0, 1, 2, 1])
    _, g = language_id.gradients(p, data, lengths, labels)
    for k in ("uf", "ub", "o", "q", "cf", "xb"):
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k != "xb" else (data[0, 0], 3)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        numeric = (language_id.gradients(up, data, lengths, labels)[0] - language_id.gradients(down, data, lengths, labels)[0]) / 2e-3
        assert g[k][at] == pytest.approx(numeric, abs=2e-4)


def test_stretches_cover_whole_texts():
    column = pa.array(["x" * 200, None, "", "é" * 40])
    found = list(language_id.stretches(column))
    assert np.bincount(np.concatenate([f[1] for f in found]), weights=np.concatenate([f[3] for f in found]), minlength=4).tolist() == [200, 0, 0, 80]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "le chat est une bête " * 3, "en" if i % 2 else "fr", "x") for i in range(60)]
    rows += [(3, "the cat and the dog " * 3, "en", "x")] * 900  # one document, however often it comes
    rows += [(200, "zzyzx qqxq vvjk " * 4, "rare", "x"), (100, None, "en", "x"), (101, "", "en", "x"), (102, "123 ?! --", "en", "x"), (103, "the dog", None, "x"), (None, "the dog", "en", "x"), (3, "the dog", "en", "x"), (104, "the dog " * 20_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (100, 101, 102)) and by[104].lang_pred == "en"
    assert by[None].held_out is False
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs.lang_pred.substr(1, 0)).where("false")).collect()} == set()
