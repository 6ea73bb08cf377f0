import random

import numpy as np
import pytest

from rankloom.llm import language_id as li

WORDS = {"en": "the and of that with for was this have from".split(), "de": "der und ist nicht mit eine für über schön größe".split(), "fr": "le la est dans une être où élève que ça".split()}


def rows(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "e", "en", "s"]) for _ in range(rng.randint(5, 40))), lang))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = frame(spark, rows())
    model = li.train(docs)
    got = li.predict(docs, model, ["doc_id", "lang"]).withColumn("held", li.held_out(li.F.col("doc_id"))).collect()
    held = [r for r in got if r["held"]]
    assert 40 < len(held) < 120
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_not_learned(spark):
    data = rows()
    held = {r["doc_id"] for r in frame(spark, data).where(li.held_out(li.F.col("doc_id"))).collect()}
    wrong = [(i, t, "xx" if i in held else lang) for i, t, lang in data]
    assert li.train(frame(spark, wrong)).languages == ("de", "en", "fr")


def test_calibration(spark):
    """With a fifth of the labels wrong, scores stay near the share that is right."""
    rng = random.Random(5)
    data = [(i, t, lang if rng.random() > 0.2 else rng.choice(list(WORDS))) for i, t, lang in rows(900, 3)]
    model = li.fit([t for _, t, _ in data], [x for _, _, x in data])
    p, _ = model.scores([t for _, t, _ in rows(200, 9)])
    assert 0.6 < p.max(axis=1).mean() < 0.999


def test_undetermined(spark):
    docs = frame(spark, [*rows(60), (100, None, "en"), (101, "", None), (102, "123 --- 456", "fr"), (103, "über schön " * 20_000, None), (None, "the and of", None), (103, "x", None)])
    model = li.train(docs)
    got = li.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == 66
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {100, 101, 102} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert [r["lang_pred"] for r in got if r["doc_id"] == 103][0] == "de"


def test_edge_cases(spark):
    none = frame(spark, [])
    model = li.train(none)
    assert model.languages == () and li.predict(none, model, ["doc_id"]).count() == 0
    unlabelled = frame(spark, [(1, "the", None)])
    assert [r["lang_pred"] for r in li.predict(unlabelled, li.train(unlabelled), ["doc_id"]).collect()] == ["und"]
    with pytest.raises(ValueError, match="are added"):
        li.predict(unlabelled.withColumnRenamed("lang", "score"), model, ["score"])
    clash = frame(spark, rows(60)).withColumn("score", li.F.lit("mine"))
    out = li.in_known_language(clash, li.train(clash))
    assert out.columns == clash.columns and out.count() >= 55 and out.first()["score"] == "mine"


def test_sparse_weights():
    data = rows(300)
    dense = li.fit([t for _, t, _ in data], [x for _, _, x in data], l1=0.0)
    sparse = li.fit([t for _, t, _ in data], [x for _, _, x in data], l1=0.05)
    assert (sparse.weights != 0).sum() < 0.8 * (dense.weights != 0).sum()


def test_document_frequencies_of_all_rows(spark):
    texts = [t for _, t, _ in rows(300)] + [None, "", "über " * 30_000]
    df, n = li.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    want = np.zeros(1 << li.FEATURE_BITS)
    for t in texts:
        want[np.unique(li.grams([t])[0])] += 1
    assert n == 303 and (df == want).all()


def test_sample_is_bounded_in_bytes(spark):
    """A few very long texts do not go to the training task together; the model is still there."""
    docs = frame(spark, [*rows(120), *[(1000 + i, "der und ist nicht " * 20_000, "de") for i in range(12)]])
    model = li.train(docs, sample_bytes=300_000)
    assert model.languages == ("de", "en", "fr")
    right = [r["lang"] == r["lang_pred"] for r in li.predict(docs, model, ["lang"]).collect()]
    assert np.mean(right) > 0.9
