import numpy as np

from wardspark.llm import quality

from .conftest import HARD

SAMPLE = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    labels = spark.read.parquet(f"{SAMPLE}/labels.parquet")
    got = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    scores, marks = np.array([r.score for r in got]), np.array([r.quality for r in got])
    assert len(got) > 30 and auc(scores, marks) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def marked(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_hard_texts_and_odd_labels(spark, make_docs):
    docs = make_docs([*HARD, *["good words in a row"] * 30, *["BAD$$$ BAD$$$"] * 30, "good words"], extra=True)
    n = len(HARD)
    rows = [(i, int(i < n + 30), 0) for i in range(n, n + 60)]
    labels = marked(spark, rows + rows[:5] + [(None, 1, 0), (n, 0, 0), (n + 1, None, 0), (n + 2, 7, 0)])
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == n + 61
    assert got[n + 60].predicted == 1 and got[n + 31].predicted == 0
    assert got[0].score == got[1].score


def test_without_labels_and_empty(spark, make_docs):
    none = marked(spark, [])
    assert {r.score for r in quality.classify(make_docs(["a", None]), none).collect()} == {0.5}
    assert quality.classify(make_docs([]), none).collect() == []


def test_blocks_do_not_change_votes(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcde "), 60)) for _ in range(120)]
    x, y = quality.vectors(texts), np.arange(120) % 3 == 0
    model = quality.QualityModel(x, y)
    whole = model.scores(texts)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert np.allclose(whole, model.scores(texts))
    points = model._unit(model._weigh(x) @ model.project)
    cosines = points @ model.points.T
    top = np.argsort(-cosines, axis=1)[:, : quality.NEIGHBOURS]
    weight = np.clip(np.take_along_axis(cosines, top, 1), 0, 1).astype(float) ** quality.SHARPNESS
    assert np.allclose(whole, (weight * y[top]).sum(1) / weight.sum(1), atol=1e-4)
