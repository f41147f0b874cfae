"""Severity: held-out accuracy on the sample, a fit against brute force, odd inputs."""

import zlib

import numpy as np

from wiretrace.llm.ordinal import fit, severity, train

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = [r for r in severity(docs, model).join(labels.select("doc_id", "quality", labels["toxic"].alias("label")), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    caught = [r.toxic for r in rows if r.label == 1]
    wrong = [r.toxic for r in rows if r.label == 0]
    # about a quarter of the labels of toxic rows are noise: no word tells them from others
    assert np.mean(caught) > 0.6 and np.mean(wrong) < 0.01
    assert all(0 <= r.severity <= 3 for r in rows)


def test_fit_finds_the_optimum():
    rng = np.random.default_rng(1)
    n = 300
    x = rng.random((n, 2)) * (rng.random((n, 2)) < 0.7)
    grade = np.digitize(3 * x[:, 0] - 2 * x[:, 1] + rng.logistic(size=n) * 0.5, [0.2, 1.2])
    row, col = np.nonzero(x)
    w, t = fit(row, col, x[row, col], grade, 2)

    def loss(w, t):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :])))
        over = grade[:, None] > np.arange(len(t))
        return -np.where(over, np.log(p), np.log(1 - p)).sum() / n + 1e-3 * (w @ w) / 2

    here = loss(w, t)
    for k in range(4):
        for d in (0.05, -0.05):
            p = np.concatenate((w, t))
            p[k] += d
            assert loss(p[:2], p[2:]) >= here - 1e-6


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(k, "you Idiot, idiot!" if k % 2 else "all is well", 1) for k in range(60)] + [(None, "idiot", 1), (70, None, 1), (71, "", 1), (71, "", 1), (72, "fine " * 9999 + "IDIOT", 1)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (70, None), (1, 1)], "doc_id long, toxic int")
    got = severity(docs, train(docs, labels)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 65 and by[1].toxic and by[72].toxic and not by[2].toxic and not by[70].toxic and by[None].toxic
    none = train(docs, labels.where("toxic = 0"))
    assert not any(r.toxic for r in severity(docs, none).collect())
    assert severity(docs.limit(0), none).collect() == []
    assert train(docs.limit(0), labels).codes.size == 0
