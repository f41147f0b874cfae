"""Rules: held-out accuracy, the compiled column against the rules read plainly, odd inputs."""

import math
import zlib

import numpy as np
import pytest

from wiretrace.llm.common import id_text
from wiretrace.llm.rules import _lasso, fit, quality, train, with_statistics

SF = "/root/testdata/sf0.1"


def test_held_out_and_compiled_column(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = train(docs, labels)
    label = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality(docs, rules).collect()}
    held = [k for k in label if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].predicted == label[k] for k in held]) > 0.97
    rows, names = with_statistics(id_text(docs))
    for r in rows.limit(300).collect():
        z = rules.base + sum(w for rule, w in rules.rules if all((r[c.name] > c.border) == c.above for c in rule))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert 0 < len(rules.rules) < 200


def test_lasso_optimum():
    rng = np.random.default_rng(2)
    r = (rng.random((400, 6)) < 0.4).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 2 * r[:, 1])))).astype(float)
    w, b = _lasso(r, y)

    def loss(w, b):
        z = r @ w + b
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.001 * np.abs(w).sum()

    here = loss(w, b)
    for k in range(6):
        for d in (0.05, -0.05):
            v = w.copy()
            v[k] += d
            assert loss(v, b) >= here - 1e-5
    assert w[0] > 1 and w[1] < -1


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(k, "buy !!! " * 9 if k % 2 else "a plain text of words. " * 5, 3) for k in range(80)] + [(None, None, 1), (90, "", 1), (91, None, 1), (91, None, 1), (92, "x" * 200_000, 1), (93, "| \n" * 9999, 1)], "doc_id long, text string, stat_upper int")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)] + [(None, 1), (90, None)], "doc_id long, quality int")
    got = quality(docs, train(docs, labels)).collect()
    assert len(got) == 86 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[2] == 1 and by[3] == 0
    one = train(docs, labels.where("quality = 1"))
    assert one.rules == [] and quality(docs.limit(0), one).collect() == []
    assert fit(np.zeros((0, 1)), np.zeros(0), ["s"]).rules == []
