"""Toxicity as an ordinal severity by cumulative-link regression.

Grades 0 to 3 have one weight vector and ordered thresholds: P(grade > k) is the logistic of
weight . features - threshold[k]. A document's severity is its expected grade.

Features are words of letters and digits (A-Z lower-cased) that tell toxic training documents
from others, with log(1 + count) as the value.

Labels say only toxic or not. The grade of a toxic training document follows how often it uses
*marker* words, those at least ``MARKER_LIFT`` times as common among toxic documents: grade 1 up
to 2 uses, 2 up to 6, 3 beyond; other documents have grade 0.

Learning uses at most ``SAMPLE`` labelled rows (those with the smallest hash of their id); word
counts over them are aggregated in Spark, and only the ``FEATURES`` chosen words and the sample's
counts of those reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored
from .words import NOT_ALNUM, Words, pieces

SAMPLE = 20_000
FEATURES = 400
LEAST_DOCS = 5
MARKER_LIFT = 10
GRADE_USES = (2, 6)


@dataclass
class Severity:
    codes: np.ndarray  # hashes of the feature words, sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probabilities of exceeding each threshold."""
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -60, 60)))
        return above.sum(1), above


def _word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word."""
    with np.errstate(over="ignore"):
        w = Words(column, lower=True, breaks=NOT_ALNUM)
        return w.row(), w.hashes().view(np.int64)


def _counts(docs: DataFrame, extra: str, codes: np.ndarray | None = None) -> DataFrame:
    """doc_id, the ``extra`` column, code, n: how often each word occurs in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            row, code = _word_codes(part.column(1))
            if codes is not None:
                at = np.searchsorted(codes, code)
                hit = codes[np.minimum(at, len(codes) - 1)] == code if len(codes) else np.zeros(len(code), bool)
                row, code = row[hit], code[hit]
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else row
            n = np.diff(np.concatenate((begin, [len(row)])))
            take = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), pa.array(code[begin], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", extra, "code", "n"])

    return docs.select("doc_id", "text", extra).mapInArrow(run, f"doc_id long, {extra} int, code long, n long")


def fit(x_row: np.ndarray, x_col: np.ndarray, x: np.ndarray, grade: np.ndarray, features: int, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient descent on the cumulative
    likelihood: the sum over thresholds of the logistic loss of (grade > k)."""
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    weights, thresholds = np.zeros(features), np.arange(1.0, max(top, 1) + 1) * 2
    over = (grade[:, None] > np.arange(len(thresholds))[None, :]).astype(float)
    share = np.clip(over.mean(0), 1e-6, 1 - 1e-6) if n else np.full(len(thresholds), 0.5)
    thresholds = np.log((1 - share) / share)
    if not n or not len(x):
        return weights, np.maximum.accumulate(thresholds)
    # The step is halved whenever the loss grows; the search then goes on from the last good point.
    w, t, w0, t0, step, momentum, best = weights, thresholds, weights, thresholds, 8.0, 1.0, np.inf
    for _ in range(rounds):
        z = np.bincount(x_row, x * w[x_col], n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))
        loss = -np.where(over > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12)).sum() / n + ridge * (w * w).sum() / 2
        if loss > best:
            w, t, step, momentum, best = w0, t0, step / 2, 1.0, np.inf
            continue
        best = loss
        slope = (p - over) / n
        w1 = w - step * (np.bincount(x_col, slope.sum(1)[x_row] * x, features) + ridge * w)
        t1 = np.maximum.accumulate(t + step * slope.sum(0))
        ahead = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        rate = (momentum - 1) / ahead
        w, t = w1 + rate * (w1 - w0), np.maximum.accumulate(t1 + rate * (t1 - t0))
        w0, t0, momentum = w1, t1, ahead
    return w0, t0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: bool = True, sample: int = SAMPLE) -> Severity:
    """A severity model. With ``held_out`` rows whose crc32(doc_id as text) mod 5 is 0 are kept
    out of learning. Rows with a null label or id teach nothing; without toxic rows every
    document gets severity 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stored(id_text(docs).join(F.broadcast(known), "doc_id"), "severity-sample")
    size = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = size["n"], size["toxic"] or 0
    if not toxic or toxic == n:
        return Severity(np.zeros(0, np.int64), np.zeros(0), np.array([60.0]))
    words = _counts(rows, "label").groupBy("code").agg(F.count("*").alias("docs"), F.sum("label").alias("toxic")).where(F.col("docs") >= LEAST_DOCS)
    lift = (F.col("toxic") + 0.5) / toxic / ((F.col("docs") - F.col("toxic") + 0.5) / (n - toxic))
    # How far the toxic count is from what chance gives, in standard deviations.
    far = (F.col("toxic") - F.col("docs") * (toxic / n)) / F.sqrt(F.col("docs") * (toxic / n) * (1 - toxic / n))
    chosen = words.select("code", lift.alias("lift"), far.alias("far")).orderBy(F.abs("far").desc(), "code").limit(FEATURES).collect()
    codes = np.array(sorted(r["code"] for r in chosen), np.int64)
    markers = np.isin(codes, [r["code"] for r in chosen if r["lift"] >= MARKER_LIFT and r["far"] > 4])
    got = _counts(rows, "label", codes).select("doc_id", "code", "n").toArrow()
    keyed = rows.select("doc_id", "label").toArrow().sort_by("doc_id")
    ids, label_ = keyed["doc_id"].to_numpy(), keyed["label"].to_numpy()
    x_row, x_col, uses = np.searchsorted(ids, got["doc_id"].to_numpy()), np.searchsorted(codes, got["code"].to_numpy()), got["n"].to_numpy()
    marked = np.bincount(x_row, uses * markers[x_col], len(ids))
    grade = np.where(label_ > 0, 1 + (marked > GRADE_USES[0]) + (marked > GRADE_USES[1]), 0)
    weights, thresholds = fit(x_row, x_col, np.log1p(uses), grade, len(codes))
    return Severity(codes, weights, thresholds)


def severity(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, severity (expected grade), grade (the grade whose threshold is passed with
    probability one half) and toxic (grade above 0) of every row.

    A null or empty text has no words and gets the severity of the thresholds alone; repeated rows
    stay; an empty table gives no rows. The model holds at most ``FEATURES`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            n = part.num_rows
            row, code = _word_codes(part.column(1))
            z = np.zeros(n)
            if len(model.codes) and len(code):
                at = np.minimum(np.searchsorted(model.codes, code), len(model.codes) - 1)
                hit = model.codes[at] == code
                key, uses = np.unique(row[hit] * len(model.codes) + at[hit], return_counts=True)
                z = np.bincount(key // len(model.codes), np.log1p(uses) * model.weights[key % len(model.codes)], n)
            expected, above = model.expected(z)
            grade = (above > 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(grade, pa.int32()), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "toxic"])

    return id_text(docs).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")
