"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

1. Statistics of a text are Spark expressions (``with_statistics``).
2. Small trees are grown on halves of the labelled sample, each on what the trees before it left
   unexplained; every path from a root is a rule, a conjunction of comparisons of statistics.
3. A logistic regression with an L1 penalty over all rules keeps few of them.
4. The kept rules become one column expression (``RuleSet.score``); scoring is a projection.

Learning uses at most ``SAMPLE`` labelled rows (those with the smallest hash of their id); their
statistics, not their texts, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, release

SAMPLE = 20_000
TREES = 40
DEPTH = 3
LEAST_LEAF = 10
BINS = 32
PENALTY = 0.001
ROUNDS = 400
THRESHOLD = 0.3

#: character classes whose share of the text is a statistic
CLASSES = {
    "upper": "[A-ZÀ-Þ]+",
    "digits": "[0-9]+",
    "exclaimed": "[!?]+",
    "stops": "[.,;:]+",
    "symbols": "[#$%&*+<=>@^_~\\\\/{}\\[\\]]+",
    "bars": "[|]+",
}


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with columns stat_* of a text: ratios and logarithms, finite for every text; null
    counts as empty. The words are split once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({"stat_words": F.split(text, "[\\x20\\x09-\\x0D]+"), "stat_lines": F.split(text, "\n"), "stat_chars": F.char_length(text)})
    share = lambda n, d: (n / F.greatest(d, F.lit(1))).cast("double")
    chars, words, lines = F.col("stat_chars"), F.size("stat_words"), F.size("stat_lines")
    kinds = F.size(F.array_distinct("stat_words"))
    made = {
        "stat_log_chars": F.log1p(chars),
        "stat_log_words": F.log1p(words),
        "stat_word_length": share(chars, words),
        "stat_distinct_words": share(kinds, words),
        "stat_log_distinct": F.log1p(kinds),
        "stat_line_words": share(words, lines),
        "stat_distinct_lines": share(F.size(F.array_distinct("stat_lines")), lines),
    }
    made |= {f"stat_{k}": share(chars - F.char_length(F.regexp_replace(text, p, "")), chars) for k, p in CLASSES.items()}
    return docs.withColumns(made).drop("stat_words", "stat_lines", "stat_chars"), list(made)


@dataclass(frozen=True)
class Comparison:
    name: str
    above: bool
    border: float

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.border) if self.above else F.col(self.name) <= F.lit(self.border)


Rule = tuple[Comparison, ...]


@dataclass
class RuleSet:
    rules: list[tuple[Rule, float]]
    base: float

    def score(self) -> Column:
        """The probability of label 1, over columns made by ``with_statistics``."""
        terms = [F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        z = reduce(lambda a, b: a + b, terms, F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, borders: list[np.ndarray], target: np.ndarray, rows: np.ndarray, path: tuple, depth: int, paths: list, fitted: np.ndarray) -> None:
    """Split ``rows`` where the target's means differ most; note every path taken. ``fitted`` gets
    the leaf means for all rows of the data."""
    inside = np.ones(len(x), bool)
    for j, above, b in path:
        inside &= (x[:, j] > b) == above
    if path:
        paths.append(path)
    best = (1e-9, None)
    y = target[rows]
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for j, bs in enumerate(borders):
            place = np.searchsorted(bs, x[rows, j], side="left")
            n = np.bincount(place, minlength=len(bs) + 1)[:-1].cumsum()
            s = np.bincount(place, y, minlength=len(bs) + 1)[:-1].cumsum()
            ok = (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
            if ok.any():
                m = np.maximum(n, 1), np.maximum(len(rows) - n, 1)
                gain = np.where(ok, s * s / m[0] + (y.sum() - s) ** 2 / m[1] - y.sum() ** 2 / len(rows), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, float(bs[k])))
    if best[1] is None:
        fitted[inside] = y.mean() if len(y) else 0.0
        return
    j, b = best[1]
    for above in (False, True):
        _grow(x, borders, target, rows[(x[rows, j] > b) == above], (*path, (j, above, b)), depth - 1, paths, fitted)


def _paths(x: np.ndarray, y: np.ndarray, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    borders = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z, paths = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 4 * LEAST_LEAF))]
        fitted = np.zeros(len(y))
        _grow(x, borders, y - p, rows, (), DEPTH, paths, fitted)
        z = z + fitted * 1.5
    return list(dict.fromkeys(paths))


def _lasso(r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty by accelerated proximal gradient steps."""
    n, k = r.shape
    mean = r.mean(0)
    centred = r - mean
    v = np.ones(k, np.float32)
    for _ in range(20):
        v = centred.T @ (centred @ v)
        v /= np.linalg.norm(v) + 1e-12
    # half of what either block of variables bears alone
    step = 2 * n / (np.linalg.norm(centred @ v) ** 2 + n * 1e-6)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = w0 = np.zeros(k)
    b, t = float(np.log(share / (1 - share))), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(centred @ w.astype(np.float32) + b, -40, 40)))
        g = centred.T @ (p - y).astype(np.float32) / n
        w1 = w - step * g
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * PENALTY, 0)
        b -= 2 * float((p - y).mean())
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, w0, t = w1 + (t - 1) / ahead * (w1 - w0), w1, ahead
    return w0, b - float(mean @ w0)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleSet:
    """Rules and weights for statistics ``x`` (a row each) and labels ``y`` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return RuleSet([], float(np.log(share / (1 - share))))
    paths = _paths(x, y.astype(float), seed)
    r = np.ones((len(y), len(paths)), np.float32)
    for k, path in enumerate(paths):
        for j, above, b in path:
            r[:, k] *= (x[:, j] > b) == above
    w, base = _lasso(r, y.astype(float))
    kept = [(tuple(Comparison(names[j], above, b) for j, above, b in path), float(v)) for path, v in zip(paths, w) if v]
    return RuleSet(kept, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: bool = True, sample: int = SAMPLE) -> RuleSet:
    """Learn a rule set. With ``held_out`` rows whose crc32(doc_id as text) mod 5 is 0 are kept
    out. Null labels or ids teach nothing; of several labels of an id the largest counts. With
    labels of one kind only, every text gets their share as its score."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows, names = with_statistics(id_text(docs).join(F.broadcast(known), "doc_id"))
    got = rows.select("doc_id", "label", *names).toArrow().sort_by([("doc_id", "ascending"), *((n, "ascending") for n in names)])
    learned = fit(np.column_stack([got[n].to_numpy() for n in names]) if len(got) else np.zeros((0, len(names))), got["label"].to_numpy(), names)
    release()
    return learned


def quality(docs: DataFrame, rules: RuleSet, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches the threshold) of every row.

    Empty and null texts are scored like any other; repeated rows stay; an empty table gives no rows.
    """
    rows, _ = with_statistics(id_text(docs))
    return rows.select("doc_id", rules.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
