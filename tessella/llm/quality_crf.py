"""Quality classifier: a linear-chain conditional random field over lines (operator 5).

Every line is good or bad.  A line's emission scores read its own features and those of
its neighbours, transitions tie it to the line before, and forward-backward gives each
line's probability of being good.  These marginals, weighted by the lines' lengths, are a
document's quality, which a logistic curve fitted on the labelled sample turns into the
probability of label 1.

Labels mark documents, not lines.  So the field is first fitted with each line labelled as
its document, then once more with the lines of bad documents relabelled by what the first
fit says of them, at least the worst one staying bad.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log, log1p
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, small_batches, table
from tessella.llm.labels import Sample, held_out, labelled_sample

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&<>@^~=_{}[]\\+"
PUNCT = b".,;:!?'\"()-"
THRESHOLD = 0.3


def _ratio(n: float, of: float, full: float) -> float:
    """n / of, with ``full`` and above as 1."""
    return min(1.0, n / of / full) if of else 0.0


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    n = len(line)
    words = line.split()
    nw = len(words)
    if not nw:
        return [1.0, 1.0] + [0.0] * 13
    lack = lambda chars: n - len(line.translate(None, chars))
    again = sum(map(eq, words, words[1:]))
    different = len(set(words))
    dup = line in seen
    seen.add(line)
    return [
        1.0, 0.0, min(1.0, log1p(nw) / 6), _ratio(lack(SYMBOLS), n, 0.04), _ratio(lack(UPPER), n, 0.25), _ratio(lack(DIGITS), n, 0.3),
        _ratio(line.count(b"!"), nw, 0.2), _ratio(line.count(b"|"), nw, 0.2), _ratio(again, nw, 0.2), _ratio(nw - different, nw, 0.9) if nw >= 20 else 0.0,
        _ratio(max(0.0, n / nw - 9), 1.0, 10.0), _ratio(max(0.0, 3.5 - n / nw), 1.0, 2.0), 1.0 if line.rstrip()[-1:] in b".!?" else 0.0, 1.0 if dup else 0.0, _ratio(lack(PUNCT), n, 0.15),
    ]


N_FEATURES = 15


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, neighbours' included, and the lines' lengths in bytes, one at least."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    seen: set[bytes] = set()
    own = np.array([line_features(x, seen) for x in lines])
    pad = np.zeros((1, N_FEATURES))
    rows = np.concatenate([own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad])], axis=1)
    return rows, np.array([max(1, len(x)) for x in lines], float)


@dataclass
class Crf:
    """``emit`` maps features to the log-odds of a good line; ``step[i][j]`` scores state j after state i (1 is good)."""

    emit: np.ndarray
    step: np.ndarray

    def marginals(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of good for every line, expected transitions, and log of the partition sum."""
        t00, t01, t10, t11 = (exp(x) for x in self.step.ravel())
        n = len(odds)
        push = np.exp(np.clip(odds, -30, 30)).tolist()
        alpha, scale = [], []
        a0 = a1 = 1.0
        total = 0.0
        for k in range(n):
            if k:
                a0, a1 = a0 * t00 + a1 * t10, a0 * t01 + a1 * t11
            a1 *= push[k]
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            total += log(s)
            alpha.append((a0, a1))
            scale.append(s)
        good = [0.0] * n
        moves = np.zeros((2, 2))
        b0 = b1 = 1.0
        good[-1] = alpha[-1][1]
        for k in range(n - 2, -1, -1):
            e1 = push[k + 1]
            s = scale[k + 1]
            c0, c1 = b0 / s, b1 * e1 / s
            a0, a1 = alpha[k]
            moves[0, 0] += a0 * t00 * c0
            moves[0, 1] += a0 * t01 * c1
            moves[1, 0] += a1 * t10 * c0
            moves[1, 1] += a1 * t11 * c1
            b0, b1 = t00 * c0 + t01 * c1, t10 * c0 + t11 * c1
            good[k] = a1 * b1
        return np.array(good), moves, total

    def line_marginals(self, rows: np.ndarray) -> np.ndarray:
        return self.marginals(rows @ self.emit)[0]


def fit_crf(docs: list[tuple[np.ndarray, np.ndarray]], weights: list[float], *, rounds: int = 60, decay: float = 1e-3) -> Crf:
    """Conditional likelihood by Adam over (features, line labels); the same data give the same field."""
    width = 3 * N_FEATURES
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = sum(w * len(y) for (_, y), w in zip(docs, weights, strict=True)) or 1.0
    stacked = np.concatenate([x for x, _ in docs]) if docs else np.zeros((0, width))
    edges = np.cumsum([0] + [len(y) for _, y in docs])
    for turn in range(1, rounds + 1):
        crf = Crf(theta[:width], theta[width:].reshape(2, 2))
        odds = stacked @ crf.emit
        grad, error = np.zeros_like(theta), np.empty(len(stacked))
        for k, ((_, y), w) in enumerate(zip(docs, weights, strict=True)):
            good, moves, _ = crf.marginals(odds[edges[k] : edges[k + 1]])
            error[edges[k] : edges[k + 1]] = w * (good - y)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1].astype(int), y[1:].astype(int)), 1)
            grad[width:] += w * (moves - seen).ravel()
        grad[:width] = error @ stacked
        grad = grad / total + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.3 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Crf(theta[:width], theta[width:].reshape(2, 2))


@dataclass
class QualityModel:
    crf: Crf
    curve: tuple[float, float]

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1 / (1 + exp(-max(-50.0, min(50.0, a + b * _evidence(self.crf, text)))))

    def lines(self, text: str | None) -> list[float]:
        """Each line's probability of being good."""
        return self.crf.line_marginals(text_features(text)[0]).tolist()


def _evidence(crf: Crf, text: str | None) -> float:
    """Log-odds of the length-weighted mean of the lines' marginals."""
    rows, size = text_features(text)
    mean = float(np.clip((crf.line_marginals(rows) * size).sum() / size.sum(), 1e-4, 1 - 1e-4))
    return log(mean / (1 - mean))


def fit_quality(sample: Sample) -> QualityModel:
    """Without labels of both classes every text gets the share of label 1, or one half."""
    share = sample.weights()
    if not (share[0] and share[1]):
        n = sum(sample.total.values())
        p = min(0.999, max(0.001, sample.total.get(1, 0) / n)) if n else 0.5
        return QualityModel(Crf(np.zeros(3 * N_FEATURES), np.zeros((2, 2))), (log(p / (1 - p)), 0.0))
    rows = [text_features(t)[0] for t in sample.texts]
    labels = [np.full(len(x), float(y)) for x, y in zip(rows, sample.labels, strict=True)]
    weights = [share[y] / len(x) ** 0.5 for x, y in zip(rows, sample.labels, strict=True)]
    crf = fit_crf(list(zip(rows, labels, strict=True)), weights)
    for k, y in enumerate(sample.labels):
        if not y:
            good = crf.line_marginals(rows[k])
            labels[k] = (good > 0.7).astype(float)
            labels[k][int(good.argmin())] = 0.0
    crf = fit_crf(list(zip(rows, labels, strict=True)), weights)
    x = np.array([_evidence(crf, t) for t in sample.texts])
    y = np.array(sample.labels, float)
    w = np.array([share[k] for k in sample.labels])
    return QualityModel(crf, _curve(x, y, w / w.sum()))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of one variable, by Newton's method."""
    beta = np.array([0.0, 0.5])
    rows = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        grad = rows.T @ (w * (p - y)) + ridge * beta
        hess = (rows * (w * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2)
        move = np.linalg.solve(hess, grad)
        beta = beta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def quality_scores(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (it replaces a column of that name): the probability of label 1 of the whole text.

    Defined cases: a null or empty text is one empty line and is scored as such; rows with
    equal texts get equal scores; an empty table gives an empty table.  No other column is read.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(score_col, F.pandas_udf(_scorer(model), "double")(column(text_col)))


def _scorer(model: QualityModel) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality"))
    out = quality_scores(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
