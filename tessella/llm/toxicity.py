"""Toxicity by the nearest labelled examples (operator 8).

The labelled sample is held as TF-IDF vectors of all its words in block-max inverted
indexes: for each word and block of examples, the largest weight in the block.  The
blocks' upper bounds for a text are added up, blocks are met from the highest bound down,
and the search ends when no bound can reach the k-th best cosine, so the neighbours are
exact.  They vote with their cosines, and the neighbours' ids and cosines are the evidence.  The share of
votes is calibrated: every example is judged by the others alone, and a logistic curve is fitted to
what its label was at that share, each example weighing as many labelled documents as it stands
for.  A text without any neighbour has the share of toxic labels.

A word's weight is (1 + log tf) * idf * phi**2, where phi is the correlation of the word's
presence and the label in the sample.  No word is left out; those that say nothing about
the label, whichever, weigh little, where by idf alone the chance matches of rare words
would drown all else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, small_batches, table, unused, without
from tessella.llm.labels import Sample, held_out, labelled_sample

WORDS = re.compile(r"\w+")
BLOCK, NEAREST, PRIOR_WEIGHT = 32, 15, 0.05
#: A term that more than one in so many examples have is held as a row over all examples; so many such terms at most.
DENSE, DENSE_ROWS = 24, 1024
#: Blocks that are met at once: so many first, then twice as many each time.
FIRST_BLOCKS = 16
#: Shares of votes are held within this of 0 and 1 before calibration; weight of the curve's prior, which is no change.
EDGE, RIDGE = 1e-3, 1.0
#: Results kept for texts met before, in each Python worker.
KNOWN = 100_000


def words_of(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``first[i] .. last[i]``, and of which range each is."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size), which


class BlockMaxIndex:
    """Vectors of examples by term: postings in order of term and example, cut into blocks with their largest weight.

    A term that more than one in ``DENSE`` examples have is held as a row over all examples.
    What such terms add to every example is exact from the start, and so part of the bounds.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        self.n = len(vectors)
        self.blocks = self.n // BLOCK + 1
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        df = np.bincount(term, minlength=n_terms)
        often = np.argsort(-df, kind="stable")[:DENSE_ROWS]
        often = often[df[often] * DENSE > self.n]
        #: Row of a term in ``dense``, or -1.
        self.row = np.full(n_terms, -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        many = self.row[term] >= 0
        self.dense[self.row[term[many]], doc[many]] = weight[many]
        term, weight, doc = term[~many], weight[~many], doc[~many]
        order = np.lexsort((doc, term))
        term, self.docs, self.weights = term[order], doc[order].astype(np.int32), weight[order]
        pair = term * self.blocks + self.docs // BLOCK
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
        #: For each pair of a term and a block that has it: the block, the first posting, and the bound.
        self.block, self.start = self.docs[start] // BLOCK, np.r_[start, len(pair)]
        self.most = np.maximum.reduceat(self.weights, start) if len(start) else np.empty(0)
        self.pairs = np.searchsorted(term[start], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` examples with the largest positive dot product, ties to the smaller number; exact."""
        row = self.row[terms]
        many = row >= 0
        sure = weights[many] @ self.dense[row[many]]
        terms, weights = terms[~many], weights[~many]
        pairs, which = _ranges(self.pairs[terms], self.pairs[terms + 1])
        q = weights[which]
        block = self.block[pairs]
        upper = sure.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, q * self.most[pairs], minlength=self.blocks)
        order = np.argsort(-upper, kind="stable")
        order = order[upper[order] > 0]
        scores, found = np.empty(0), np.empty(0, np.int64)
        at, size = 0, FIRST_BLOCKS
        while at < len(order):
            if len(scores) == k:  # nothing below the k-th best matters, whatever rounding
                order = order[: at + int(np.searchsorted(-upper[order[at:]], -(scores[-1] - 1e-12), side="right"))]
                if at == len(order):
                    break
            met = order[at : at + size]
            at, size = at + size, 2 * size
            mine = np.zeros(self.blocks, bool)
            mine[met] = True
            own = np.flatnonzero(mine[block])
            mine = pairs[own]
            posts, of = _ranges(self.start[mine], self.start[mine + 1])
            got = np.bincount(self.docs[posts], q[own[of]] * self.weights[posts], minlength=len(sure))
            docs = (np.sort(met)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            got = got[docs] + sure[docs]
            new = np.flatnonzero(got > 0)
            scores, found = np.concatenate([scores, got[new]]), np.concatenate([found, docs[new]])
            if len(scores) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                few = np.flatnonzero(scores >= edge)
                scores, found = scores[few], found[few]
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
        return list(zip(scores.tolist(), found.tolist(), strict=True))


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    weight: np.ndarray  # idf * phi ** 2
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    votes: np.ndarray  # how many labelled documents an example stands for
    base: float  # share of toxic labels
    k: int = NEAREST
    #: Slope and offset of the curve from the log odds of the votes to those of the label.
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's known terms and their weights, as a unit vector."""
        get = self.terms.get
        known = {t: n for w, n in words_of(text).items() if (t := get(w)) is not None}
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        terms, counts = np.fromiter(known, np.int64, len(known)), np.fromiter(known.values(), np.int64, len(known))
        order = np.argsort(terms)
        terms, counts = terms[order], counts[order]
        raw = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt((raw * raw).sum())
        return terms, raw / norm if norm else raw

    def share(self, near: list[tuple[float, int]]) -> float:
        """The toxic share of the neighbours' votes, before calibration."""
        up, all_ = PRIOR_WEIGHT * self.base, PRIOR_WEIGHT
        for cosine, d in near:
            w = cosine * self.votes[d]
            up, all_ = up + w * self.labels[d], all_ + w
        return min(1.0, max(0.0, up / all_))

    def judge(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(*self.vector(text), self.k)
        share = self.share(near)
        return (float(calibrated(share, self.curve)) if near else share), near


def log_odds(share: np.ndarray | float) -> np.ndarray:
    share = np.clip(share, EDGE, 1 - EDGE)
    return np.log(share / (1 - share))


def calibrated(share: np.ndarray | float, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * log_odds(share) + curve[1], -700, 700)))


def fit_curve(share: np.ndarray, labels: np.ndarray, weights: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope (never negative) and offset of the logistic curve of largest likelihood, by Newton's steps; a little ridge keeps it finite when the shares part the labels."""
    x, curve = np.stack([log_odds(share), np.ones(len(share))], axis=1), np.array([1.0, 0.0])
    weights = weights / weights.mean()
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -700, 700)))
        slope = x.T @ (weights * (labels - p)) - RIDGE * (curve - (1.0, 0.0))
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        curve = curve + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(curve[0]), float(curve[1])) if curve[0] > 0 else (1.0, 0.0)


def fit_toxicity(sample: Sample, *, k: int = NEAREST) -> ToxicityModel:
    """Without labels of both classes there are no terms, and every text gets the share of toxic labels (0 without any)."""
    share = sample.weights()
    n = sum(sample.total.values())
    base = sample.total.get(1, 0) / n if n else 0.0
    labels = np.array(sample.labels, float)
    both = bool(share[0] and share[1])
    rows = [words_of(t) for t in sample.texts] if both else []
    terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r}))}
    seen = np.zeros((2, len(terms)))
    for r, y in zip(rows, sample.labels, strict=False):
        seen[y, [terms[t] for t in r]] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    df = seen.sum(axis=0)
    gap = (seen[1] + 0.5) / (n1 + 1) - (seen[0] + 0.5) / (n0 + 1)
    p = (df + 1) / (len(labels) + 2)
    model = ToxicityModel(terms, (np.log((1 + len(labels)) / (1 + df)) + 1) * gap**2 / (p * (1 - p)), BlockMaxIndex([], 0), labels, np.array(sample.ids, dtype=object), np.ones(len(labels)), base, k)
    if not both:
        model.index = BlockMaxIndex([], len(terms))
        return model
    vectors = [model.vector(t) for t in sample.texts]
    # Examples that share their heaviest term stand together, so that the blocks' bounds are close.
    order = np.lexsort((np.arange(len(vectors)), [t[w.argmax()] if len(t) else -1 for t, w in vectors]))
    model.index = BlockMaxIndex([vectors[i] for i in order], len(terms))
    votes = np.array([share[y] for y in sample.labels])
    model.labels, model.ids, model.votes = labels[order], model.ids[order], votes[order] / votes.min()
    others = []
    for i, at in enumerate(order.tolist()):  # each example by the others
        near = [(c, d) for c, d in model.index.nearest(*vectors[at], k + 1) if d != i][:k]
        others.append(model.share(near) if near else None)
    live = np.array([x is not None for x in others], bool)
    if len(set(model.labels[live])) == 2:
        model.curve = fit_curve(np.array([x for x in others if x is not None]), model.labels[live], model.votes[live])
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of a toxic label of the whole text, and ``evidence``.

    ``evidence`` is an array of (example id as text, cosine), the nearest first; both
    columns replace input columns of the same name.

    Defined cases: a null or empty text, or one without a word of the sample, gets the share
    of toxic labels; equal texts get equal scores; an empty table gives an empty table.
    Other columns may have any name.
    """
    small_batches(docs.sparkSession)
    kind = "score double, evidence array<struct<example string, cosine double>>"
    (made,) = unused(docs.columns, "judged")
    out = docs.withColumn(made, F.pandas_udf(_scorer(model), kind)(column(text_col)))
    return out.select(*map(column, without(docs, "score", "evidence")), f"{made}.score", f"{made}.evidence")


def _scorer(model: ToxicityModel) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for texts in batches:
            scores, evidence = [], []
            for text in texts:
                key = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    score, near = model.judge(text)
                    known[key] = score, [{"example": str(model.ids[d]), "cosine": c} for c, d in near]
                score, near = known[key]
                scores.append(score)
                evidence.append(near)
            yield pd.DataFrame({"score": scores, "evidence": evidence})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    out = toxicity_scores(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
