"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic documents and from unlabelled text that holds some toxic documents too. Its
risk is corrected by the class prior: prior * (positives as positives) + max(0, unlabelled as negatives - prior *
(positives as negatives)); where the second part falls below zero, its gradient is followed back upwards.

Features are present-or-absent hashes of words and word beginnings. Only those enter that are far commoner among the
positives than in the unlabelled text: a document's other words, however many, say nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back
from .hashing import Spans, words
from .sampling import Found, found, labelled_texts

#: Rows of the labels that training uses at most, about: confirmed positives, and any, with their labels hidden.
MOST_POSITIVE, MOST_HIDDEN = 2000, 8000
#: Row and feature of every present feature, and the number of rows.
Rows = tuple[np.ndarray, np.ndarray, int]
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True


def features(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a whole text and of their first 4, 5 and 6 bytes, repeats included."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    start, end = words(_WORD[data])
    spans, size = Spans(data), end - start
    out = [spans.hash(start, end, 9)]
    for n in (4, 5, 6):
        at = start[size >= n]
        out.append(spans.hash(at, at + n, n))
    return np.concatenate(out)


class Classifier:
    """Weights of the selected features, by hash, and a bias. A small bit table turns most features away before the search."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def present(self, text: str | None) -> np.ndarray:
        """Places of the selected features that occur in the text."""
        own = features(text)
        own = np.unique(own[self.maybe[(own >> np.uint64(44)).astype(np.int64)]])
        if not len(own) or not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return at[self.hashes[at] == own]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _unlike(sets: list[np.ndarray]) -> list[int]:
    """Places of sets that are not near-copies of an earlier one, by eight minimum hashes: copies of one document would make its words look telling."""
    factor = np.random.default_rng(3).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kept: list[int] = []
    signs = np.zeros((len(sets), 8), np.uint64)
    for k, s in enumerate(sets):
        if not len(s):
            continue
        sign = (s[None, :] * factor[:, None]).min(axis=1)
        if not kept or ((signs[: len(kept)] == sign).sum(axis=1) < 4).all():
            signs[len(kept)] = sign
            kept.append(k)
    return kept


def _selected(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int) -> np.ndarray:
    """Features in at least `least` positives that are nearly as much commoner there than in the unlabelled text as a feature of positives alone would be, and too common for chance among all those looked at."""
    p, np_ = np.unique(np.concatenate(positive), return_counts=True) if positive else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    p, np_ = p[np_ >= least], np_[np_ >= least]
    if not len(p):
        return p
    u, nu = np.unique(np.concatenate(unlabelled), return_counts=True) if unlabelled else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    common = np.zeros(len(p))
    if len(u):
        at = np.minimum(np.searchsorted(u, p), len(u) - 1)
        common = np.where(u[at] == p, nu[at], 0)
    rate_p, rate_u = np_ / len(positive), (common + 0.5) / (len(unlabelled) + 1)
    expected = len(positive) * (common + 1) / (len(unlabelled) + 1)
    surprise = np_ * np.log(np_ / expected) - (np_ - expected)  # Chernoff's bound for so many by chance, as a negative logarithm
    return p[(rate_p * prior >= 0.4 * rate_u) & (np_ > expected) & (surprise > np.log(len(p)))]


def _distinct(texts: list[str | Found]) -> list[np.ndarray]:
    """Distinct features of each text; equal texts count once."""
    return list({s.tobytes(): s for s in (found(t, features)[0] for t in texts)}.values())


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the corrected risk by logistic loss, of logits of the positives and of the unlabelled: positives as positives, and what is left of the unlabelled as negatives once the positives' share is taken off (it may fall below zero)."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def logits(w: np.ndarray, rows: Rows) -> np.ndarray:
    return w[-1] + np.bincount(rows[0], w[rows[1]], rows[2])


def gradient(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> np.ndarray:
    """Gradient of the risk by weights and bias (last) while its second part is not below zero; below, that part's gradient turned round."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    back = lambda d, rows: np.concatenate((np.bincount(rows[1], d[rows[0]], len(w) - 1), [d.sum()])) / rows[2]
    zp, zu = logits(w, positive), logits(w, unlabelled)
    rest = back(sigmoid(zu), unlabelled) - prior * back(sigmoid(zp), positive)
    return prior * back(-sigmoid(-zp), positive) + rest if risk(zp, zu, prior)[1] >= 0 else -rest


def train(positive: list[str | Found], unlabelled: list[str | Found], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4, least: int = 4) -> Classifier:
    """Minimise the non-negative risk by gradient descent with momentum-scaled steps (Adam), over all rows a step.

    prior: the share of toxic documents in the unlabelled text, over 0 and under 1. Null and empty texts have no feature;
    equal texts count once. Without positives, unlabelled texts or telling features every text scores the prior's own
    logit."""
    prior = float(np.clip(prior, 1e-3, 0.9))
    start = float(np.log(prior / (1 - prior)))
    p_sets, u_sets = _distinct(positive), _distinct(unlabelled)
    p_sets = [p_sets[k] for k in _unlike(p_sets)]
    chosen = _selected(p_sets, u_sets, prior, least)
    if not p_sets or not u_sets or not len(chosen):
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), start)

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of every present feature."""
        at = [np.searchsorted(chosen, s) for s in sets]
        at = [i[(i < len(chosen)) & (chosen[np.minimum(i, len(chosen) - 1)] == s)] for i, s in zip(at, sets, strict=True)]
        return np.repeat(np.arange(len(sets)), [len(i) for i in at]), np.concatenate(at)

    p_rows, u_rows = (*rows(p_sets), len(p_sets)), (*rows(u_sets), len(u_sets))
    w, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    w[-1] = start
    for step in range(1, steps + 1):
        g = gradient(w, p_rows, u_rows, prior)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(chosen, w[:-1].copy(), float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_positive: int = MOST_POSITIVE, most_hidden: int = MOST_HIDDEN, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Train on the whole texts of two hash samples of labelled rows outside fold 0: confirmed toxic ones, and any, whose labels stay hidden.

    The class prior is the share of toxic rows among all labelled rows outside fold 0. Null texts are as empty; rows with
    a null id or label teach nothing; repeated rows teach once; other columns are not read; no rows are no positives."""
    prior = labels.where((fold(id_col, 5) != 0) & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    texts = lambda rows, most: [t for t, _ in labelled_texts(docs, rows, label, most, features, 5, id_col, text_col)]
    model = train(texts(labels.where(F.col(label) == 1), most_positive), texts(labels, most_hidden), prior or 0.0)
    give_back()
    return model
