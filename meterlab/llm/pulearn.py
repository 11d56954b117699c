"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training rows labelled 1, the unlabelled ones any documents.  With the class prior p
and the logistic loss l, an additive model over binned style features minimises the non-negative risk
p * R(positives, +) + max(0, R(unlabelled, -) - p * R(positives, -)); where the second part is below zero, a
step follows the first alone.  The prior is estimated from the same two samples, without any label 0: a plain
model of positives against unlabelled texts is fitted on one half and scores the other; the texts over a score are
at most all positives there, so the least ratio of the unlabelled to the positive share over any score bounds the
prior from above.  The score is chosen by an upper confidence limit of that ratio, and both halves are averaged.
The features describe style and repetition, not topics: shares of character classes, capitals, marks behind words,
repeated words and runs, lengths of words and lines.

The fit uses at most about ``sample`` positives and as many unlabelled documents, drawn by a hash of doc_id; all
documents are scored.  Null and empty texts have all-zero features and are scored too; documents without a label are
only unlabelled; labels without a document are ignored; a doc_id with several labels counts as positive if all
are 1; without positives every score is 0 (0.5 without labels); where positives or
unlabelled texts are too few to fill both halves the prior is 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import join_hashes, slices, span_hashes, utf8, words

#: Positives and unlabelled documents the fit sees, about.
SAMPLE = 20_000
BINS, STEPS, RATE, DECAY = 8, 400, 0.05, 1e-4
#: Steps of the models that estimate the prior, and the chance that its confidence limits may fail with.
PRIOR_STEPS, CHANCE = 150, 0.1

#: Character classes: one per listed mark, then lower case, capitals, digits, other marks, white space, beyond ASCII.
MARKS = b".,;:!?|#*$%&<>@/\\()\"'-_="
CLASS = np.full(256, len(MARKS) + 3, np.int64)
for _i, _b in enumerate(MARKS):
    CLASS[_b] = _i
CLASS[97:123] = len(MARKS)
CLASS[65:91] = len(MARKS) + 1
CLASS[48:58] = len(MARKS) + 2
CLASS[[9, 10, 11, 12, 13, 32]] = len(MARKS) + 4
CLASS[0x80:] = len(MARKS) + 5
CLASSES = len(MARKS) + 6
LOWER_CLASS, UPPER_CLASS = len(MARKS), len(MARKS) + 1
WIDTH = CLASSES + 14


def features(col: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text."""
    buf, off = utf8(col)
    rows, n = len(off) - 1, np.diff(off)
    kind = CLASS[buf]
    doc = np.repeat(np.arange(rows), n)
    counts = np.bincount(doc * CLASSES + kind, minlength=rows * CLASSES).reshape(rows, CLASSES)
    out = np.zeros((rows, WIDTH), np.float32)
    out[:, :CLASSES] = counts / np.maximum(n, 1)[:, None]
    s, e, word_off = words(buf, off)
    k = np.diff(word_off)
    if not len(s):
        return out
    some = np.maximum(k, 1)
    below = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    per_doc = lambda mask: np.diff(below(mask)[word_off]) / some
    lower, upper = below(kind == LOWER_CLASS), below(kind == UPPER_CLASS)
    n_lower, n_upper = lower[e] - lower[s], upper[e] - upper[s]
    mark = (kind < len(MARKS)) | (kind == len(MARKS) + 3)
    marks = below(mark)
    n_mark = marks[e] - marks[s]
    h = span_hashes(buf, s, e)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    x = out[:, CLASSES:]
    x[:, 0] = np.log1p(k)
    x[:, 1] = n / some
    x[:, 2] = per_doc((n_upper >= 2) & (n_lower == 0))
    x[:, 3] = per_doc(kind[s] == UPPER_CLASS)
    x[:, 4] = per_doc(mark[e - 1])
    x[:, 5] = per_doc(n_mark >= 2)
    x[:, 6] = per_doc(n_mark == e - s)
    x[:, 7] = per_doc(again)
    x[:, 8] = per_doc(e - s <= 2)
    x[:, 9] = per_doc(e - s >= 12)
    x[:, 10] = np.diff(below(buf == 10)[off]) / some
    three = join_hashes(h, 3)
    for i, (a, b) in enumerate(zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True)):
        if b > a:
            _, count = np.unique(h[a:b], return_counts=True)
            x[i, 11] = len(count) / (b - a)
            x[i, 12] = count.max() / (b - a)
            x[i, 13] = len(np.unique(three[a:b - 2])) / (b - a - 2) if b - a > 2 else 1
    return out


def bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of every feature, numbered through all features."""
    return np.stack([np.searchsorted(edges[j], x[:, j], "right") + j * (BINS + 1) for j in range(x.shape[1])], 1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, hidden: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bin edges of each feature, and the weights of all bins with the constant last.

    ``hidden``: positives among the unlabelled are taken out of the risk; without it all unlabelled count as negative.
    """
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:], axis=0).T
    edges = np.concatenate([np.full((edges.shape[0], 1), 1e-9), edges[:, :-1]], 1)
    edges.sort(axis=1)
    p, u = bins(positive, edges), bins(unlabelled, edges)
    size = edges.shape[0] * (BINS + 1) + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log(prior / (1 - prior))

    def gradient(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), size)
        g[-1] += slope.sum()
        return g / len(rows)

    for step in range(1, steps + 1):
        zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
        fp, fu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        if hidden:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_negative = gradient(u, fu) - prior * gradient(p, fp)
        else:
            negative, g_negative = 0.0, (1 - prior) * gradient(u, fu)
        g = prior * gradient(p, fp - 1) + (g_negative if negative >= 0 else 0) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return edges, w


def raw_scores(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    edges, w = model
    return w[bins(x, edges)].sum(1) + w[-1]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from feature rows of both."""
    found = []
    side_p, side_u = (np.array([zlib.crc32(row.tobytes()) & 1 for row in x]) for x in (positive, unlabelled))  # equal texts on one side
    if any(len(np.unique(side)) < 2 for side in (side_p, side_u)):
        return 0.5
    for half in (0, 1):
        model = fit(positive[side_p != half], unlabelled[side_u != half], 0.5, PRIOR_STEPS, hidden=False)
        p, u = (np.sort(raw_scores(x, model)) for x in (positive[side_p == half], unlabelled[side_u == half]))
        over_p = 1 - np.searchsorted(p, p) / len(p)
        over_u = 1 - np.searchsorted(u, p) / len(u)
        slack = sum(np.sqrt(np.log(4 / CHANCE) / (2 * len(x))) for x in (p, u))
        best = int(((over_u + slack) / over_p).argmin())
        found.append(over_u[best] / over_p[best])
    return float(np.clip(np.mean(found), 0.001, 0.999))


def _sampled(rows: DataFrame, share: float, seed: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def _features_of(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part["text"])
                yield pa.record_batch({"doc_id": part["doc_id"], "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))})

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<float>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    return np.stack(found["x"].to_numpy()) if len(found) else np.empty((0, WIDTH), np.float32)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> tuple[float, tuple | None]:
    """Prior and model from the rows of ``labels`` (doc_id, quality) and ``docs`` (doc_id, text) where ``allowed``."""
    known = labels.where(allowed & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q") == 1, 1)).alias("pos")).first()
    if not counts["pos"]:
        return (0.0 if counts["n"] else 0.5), None
    trusted = _sampled(known.where("q = 1").select("doc_id"), sample / counts["pos"], 1)  # bound: about ``sample`` ids
    rest = docs.where(allowed & F.col("doc_id").isNotNull()).select("doc_id", "text")
    positive = _features_of(rest.join(F.broadcast(trusted), "doc_id", "left_semi"))
    unlabelled = _features_of(_sampled(rest, sample / max(1, docs.count()), 2))
    prior = estimate_prior(positive, unlabelled)
    if not len(positive) or not len(unlabelled):
        return prior, None
    return prior, fit(positive, unlabelled, prior)


def classify(docs: DataFrame, model: tuple[float, tuple | None], threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs`` (doc_id, text)."""
    prior, fitted = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if fitted is None:
                    score = np.full(part.num_rows, prior)
                else:
                    score = 1 / (1 + np.exp(-raw_scores(features(part["text"]), fitted)))
                yield pa.record_batch({"doc_id": part["doc_id"], "score": pa.array(score, pa.float64())})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
