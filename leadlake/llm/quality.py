"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import class_counts, crc, labelled_sample, logistic

#: Labelled rows of each class that training takes, and its gradient steps.
PER_CLASS = 1200
STEPS = 120
FOLDS, HELD_OUT = 5, 0
GOOD_FROM = 0.3
SYMBOLS = b"!*$%&#|"
DIGITS = b"0123456789"
#: Features of a line's own that its neighbours get, too.
SHARED = (2, 3, 4, 5, 6, 7, 8)
OWN = 13


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, weight) of each line: its own features, those of the lines before and after it, and whether it is first or last."""
    lines = text.split("\n")
    seen: set[str] = set()
    rows, sizes = [], []
    for line in lines:
        raw = line.encode()
        n = max(1, len(raw))
        words = line.split()
        k = max(1, len(words))
        longest = max(map(len, words), default=0)
        rows.append((
            1.0, np.log1p(len(words)), sum(map(str.isupper, words)) / k,
            (len(raw) - len(raw.translate(None, SYMBOLS))) / n, words.count("|") / k,
            1 - len(set(words)) / k if words else 0.0, sum(map(eq, words, words[1:])) / k,
            float(line in seen and bool(words)), (len(raw) - len(raw.translate(None, DIGITS))) / n,
            float(line.endswith((".", "?", "!", ":"))), len(raw) / k / 10, float(longest > 40), float(not words)))
        seen.add(line)
        sizes.append(len(line) + 1.0)
    own = np.array(rows)
    near = own[:, SHARED]
    none = np.zeros((1, len(SHARED)))
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1.0
    return np.hstack([own, np.vstack([none, near[:-1]]), np.vstack([near[1:], none]), ends]), np.array(sizes)


def chain(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (P(good) per line, expected moves summed per chain pair of states, log sums).

    ``emit`` is the good state's lead per line, chains back to back with ``sizes`` lines each (none of
    them empty); ``moves`` holds the scores of moves between the states bad and good.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    longest = int(left[0]) if len(left) else 0
    alive = np.searchsorted(-left, -np.arange(longest), side="left")  # chains that have a line t
    a = np.zeros((len(emit), 2))
    b = np.zeros((len(emit), 2))
    a[first, 1] = emit[first]
    for t in range(1, longest):
        at = first[:alive[t]] + t
        step = a[at - 1][:, :, None] + moves
        a[at] = np.logaddexp(step[:, 0], step[:, 1])
        a[at, 1] += emit[at]
    for t in range(longest - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        ahead = b[at + 1].copy()
        ahead[:, 1] += emit[at + 1]
        step = moves + ahead[:, None, :]
        b[at] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    last = first + left - 1
    total = np.empty(len(sizes))
    total[order] = np.logaddexp(a[last, 0], a[last, 1])
    per_line = np.repeat(total, sizes)
    good = np.exp(a[:, 1] + b[:, 1] - per_line)
    inner = np.ones(len(emit), dtype=bool)
    inner[(np.cumsum(sizes) - sizes)] = False
    at = np.flatnonzero(inner)
    ahead = b[at].copy()
    ahead[:, 1] += emit[at]
    pair = np.exp(a[at - 1][:, :, None] + moves + ahead[:, None, :] - per_line[at][:, None, None]) if len(at) else np.zeros((0, 2, 2))
    return np.clip(good, 0, 1), pair, total


class Field:
    """The fitted field, and the calibration of a document's mean marginal."""

    def __init__(self, weights, moves, mean, scale, curve):
        self.weights, self.moves, self.mean, self.scale, self.curve = weights, moves, mean, scale, curve

    def marginals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return chain(((x - self.mean) / self.scale) @ self.weights, sizes, self.moves)[0]

    def documents(self, texts: list[str]) -> np.ndarray:
        """Each text's score: the mean of its lines' marginals by length, calibrated."""
        if not texts:
            return np.empty(0)
        parts = [line_features(t) for t in texts]
        sizes = np.array([len(w) for _, w in parts])
        good = self.marginals(np.concatenate([x for x, _ in parts]), sizes)
        weight = np.concatenate([w for _, w in parts])
        at = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)
        return mean if self.curve is None else _curve(mean, self.curve)


def _curve(mean: np.ndarray, curve: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * np.log(mean / (1 - mean)), -30, 30)))


def fit(rows: list[tuple[str, int]], share: float, steps: int = STEPS) -> Field | float:
    """The field that maximises the likelihood of lines labelled like their documents, ridge-penalised, by Adam steps.

    Half of the rows fit the field, the others the calibration, whose constant is set for ``share``, the
    share of good rows among all labelled ones. A constant score if a class is missing.
    """
    if min(sum(1 for _, y in rows if y == c) for c in (0, 1)) < 2:
        return float(share)
    rows = sorted(rows, key=lambda r: (r[1], len(r[0]), r[0]))
    half, rest = rows[::2], rows[1::2]
    parts = [line_features(t) for t, _ in half]
    sizes = np.array([len(w) for _, w in parts])
    x = np.concatenate([x for x, _ in parts])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale < 1e-6] = 0.0, 1.0
    scale[0] = 1.0
    x = (x - mean) / scale
    y = np.repeat(np.array([y for _, y in half], dtype=float), sizes)
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(sizes) - sizes] = False
    weight = np.repeat(1.0 / sizes, sizes)  # each document counts as much as any other
    pair_weight = weight[inner][:, None, None]
    observed = np.zeros((2, 2))
    observed[0, 0], observed[1, 1] = (weight[inner] * (y[inner] == 0)).sum(), (weight[inner] * (y[inner] == 1)).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, pair, _ = chain(x @ theta[:-4], sizes, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ ((good - y) * weight), ((pair * pair_weight).sum(axis=0) - observed).ravel()]) / len(half) + 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2), mean, scale, None)
    p = np.clip(field.documents([t for t, _ in rest]), 1e-6, 1 - 1e-6)
    y = np.array([y for _, y in rest], dtype=float)
    curve = logistic(np.column_stack([np.ones(len(p)), np.log(p / (1 - p))]), y)
    share = min(max(share, 1e-4), 1 - 1e-4)
    curve[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    field.curve = curve
    return field


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; predicted is 1 from a score of 0.3.

    Every line of the whole text is labelled good or bad by a linear-chain field whose features look at
    the line and at both neighbours; forward-backward gives each line's probability of good; their mean,
    weighted by length, is the document's, and a logistic curve calibrates it. The field is fitted on at
    most ``per_class`` rows of each class from outside the held-out fold (FOLDS, HELD_OUT). Null and
    empty texts are one empty line. A null id counts as held out. Without rows of both classes the score
    is the share of good labels. Repeated rows are scored alike; other columns are not looked at.
    """
    counts = class_counts(labels, "quality", FOLDS, HELD_OUT)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit(labelled_sample(docs, labels, "quality", per_class, FOLDS, HELD_OUT), share)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thirty numbers

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            p = np.empty(batch.num_rows)
            for i in range(0, batch.num_rows, 500):
                some = [t or "" for t in texts.slice(i, 500).to_pylist()]
                p[i:i + 500] = model.documents(some) if isinstance(model, Field) else model
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= GOOD_FROM).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(crc(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
