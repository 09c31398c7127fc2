"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line is described by shares of kinds of characters, by its words and by
whether it has been said before, and the lines above and below add their descriptions. The field's weights are fitted
on a bounded sample of labelled documents, whose lines all bear the document's label. Of a document the forward and
backward sums give each line's probability of being good; their mean, weighted by length, is the document's quality,
made a probability by a logistic curve fitted on the same sample.

Defined results: a null or empty text is one empty line; lines are cut at ``\\n`` only; repeated rows get equal scores;
without labels of both kinds every score is the share of good labels (1 without any); other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import fold
from tallymark.llm.examples import labelled

#: Bounds of the sample the field is fitted on; scoring covers all documents and all lines.
EXAMPLES = 4000
EXAMPLE_LINES = 200
STEPS = 80
RIDGE = 1e-3
KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&", "|<>", "!?", ".,;:", " \t")


@functools.cache
def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(KINDS, 1):
        for c in chars.encode():
            kind[c] = k
    return kind


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descriptions of all lines, their lengths in bytes (each at least 1), and the number of lines of each text."""
    texts = [t or "" for t in texts]
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(float)
    kind = _kinds()[raw]
    shares = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(1, len(KINDS) + 1)]
    n, distinct, again = [], [], []
    for doc in lines:
        seen: set[str] = set()
        for line in doc:
            ws = line.encode().split()
            n.append(len(ws))
            distinct.append(len(set(ws)))
            again.append(bool(ws) and line in seen)
            seen.add(line)
    n, distinct = np.array(n, float), np.array(distinct, float)
    size = np.maximum(length, 1.0)
    columns = [s / size for s in shares]
    columns += [n == 0, np.log1p(n) / 5, 1 - distinct / np.maximum(n, 1), np.array(again, float),
                np.minimum((length - shares[-1]) / np.maximum(n, 1) / 10, 3.0), np.ones(len(n))]
    return np.stack(columns, 1).astype(float), size, counts


def with_neighbours(lines: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's description beside those of the lines above and below; beyond the ends all zero."""
    ends = np.cumsum(counts)
    above, below = np.zeros_like(lines), np.zeros_like(lines)
    above[1:], below[:-1] = lines[:-1], lines[1:]
    above[(ends - counts)[counts > 0]] = 0
    below[(ends - 1)[counts > 0]] = 0
    return np.concatenate([lines, above, below], 1)


def marginals(bad: np.ndarray, stay: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability that each line is bad, the log of each chain's sum, and expected counts of each transition.

    ``bad`` is a line's score for bad against good, ``stay[i, j]`` that of going from i to j. All chains go forward and
    backward side by side, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    begins = (np.cumsum(counts) - counts)[order]
    size, width = counts[order], int(counts.max()) if len(counts) else 0
    alive = [int(np.searchsorted(-size, -i, side="left")) for i in range(width)]  # chains longer than i lines
    forward, backward = np.zeros((len(bad), 2)), np.zeros((len(bad), 2))
    last = np.zeros((len(size), 2))
    for i in range(width):
        m = alive[i]
        at = begins[:m] + i
        if i == 0:
            now = np.zeros((m, 2))
        else:
            now = np.logaddexp(last[:m, :1] + stay[0], last[:m, 1:] + stay[1])
        now[:, 1] += bad[at]
        forward[at] = now
        last[:m] = now
    total = np.logaddexp(last[:, 0], last[:, 1])
    moves = np.zeros((2, 2))
    for i in range(width - 2, -1, -1):
        m = alive[i + 1]
        at = begins[:m] + i
        after = backward[at + 1].copy()
        after[:, 1] += bad[at + 1]
        backward[at] = np.logaddexp(after[:, :1] + stay[:, 0], after[:, 1:] + stay[:, 1])
        joint = forward[at][:, :, None] + stay[None] + after[:, None, :] - total[:m, None, None]
        moves += np.exp(joint).sum(0)
    log_z = np.zeros(len(counts))
    log_z[order] = total
    p = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(log_z, counts))
    return p, log_z, moves


@dataclass
class Field:
    weights: np.ndarray
    stay: np.ndarray
    slope: float
    base: float

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Mean probability of being good over a document's characters."""
        lines, size, counts = describe(texts)
        p, _, _ = marginals(with_neighbours(lines, counts) @ self.weights, self.stay, counts)
        starts = np.cumsum(counts) - counts
        return 1 - np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts) if len(counts) else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.raw(texts)) + self.base)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def descend(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Descent with a running mean and scale of the gradient."""
    mean, scale = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        mean, scale = 0.9 * mean + 0.1 * g, 0.99 * scale + 0.01 * g * g
        x = x - rate * (mean / (1 - 0.9 ** k)) / (np.sqrt(scale / (1 - 0.99 ** k)) + 1e-8)
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
        examples: int = EXAMPLES, lines: int = EXAMPLE_LINES) -> Field:
    sample = labelled(docs, labels, label, examples, key=key, text=text)
    short = F.size(F.split("text", "\n")) <= lines

    def described(batches):
        for frame in batches:
            x, size, counts = describe(frame["text"].tolist())
            ends = np.cumsum(counts)
            yield pd.DataFrame({
                "id": frame["id"], "y": frame["y"],
                "x": [x[e - c: e].ravel() for e, c in zip(ends, counts, strict=True)],
                "size": [size[e - c: e] for e, c in zip(ends, counts, strict=True)]})

    kind = dict(sample.dtypes)["id"]
    rows = sample.where(short).mapInPandas(described, f"id {kind}, y int, x array<double>, size array<double>").toPandas()
    y = rows["y"].to_numpy(float) if len(rows) else np.zeros(0)
    share = float(y.mean()) if len(y) else 1.0
    width = len(KINDS) + 6
    if not 0 < share < 1:
        return Field(np.zeros(3 * width), np.zeros((2, 2)), 0.0, float(_logit(np.array(share))))
    rows = rows.sort_values("id", kind="stable")
    y = rows["y"].to_numpy(float)
    x = np.concatenate(rows["x"].to_list()).reshape(-1, width)
    size, counts = np.concatenate(rows["size"].to_list()), np.array([len(s) for s in rows["size"]], np.int64)
    x = with_neighbours(x, counts)
    bad = np.repeat(1 - y, counts)
    told = np.zeros((2, 2))
    told[0, 0], told[1, 1] = (counts - 1)[y == 1].sum(), (counts - 1)[y == 0].sum()

    def gradient(w):
        p, _, moves = marginals(x @ w[:-4], w[-4:].reshape(2, 2), counts)
        return np.concatenate([x.T @ (p - bad), (moves - told).ravel()]) / len(y) + RIDGE * w

    w = descend(gradient, np.zeros(3 * width + 4), STEPS, 0.15)
    field = Field(w[:-4], w[-4:].reshape(2, 2), 1.0, 0.0)
    p, _, _ = marginals(x @ field.weights, field.stay, counts)
    starts = np.cumsum(counts) - counts
    z = _logit(1 - np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts))

    def curve(ab):
        miss = 1 / (1 + np.exp(-(ab[0] * z + ab[1]))) - y
        return np.array([(miss * z).mean(), miss.mean()]) + 1e-3 * (ab - [1, 0])

    field.slope, field.base = map(float, descend(curve, np.array([1.0, 0.0]), 300, 0.05))
    return field


def score(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc`` (the row as it came), ``held_out``, ``score`` and ``predicted``."""
    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        out = [field.score(texts.iloc[k: k + 1000].tolist()) for k in range(0, len(texts), 1000)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("held_out", fold(F.col("doc").getField(key), 5) == 0)
    rows = rows.withColumn("score", quality(F.col("doc").getField(text)))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents predicted good, with the columns they came with."""
    return score(docs, fit(docs, labels, key=key, text=text), key, text).where("predicted = 1").select("doc.*")
