"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled documents is the example set. All words of the examples are terms, and all of them count in
the cosine. A term's weight grows with its likelihood ratio, by which it occurs in toxic examples more often than chance
allows; for that ratio a term counts for no more documents than there are different words that it follows, so copies of
one document prove nothing. Document frequencies of the terms are counted over all documents. The examples stand in an
inverted index: a document adds up the posting lists of its terms, so each example's similarity is exact. The votes of
the k nearest, weighted by similarity, become a probability through a monotone curve fitted to the examples (each without
itself); the neighbours are the evidence.

Defined results: null and empty texts, and texts without any word of the examples, have no neighbours and get the rate of
the examples without neighbours; ties of similarity go to the smaller example id; repeated rows get equal scores; without
labels all scores are 0; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import batched, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import fold
from tallymark.llm.examples import labelled, monotone

#: Bounds of the example set; everything else covers all documents.
EXAMPLES = 8000
NEIGHBOURS = 15
#: Documents compared at a time, and the longest posting lists, which are multiplied as one matrix.
BLOCK = 64
COMMON = 256
#: Weights are whole multiples of 1 / GRAIN, so sums of products are exact in any order.
GRAIN = 2.0 ** 26
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def counted(text: str | None, terms: dict[str, int]) -> dict[int, int]:
    """How often each known term stands in a text."""
    return Counter(terms[t] for t in tokens(text) if t in terms)


@dataclass
class Lists:
    """One posting list a term, one after the other: the examples that hold it, with their weights."""

    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    size: int

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms: int) -> Lists:
        order = np.argsort(term, kind="stable")
        return cls(np.searchsorted(term[order], np.arange(terms + 1)), row[order], weight[order], size)

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row in the matrix of the longest lists, or -1, and that matrix."""
        lengths = np.diff(self.starts)
        longest = np.argsort(-lengths, kind="stable")[:COMMON]
        slot, matrix = np.full(len(lengths), -1), np.zeros((len(longest), self.size))
        slot[longest] = np.arange(len(longest))
        for k, t in enumerate(longest.tolist()):
            matrix[k, self.rows[self.starts[t]:self.starts[t + 1]]] = self.weights[self.starts[t]:self.starts[t + 1]]
        return slot, matrix

    def similarities(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The products of some vectors with every example."""
        slot, matrix = self.common
        dense = np.zeros((len(vectors), len(matrix)))
        for k, (at, w) in enumerate(vectors):
            dense[k, slot[at][slot[at] >= 0]] = w[slot[at] >= 0]
        out = dense @ matrix
        for k, (at, w) in enumerate(vectors):
            at, w = at[slot[at] < 0], w[slot[at] < 0]
            lengths = self.starts[at + 1] - self.starts[at]
            where = np.arange(lengths.sum()) + np.repeat(self.starts[at] - np.cumsum(lengths) + lengths, lengths)
            out[k] += np.bincount(self.rows[where], self.weights[where] * np.repeat(w, lengths), self.size)
        return out


@dataclass
class Index:
    """Unit vectors of the examples; ``weights`` as posting lists, or as a matrix of examples x terms that becomes such lists."""

    terms: dict[str, int]
    idf: np.ndarray  # with the weight that binds a term to the label
    ids: np.ndarray
    y: np.ndarray
    weights: Lists | np.ndarray
    most: np.ndarray | None  # greatest weights of blocks of a matrix; the lists need no bounds
    empty_rate: float
    curve: tuple[np.ndarray, np.ndarray]

    def __post_init__(self):
        self.lists = self.weights
        if not isinstance(self.lists, Lists):
            row, term = np.nonzero(self.weights)
            self.lists = Lists.of(row, term, self.weights[row, term], *self.weights.shape)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[k] for k in at.tolist()])) * self.idf[at]
        return at, np.rint(w / np.linalg.norm(w) * GRAIN) / GRAIN

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples with a similarity above 0, exactly; ``without`` leaves one out."""
        return self._best(self.lists.similarities([(at, w)])[0], k, without)

    def _best(self, sims: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        if without >= 0:
            sims[without] = 0
        found = np.flatnonzero(sims > 0)
        if len(found) > k:  # what can be among the k after rounding
            found = found[sims[found] >= np.partition(sims[found], -k)[-k] - 2e-12]
        best = found[np.lexsort((self.ids[found], -np.round(sims[found], 12)))[:k]]
        return best, sims[best]

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        return float((sims * self.y[found]).sum() / sims.sum())

    def all_nearest(self, many: Iterable[dict[int, int]], without: Iterable[int] = repeat(-1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The neighbours of each of many documents; one without known terms has none."""
        for part in batched(zip(many, without), BLOCK):
            sims = iter(self.lists.similarities([self.vector(c) for c, _ in part if c]))
            for c, out in part:
                yield self._best(next(sims), NEIGHBOURS, out) if c else (np.zeros(0, np.int64), np.zeros(0))

    def score(self, found: np.ndarray, sims: np.ndarray) -> tuple[float, list[int], list[float]]:
        if len(found):
            p = float(np.interp(self.vote(found, sims), *self.curve))
            return p, self.ids[found].tolist(), np.round(sims, 6).tolist()
        return self.empty_rate, [], []


def weigh_terms(examples: DataFrame, n: int, positive: int) -> dict[str, float]:
    """All terms of the examples with a weight: 1 and the likelihood ratio (twice the log) by which a term is bound to the label."""
    def contexts(batches):
        for frame in batches:
            rows = set()
            for one, y, text in zip(frame["id"], frame["y"], frame["text"], strict=True):
                ts = tokens(text)
                rows.update((t, p, one, y) for p, t in zip(["", *ts], ts))
            yield pd.DataFrame(sorted(rows, key=lambda r: r[0]), columns=["term", "before", "id", "y"])

    rows = examples.mapInPandas(contexts, f"term string, before string, id {dict(examples.dtypes)['id']}, y int")
    seen = rows.groupBy("term", "y").agg(
        F.least(F.count_distinct("id"), F.count_distinct("before")).alias("n"))
    by = seen.groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("y") != 1, F.col("n"))), F.lit(0)).alias("b"))
    by = by.select("term", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))

    def part(seen_, expected):
        return F.when(seen_ > 0, seen_ * F.log(seen_ / expected)).otherwise(0.0)

    k, rest = F.col("a") + F.col("b"), n - positive
    ratio = 2 * (part(F.col("a"), k * positive / n) + part(F.col("b"), k * rest / n)
                 + part(positive - F.col("a"), (n - k) * positive / n) + part(rest - F.col("b"), (n - k) * rest / n))
    bound = F.when(F.col("a") * rest > F.col("b") * positive, F.greatest(ratio, F.lit(0.0))).otherwise(0.0)
    found = by.select("term", (1 + bound).alias("weight")).toArrow().sort_by("term")
    return dict(zip(found["term"].to_pylist(), found["weight"].to_pylist(), strict=True))


def document_frequencies(docs: DataFrame, shared: Broadcast, text: str) -> tuple[int, np.ndarray]:
    """Over all documents; one row per term and task is all that moves."""
    def run(batches):
        total, seen, known = 0, Counter(), shared.value
        for frame in batches:
            total += len(frame)
            for value in frame["text"]:
                seen.update({t for t in tokens(value) if t in known})
        yield pd.DataFrame([(-1, total), *sorted((known[t], c) for t, c in seen.items())], columns=["term", "n"])

    found = docs.select(F.col(text).alias("text")).mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n"))
    found = found.toDF("term", "n").toArrow()
    by = np.zeros(len(shared.value) + 1)
    by[found["term"].to_numpy() + 1] = found["n"].to_numpy()
    return int(by[0]), by[1:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
        examples: int = EXAMPLES) -> Index:
    sample = labelled(docs, labels, label, examples, key=key, text=text)
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    weighed = weigh_terms(sample, n, positive) if n else {}
    spread = docs.sparkSession.sparkContext.broadcast
    terms = {t: k for k, t in enumerate(weighed)}
    known = spread(terms)
    total, df = document_frequencies(docs, known, text)

    def vectors(batches):
        for frame in batches:
            found = [sorted(counted(t, known.value).items()) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "at": [np.array([k for k, _ in f], np.int32).tobytes() for f in found],
                                "n": [np.array([c for _, c in f], np.int32).tobytes() for f in found]})

    kind = dict(sample.dtypes)["id"]
    rows = sample.mapInPandas(vectors, f"id {kind}, y int, at binary, n binary").toArrow().sort_by("id")
    y = rows["y"].to_numpy().astype(float)
    at, counts = (np.frombuffer(b"".join(rows[c].to_pylist()), np.int32) for c in ("at", "n"))
    row = np.repeat(np.arange(len(y)), [len(a) // 4 for a in rows["at"].to_pylist()])
    idf = (np.log((1 + total) / (1 + df)) + 1) * np.array(list(weighed.values()))
    w = (1 + np.log(counts)) * idf[at]
    w = np.rint(w / np.sqrt(np.bincount(row, w * w, len(y)))[row] * GRAIN) / GRAIN
    known.destroy()
    bare = y[np.bincount(row, minlength=len(y)) == 0]
    index = Index(terms, idf, np.array(rows["id"].to_pylist()), y, Lists.of(row, at, w, len(y), len(terms)), None,
                  float(bare.sum() / (len(bare) + 1)), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    shared = spread(index)

    def votes(batches):
        found = shared.value
        place = {one: k for k, one in enumerate(found.ids.tolist())}
        for frame in batches:
            near = found.all_nearest((counted(t, found.terms) for t in frame["text"]), (place[one] for one in frame["id"]))
            out = [(found.vote(*n), is_toxic) for n, is_toxic in zip(near, frame["y"], strict=True) if len(n[0])]
            yield pd.DataFrame(out, columns=["vote", "y"])

    left_out = sample.mapInPandas(votes, "vote double, y int").toArrow()
    shared.destroy()
    if left_out.num_rows:
        index.curve = monotone(left_out["vote"].to_numpy(), left_out["y"].to_numpy().astype(float))
    return index


def score(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` and the neighbours that voted with their similarities."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind, ids = rows.schema["id"].dataType.simpleString(), "long" if len(index.ids) == 0 else None
    ids = ids or dict(docs.dtypes)[key]

    def run(batches):
        found = shared.value
        for frame in batches:
            near = found.all_nearest(counted(value, found.terms) for value in frame["text"])
            out = [found.score(*n) for n in near]
            yield pd.DataFrame({"id": frame["id"], "score": [o[0] for o in out], "neighbours": [o[1] for o in out],
                                "similarities": [o[2] for o in out]})

    scored = rows.mapInPandas(run, f"id {kind}, score double, neighbours array<{ids}>, similarities array<double>")
    return scored.select(
        F.col("id").alias(key), (fold("id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarities")
