"""Scores of texts under a probabilistic suffix tree, beside an add-one word model.

A text is its words, A-Z lower-cased, joined by single spaces, and an end mark; the tree predicts its bytes and the end
from up to ``DEPTH`` bytes before. All runs of ``DEPTH`` + 1 symbols of the training documents are counted. A context of
more than ``SHARED`` symbols is a candidate if it is met at least ``LEAST`` times, however large the corpus, and stays in
the tree if its next symbols diverge from those of the context one symbol shorter by more than the cost of its
parameters, together with all its endings; all shorter contexts stay. A node's distribution is smoothed towards that of
its parent, the root's by adding one. Each symbol is scored in the node of the longest suffix that is in the tree.

The tree is a table that grows with the corpus: every distinct run of any document with its log10 probability. Runs that
share the last symbols of their context lie in one task, which finds their nodes; only the counts of contexts of at most
``SHARED`` symbols, bounded by the alphabet, are shared. The most frequent runs are shared with all tasks for scoring,
the rest are joined by run, so no joined run is frequent.

The word model's counts cover all training documents. Words above a count that at most ``HEADS`` words reach are shared
with all tasks; the rest are joined by word.

Defined results: null and empty texts have one token, the end; null ids count as training (crc32 of empty text is 0);
repeated rows are scored each; without training rows the root is uniform and N and V are 0; an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.common import lower_words, saved

#: A run of one symbol more fits in a long.
DEPTH = 6
#: Contexts up to this length are always in the tree; longer ones must be met so often.
SHARED = 2
LEAST = 2
PULL = 4.0
#: Runs shared with all tasks for scoring, and runs that a task takes on at once.
RUNS = 2_000_000
CHUNK = 200_000
HEADS = 200_000
#: Bytes that UTF-8 never uses stand for the end of a text and for what lies before its start.
END, BEFORE = 0xFF, 0xFE
#: Symbols that can follow: all bytes but these two, and the end.
SYMBOLS = 255
HELD = 500_000


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols end to end, each after ``DEPTH`` marks of the start, and where their own symbols start."""
    parts = [b" ".join(lower_words(t)) for t in texts]
    raw = np.frombuffer(b"".join(bytes([BEFORE]) * DEPTH + p + bytes([END]) for p in parts), np.uint8)
    sizes = np.array([len(p) + 1 + DEPTH for p in parts], np.int64)
    return raw, np.cumsum(sizes) - sizes + DEPTH


def grams(raw: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` symbols before and the symbol itself as one number, for every symbol that is not a start mark."""
    at = np.flatnonzero(raw[DEPTH:] != BEFORE) + DEPTH
    out = np.zeros(len(at), np.int64)
    for k in range(DEPTH, -1, -1):
        out = out << 8 | raw[at - k]
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, n, seen: counts in the training rows and in all rows; a task holds about ``HELD`` distinct grams."""
    def merged(parts):
        unique, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return (unique, *(np.bincount(where, np.concatenate([p[k] for p in parts]), len(unique)).astype(np.int64)
                          for k in (1, 2)))

    def run(batches):
        parts, size = [], 0
        for frame in batches:
            for at in range(0, len(frame), 1000):
                piece = frame.iloc[at: at + 1000]
                for learnt, rows in piece.groupby("training"):
                    new, n = np.unique(grams(symbols(rows["text"].tolist())[0]), return_counts=True)
                    parts.append((new, n if learnt else np.zeros_like(n), n))
                    size += len(new)
                if size > 2 * HELD:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD:
                        yield pd.DataFrame(dict(zip(("gram", "n", "seen"), parts[0], strict=True)))
                        parts, size = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("gram", "n", "seen"), merged(parts), strict=True)))

    return texts.mapInPandas(run, "gram long, n long, seen long").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all rows; the end of a text is the empty word."""
    def run(batches):
        found: Counter = Counter()
        for frame in batches:
            for text in frame["text"]:
                found.update(lower_words(text))
                found[b""] += 1
                if len(found) > HELD:
                    yield _frame(found)
                    found.clear()
        if found:
            yield _frame(found)

    def _frame(found):
        return pd.DataFrame({"word": [w.decode() for w in found], "n": list(found.values())})

    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """The same model over a few nodes held whole, symbol by symbol."""

    column: np.ndarray  # of each byte in the tables; bytes never seen share one
    child: np.ndarray  # node x column: the node with that symbol in front, 0 if none
    log10: np.ndarray  # node x column: probability of the symbol next

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw, starts = symbols(texts)
        if not len(raw):
            return np.zeros(0)
        column = self.column[raw]
        out = np.zeros(len(raw))
        for lo in range(DEPTH, len(raw), 1 << 20):
            at = np.arange(lo, min(lo + (1 << 20), len(raw)))
            node, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
            for back in range(1, DEPTH + 1):
                deeper = self.child[node, column[at - back]]
                alive &= deeper > 0
                node = np.where(alive, deeper, node)
            out[at] = np.where(raw[at] == BEFORE, 0.0, self.log10[node, column[at]])
        return np.add.reduceat(out, starts)


@dataclass
class Short:
    """Counts of the runs of at most ``SHARED`` + 1 symbols of the training documents."""

    keys: list[np.ndarray]  # by depth: context and symbol as one number, ascending
    counts: list[np.ndarray]

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Short:
        found = []
        for depth in range(SHARED + 1):
            unique, where = np.unique(keys & _mask(depth + 1), return_inverse=True)
            found.append((unique, np.bincount(where, counts, len(unique))))
        return cls([k for k, _ in found], [c for _, c in found])

    def find(self, depth: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the symbol of each gram follows its context of this depth, and how often anything does."""
        keys, upto = self.keys[depth], np.concatenate([[0.0], np.cumsum(self.counts[depth])])
        key = gram & _mask(depth + 1)
        context = key & ~np.uint64(255)
        sums = [upto[np.searchsorted(keys, k, side)] for k, side in (
            (key, "left"), (key, "right"), (context, "left"), (context | np.uint64(255), "right"))]
        return sums[1] - sums[0], sums[3] - sums[2]


def _mask(symbols_: int) -> np.uint64:
    return np.uint64((1 << 8 * symbols_) - 1)


def log10_of(gram: np.ndarray, n: np.ndarray, short: Short, least: int = LEAST) -> np.ndarray:
    """log10 probability of the last symbol of each gram, given all grams whose contexts end in the same symbols.

    ``gram`` holds each once and ``n`` its count in the training documents, 0 for grams that only others have.
    """
    gram = gram.astype(np.int64).view(np.uint64)
    n0, total = short.find(0, gram)
    p = (n0 + 1.0) / (total + SYMBOLS)
    for depth in range(1, SHARED + 1):
        above, of_above = short.find(depth, gram)
        p = (above + PULL * p) / (of_above + PULL)
    levels = []
    for depth in range(SHARED + 1, DEPTH + 1):
        context, in_context = np.unique(gram >> np.uint64(8) & _mask(depth), return_inverse=True)
        of = np.bincount(in_context, n, len(context))
        _, first, in_run = np.unique(gram & _mask(depth + 1), return_index=True, return_inverse=True)
        count = np.bincount(in_run, n, len(first))
        first, met = first[count > 0], count[count > 0]
        own = in_context[first]
        gain = np.bincount(own, met * np.log(met * of_above[first] / (of[own] * above[first])), len(context))
        cost = 0.5 * np.bincount(own, minlength=len(context)) * np.log(np.maximum(of, 1))
        levels.append((in_context, (of >= least) & (gain > cost), count[in_run], of[in_context]))
        above, of_above = levels[-1][2:]
    kept, deeper = [], np.zeros(len(gram), bool)
    for in_context, stays, _, _ in reversed(levels):
        deeper = (stays | (np.bincount(in_context, deeper, len(stays)) > 0))[in_context]
        kept.append(deeper)
    for (_, _, count, of), inside in zip(levels, reversed(kept), strict=True):
        p = np.where(inside, (count + PULL * p) / (of + PULL), p)
    return np.log10(p).astype(np.float32)


def fit_table(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """gram, seen, log10 of every distinct gram of the column ``text``; the rows ``training`` are learnt from."""
    counted = saved(count_grams(texts))
    few = counted.groupBy(F.col("gram").bitwiseAND(F.lit(int(_mask(SHARED + 1)))).alias("key")).agg(
        F.sum("n").alias("n")).where("n > 0").toArrow()  # at most 256 ** (SHARED + 1) rows
    short = counted.sparkSession.sparkContext.broadcast(
        Short.of(few["key"].to_numpy().astype(np.uint64), few["n"].to_numpy().astype(np.float64)))

    def run(batches):
        def done(rows):
            return pd.DataFrame({"gram": rows["gram"], "seen": rows["seen"], "log10": log10_of(
                rows["gram"].to_numpy(), rows["n"].to_numpy(), short.value, least)})

        parts, size = [], 0
        for frame in batches:
            parts.append(frame)
            size += len(frame)
            if size > CHUNK:  # the last ending may go on in the next batch
                rows = pd.concat(parts)
                goes_on = (rows["ending"] == rows["ending"].iloc[-1]).to_numpy()
                if not goes_on.all():
                    yield done(rows[~goes_on])
                parts, size = [rows[goes_on]], int(goes_on.sum())
        if size:
            yield done(pd.concat(parts))

    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(int(_mask(SHARED + 1))))
    laid = counted.withColumn("ending", ending).repartition("ending").sortWithinPartitions("ending")
    return saved(laid.mapInPandas(run, "gram long, seen long, log10 float"))


class Frequent:
    """log10 by gram, for the grams that all tasks share."""

    def __init__(self, grams_: np.ndarray, log10: np.ndarray):
        self.grams, self.log10, self.index = grams_, log10, None

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sum of each text over its shared grams, and its other grams."""
        raw, starts = symbols(texts)
        if self.index is None:
            self.index = pd.Index(self.grams)
        gram = grams(raw)
        own = starts - DEPTH * np.arange(1, len(starts) + 1)
        at = self.index.get_indexer(gram)
        known = np.where(at >= 0, np.append(self.log10, 0.0)[at], 0.0)
        return np.add.reduceat(known, own), [
            g[a < 0] for g, a in zip(np.split(gram, own[1:]), np.split(at, own[1:]), strict=True)]


def frequent(table: DataFrame, most: int = RUNS) -> Frequent:
    """Grams whose count over all documents reaches the least eighth of a power of two that at most ``most`` reach."""
    step = F.floor(8 * F.log2("seen"))
    by = dict(table.groupBy(step.alias("b")).agg(F.count("*")).collect())  # at most 8 * 63 rows
    floor = max(by, default=0) + 1
    total = 0
    while floor > 0 and total + by.get(floor - 1, 0) <= most:
        floor -= 1
        total += by.get(floor, 0)
    found = table.where(step >= floor).select("gram", "log10").toArrow()
    return Frequent(found["gram"].to_numpy(), found["log10"].to_numpy())


def build(rows: pd.DataFrame, total: int) -> Tree:
    rows = rows.sort_values(["depth", "context", "symbol"], kind="stable")
    root = rows[rows["depth"] == 0]
    seen = sorted({*root["symbol"].tolist(), BEFORE, END})
    column = np.full(256, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    nodes = {(0, 0): 0}
    for depth, context in rows[["depth", "context"]].drop_duplicates().to_numpy(np.int64).tolist():
        nodes.setdefault((depth, context), len(nodes))
    child = np.zeros((len(nodes), len(seen) + 1), np.int32)
    p = np.zeros((len(nodes), len(seen) + 1))
    p[0] = 1.0 / (total + SYMBOLS)
    p[0, column[root["symbol"]]] = (root["n"].to_numpy() + 1.0) / (total + SYMBOLS)
    for (depth, context), part in rows[rows["depth"] > 0].groupby(["depth", "context"], sort=True):
        depth, context = int(depth), int(context)
        node, parent = nodes[depth, context], nodes[depth - 1, context & ((1 << 8 * (depth - 1)) - 1)]
        child[parent, column[context >> 8 * (depth - 1)]] = node
        n = np.zeros(len(seen) + 1)
        n[column[part["symbol"]]] = part["n"]
        p[node] = (n + PULL * p[parent]) / (n.sum() + PULL)
    return Tree(column, child, np.log10(p).astype(np.float32))


def heads(vocab: DataFrame, most: int) -> dict[bytes, int]:
    """Words whose count reaches the least power of two that at most ``most`` words reach."""
    by = dict(vocab.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*")).collect())  # at most 63 rows
    floor = max(by, default=0) + 1
    total = 0
    while floor > 0 and total + by.get(floor - 1, 0) <= most:
        floor -= 1
        total += by.get(floor, 0)
    frame = vocab.where(F.col("n") >= 2 ** floor).toPandas()
    return {w.encode(): int(n) for w, n in zip(frame["word"], frame["n"], strict=True)}


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    ``training`` marks the rows that the models learn from.
    """
    chosen = docs.where(training).select(F.col(f"`{text}`").alias("text"))
    vocab = saved(count_words(chosen))
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    runs = fit_table(docs.select(F.col(f"`{text}`").alias("text"), training.alias("training")))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((frequent(runs, RUNS), {w: math.log10((c + 1) / (n + v + 1)) for w, c in heads(vocab, HEADS).items()}))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), training.alias("training"),
                       F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        (often, known), at = shared.value, 0
        for big in batches:
            for frame in (big.iloc[k: k + 100] for k in range(0, len(big), 100)):
                out = []
                for value in frame["text"]:
                    ws = [*lower_words(value), b""]
                    found = list(map(known.get, ws))
                    rest = [w.decode() for w, f in zip(ws, found, strict=True) if f is None]
                    out.append((len(ws), len(ws) - len(rest), math.fsum(f for f in found if f is not None), rest))
                part = frame["part"].to_numpy() << 36
                scores, others = often.score(frame["text"].tolist())
                yield pd.DataFrame({
                    "row": part + np.arange(at, at + len(frame)), "id": frame["id"], "training": frame["training"],
                    "n_tokens": [o[0] for o in out], "known": [o[1] for o in out], "base": [o[2] for o in out],
                    "score": scores, "rest": [o[3] for o in out], "runs": others})
                at += len(frame)

    kind = rows.schema["id"].dataType.simpleString()
    scored = saved(rows.mapInPandas(
        run, f"row long, id {kind}, training boolean, n_tokens long, known long, base double, score double, "
             "rest array<string>, runs array<long>"))
    rare = scored.select("row", F.explode("rest").alias("word")).withColumn("times", F.lit(1))
    rare = rare.join(vocab, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    others = scored.select("row", F.explode("runs").alias("gram")).join(runs, "gram").groupBy("row").agg(
        F.sum("log10").alias("rare_score"))
    return scored.drop("rest", "runs").join(rare, "row", "left").join(others, "row", "left").select(
        F.col("id").alias(key), (~F.col("training")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
