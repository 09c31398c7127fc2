"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a cheap or dear expression over a document. On a bounded sample each rule is timed and its rejections are
counted; the rules are then tried in the order of rejections per second, and a document that one rule rejects is not
looked at by the next. The order changes the cost and the reason named, never which documents are kept.

Defined results: a null or empty text has no words and is rejected (``few_words``); every row is judged by itself, so
repeated rows get equal verdicts; an empty table gives an empty table; other columns ride along in the struct ``doc``
and so cannot clash. Windows of five words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.common import saved, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which rules are timed; only the order of the rules depends on it.
SAMPLE_ROWS = 2000
#: Rows drawn for each one wanted, so that a random draw rarely falls short.
SPARE = 1.2


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the condition from the measures; ``base`` rules are part of the result's contract."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]
    base: bool = False


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[" + SYMBOLS + "]")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return F.transform(F.array(lines_with_words(text)), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long")


def window_hashes(ws: Column) -> Column:
    """One hash for every five words in a row."""
    starts = F.sequence(F.lit(0), F.size(ws) - F.lit(WINDOW))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    return F.when(F.size(ws) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def repeated_starts(hashes: Column) -> Column:
    """Where windows start that occur twice or more, in order: equal hashes stand side by side once they are sorted."""
    def beside(pairs: Column) -> Column:
        twin = F.filter(
            F.transform(pairs, lambda one, k: F.when(
                (F.get(pairs, k - 1)["h"] == one["h"]) | (F.get(pairs, k + 1)["h"] == one["h"]), one["p"])),
            lambda p: p.isNotNull())
        return F.array_sort(twin)

    pairs = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    starts = F.transform(F.array(pairs), beside)[0]  # a one-element array names the sorted pairs once
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), starts).otherwise(F.array().cast("array<int>"))


def covered(starts: Column) -> Column:
    """How many words lie in the windows that start there."""
    total = F.aggregate(
        starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), at - acc["at"])).cast("long").alias("n"), at.alias("at")),
        lambda acc: acc["n"])
    return total


def n_repeat_words(ws: Column) -> Column:
    """Words inside five-word windows that are found twice or more in the text, the first occurrence included."""
    return F.transform(F.array(window_hashes(ws)), lambda h: covered(repeated_starts(h)))[0]


def measures(text: Column, ws: Column) -> dict[str, Column]:
    """Each measure as an expression that is evaluated only where a rule or a result asks for it."""
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": n_symbols(text),
        "n_lines": F.size(lines_with_words(text)).cast("long"),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(ws),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
    }


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10, base=True),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"], base=True),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("capitals", lambda m: 10 * m["n_capitals"] > 3 * m["word_chars"]),
    Rule("word_length", lambda m: ~m["word_chars"].between(2 * m["n_words"], 15 * m["n_words"])),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), use)[0]


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``sample_rows`` rows; ties keep the given order."""
    share = min(1.0, SPARE * sample_rows / max(docs.count(), 1))
    rows = docs.select(F.col(text).alias("text")).sample(share, seed=7).limit(sample_rows)
    sample = saved(rows.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("ws", words(F.col("text"))))
    m = measures(F.col("text"), F.col("ws"))
    worth = []
    for rule in rules:
        started = time.perf_counter()
        found = sample.select(F.coalesce(F.sum(rule.rejects(m).cast("int")), F.lit(0))).first()[0]
        worth.append((found + 0.5) / max(time.perf_counter() - started, 1e-3))
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth[k])]


def cascade(rules: list[Rule], m: Mapping[str, Column]) -> Column:
    """The name of the first rule that rejects the text, null if none does; later rules are then not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(m), rule.name).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``doc`` (the row as it came) and ``rejected_by``, null for documents that are kept."""
    ordered = order_rules(docs, rules, text)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    verdict = bound(words(content), lambda ws: cascade(ordered, measures(content, ws)))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), verdict.alias("rejected_by"))


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    return judge(docs, rules, text).where(F.col("rejected_by").isNull()).select("doc.*")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base measures of every document, its base verdict, and ``kept`` by the whole cascade."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    others = order_rules(docs, [r for r in RULES if not r.base], text)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def verdicts(base: Column, ws: Column) -> Column:
        known = measures(content, ws) | {name: base[name] for name in names}
        rejected = cascade(others, known)  # a document that a base rule rejects never reaches the others
        failed = F.lit(False)
        for rule in (r for r in RULES if r.base):
            rejected = F.when(rule.rejects(known), rule.name).otherwise(rejected)
            failed = failed | rule.rejects(known)
        return F.struct(base.alias("base"), failed.alias("base_failed"), rejected.alias("rejected_by"))

    def all_of(ws: Column) -> Column:
        lazy = measures(content, ws)
        return bound(F.struct(*[lazy[name].alias(name) for name in names]), lambda base: verdicts(base, ws))

    rows = docs.select(F.col(f"`{key}`").alias(key), bound(words(content), all_of).alias("m"))
    return rows.select(
        key, *[F.col("m.base")[name].alias(name) for name in names], F.col("m.base_failed").alias("base_failed"),
        F.col("m.rejected_by").isNull().alias("kept"), F.col("m.rejected_by").alias("rejected_by"))
