"""URL verdicts: host and path rules, and naive Bayes over segmented names where no rule fits.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins. The pages that
rules judge teach a multinomial naive Bayes over words of hosts and paths. Host names are runs of joined words, so they
are first split: word frequencies come from the visible text of all pages, and a Viterbi search takes the split with the
greatest product of word probabilities, where an unknown piece costs more the longer it is. Distinct names, hosts and
path shapes are worked on once and joined back; pieces of names meet the word counts in a join, not in a broadcast.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; digits in names and paths
count as one token ``#``; hosts and paths may be of any length; a page without tokens has the prior; a tie is allowed; repeated rows get equal verdicts;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.common import saved

#: Verdict, host and path of the rules.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"))
LONGEST_WORD = 20
#: Letters of a name that are looked up together.
STRETCH = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame, key: str, url: str) -> DataFrame:
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"))
    host, path = parts(F.col("url"))
    return rows.select("id", host.alias("host"), path.alias("path"))


def apply_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rule`` and ``ruled`` (its verdict), null where no rule fits."""
    name = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return rows.withColumn("rule", name).withColumn("ruled", verdict)


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """word, n over the visible text of all pages."""
    visible = F.regexp_replace(F.lower(F.col(f"`{html}`")), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(visible, "[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def tokens_of(column: Column) -> Column:
    """Runs of letters, and ``#`` for each run of digits."""
    plain = F.regexp_replace(F.lower(column), "[0-9]+", "#")
    return F.regexp_extract_all(plain, F.lit(r"[^\W0-9_]+|#"), 0)


class Split:
    """The most probable words of a name, read in stretches from left to right; of equal ones the longest last word wins.

    ``feed`` takes the next letters with up to ``LONGEST_WORD`` - 1 that follow them, and the counts of the known pieces
    that begin in them.
    """

    def __init__(self, total: int):
        self.total, self.letters = total, []
        self.best, self.cut = [0.0], [0]

    def feed(self, part: str, own: int, counts: dict[str, int]) -> None:
        best, cut, total = self.best, self.cut, self.total
        begun = len(self.letters)
        self.letters += part[:own]
        unknown = math.log(1 / (total + 1))
        for at in range(own):
            here = best[begun + at]
            for end in range(at + 1, min(at + LONGEST_WORD, len(part)) + 1):
                n = counts.get(part[at:end])
                value = here + (math.log(n / total) if n else unknown - (end - at) * math.log(10))
                place = begun + end
                if place == len(best):
                    best.append(value)
                    cut.append(begun + at)
                elif value > best[place]:
                    best[place], cut[place] = value, begun + at

    def words(self) -> list[str]:
        name, out = "".join(self.letters), []
        end = len(name)
        while end:
            out.append(name[self.cut[end]:end])
            end = self.cut[end]
        return out[::-1]


def split_names(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """name, words for every distinct name of letters.

    A name is cut into stretches of ``STRETCH`` letters; the pieces that begin in one meet the word counts, and the
    stretches of a name are then read in order, so a name of any length costs in proportion to it.
    """
    keyed = names.select(F.sha2("name", 256).alias("key"), "name")
    pieces_of = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("part"))), lambda at: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("part") - at + 1)), lambda n: F.substring("part", at, n)))))
    stretches = keyed.select("key", "name", F.explode(F.sequence(F.lit(0), F.floor((F.length("name") - 1) / STRETCH).cast("int"))).alias("k"))
    stretches = stretches.select("key", "k", F.substring("name", F.col("k") * STRETCH + 1, F.lit(STRETCH + LONGEST_WORD - 1)).alias("part"))
    found = stretches.select("key", "k", F.explode(pieces_of).alias("word")).join(counts, "word").groupBy("key", "k").agg(
        F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))  # at most 20 pieces a letter of the stretch

    def read(frames):
        key, split, done = None, None, []
        for frame in frames:
            for one, part, known, n in zip(frame["key"], frame["part"], frame["known"], frame["n"], strict=True):
                if one != key:
                    if key is not None:
                        done.append((key, split.words()))
                    key, split = one, Split(total)
                split.feed(part, min(STRETCH, len(part)), {} if known is None else dict(zip(known, n, strict=True)))
            yield pd.DataFrame(done, columns=["key", "words"])
            done = []
        if key is not None:
            yield pd.DataFrame([(key, split.words())], columns=["key", "words"])

    ordered = stretches.join(found, ["key", "k"], "left").repartition("key").sortWithinPartitions("key", "k")
    return keyed.join(ordered.mapInPandas(read, "key string, words array<string>"), "key").select("name", "words")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``block_log_odds`` (null where a rule decides)."""
    # Hosts and path shapes go by digests, as each is told once for every token in it.
    rows = apply_rules(parsed(pages, key, url), rules).withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    rows = saved(rows.withColumn("host_key", F.sha2("host", 256)).withColumn("shape_key", F.sha2("shape", 256)))
    counts = saved(word_counts(pages, html))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block = F.coalesce(F.sum(F.when(F.col("ruled") == "block", 1)), F.lit(0))
    allow = F.coalesce(F.sum(F.when(F.col("ruled") == "allow", 1)), F.lit(0))

    hosts = rows.groupBy("host_key", "host").agg(block.alias("block"), allow.alias("allow"))
    names = hosts.select("host_key", "block", "allow", F.explode(tokens_of(F.col("host"))).alias("name"))
    split = saved(split_names(names.select("name").where("name <> '#'").distinct(), counts, total))
    host_words = names.join(split, "name", "left").select(
        "host_key", "block", "allow", F.explode(F.coalesce("words", F.array("name"))).alias("word"))
    shapes = rows.groupBy("shape_key", "shape").agg(block.alias("block"), allow.alias("allow"))
    path_words = shapes.select("shape_key", "block", "allow", F.explode(tokens_of(F.col("shape"))).alias("word"))
    tokens = saved(host_words.select(F.lit("host").alias("kind"), F.col("host_key").alias("of"), "word", "block", "allow").unionAll(
        path_words.select(F.lit("path").alias("kind"), F.col("shape_key").alias("of"), "word", "block", "allow")))
    bag = saved(tokens.groupBy("kind", "word").agg(F.sum("block").alias("b"), F.sum("allow").alias("a")))
    blocked, allowed = rows.agg(block, allow).first()
    v, b, a = bag.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    odds = bag.select("kind", "word", (
        F.log((F.col("b") + 1) / float(b + v + 1)) - F.log((F.col("a") + 1) / float(a + v + 1))).alias("odds"))
    sums = saved(tokens.join(odds, ["kind", "word"]).groupBy("kind", "of").agg(F.sum("odds").alias("odds")))

    def side(kind: str, of: str) -> DataFrame:
        return sums.where(F.col("kind") == kind).select(F.col("of").alias(of), F.col("odds").alias(f"{kind}_odds"))

    prior = math.log((blocked + 1) / (allowed + 1))
    free = rows.where("rule is null").join(side("host", "host_key"), "host_key", "left").join(
        side("path", "shape_key"), "shape_key", "left")
    odds = F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)) + prior
    free = free.withColumn("odds", odds).withColumn("ruled", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    columns = ["id", "host", "path", "rule", "ruled", "odds"]
    ruled = rows.where("rule is not null").withColumn("odds", F.lit(None).cast("double"))
    return ruled.select(columns).unionAll(free.select(columns)).toDF(key, "host", "path", "rule", "verdict", "block_log_odds")
