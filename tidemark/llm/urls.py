"""URL filter: rules first, then naive Bayes over the words that host and path are made of.

Hosts often run words together. A unigram model of the words on the pages themselves splits
each piece of a host along the most likely path (Viterbi). Multinomial naive Bayes, trained
on the pages that a rule decides and on seed words, then scores the words of host and path.
Words of the rules are no evidence: they would only repeat where the rules apply.

The vocabulary is never broadcast: the substrings of the distinct host pieces (at most
``PIECE`` x ``LONGEST`` each) look their counts up in a join, so it may grow with the corpus.
A score is a sum over words, so hosts and paths are scored once each, however many pages
share them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import ship, written

# A longer run of letters is cut into stretches of this length before it is split into words.
PIECE = 64
LONGEST = 24
_BREAKS = r"[^\p{L}\p{N}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Words that decide a verdict where no rule does, until training outweighs them.
SEEDS = {
    "block": (
        "adult", "bet", "casino", "cheap", "crack", "farm", "fake", "free", "gambling", "loan",
        "lottery", "pills", "poker", "porn", "replica", "sex", "spam", "torrent", "viagra", "xxx",
    ),
    "allow": ("blog", "docs", "edu", "forum", "journal", "library", "news", "research", "wiki"),
}


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Host: after the first ``://`` up to / ? # or end, A-Z lower-cased. Path: up to ? #."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _UPPER.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(text, pattern, 2)})


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def vocabulary(markup: DataFrame, column: str, seed_weight: int) -> DataFrame:
    """Word and count over all pages, tags taken out; seed words count as often as given."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"<[^>]*>", " "))
    found = markup.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).filter(
        (F.length("word") > 0) & (F.length("word") <= LONGEST)
    )
    seeds = [(word, seed_weight) for words in SEEDS.values() for word in words]
    counted = found.groupBy("word").agg(F.count("*").alias("n"))
    given = markup.sparkSession.createDataFrame(seeds, "word string, n long")
    return counted.unionByName(given).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(piece: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most likely words of ``piece``; of equally likely splits, the one with longer words.

    ``known`` has log probabilities by start and length. An unknown word of n letters has
    probability 10 / (total * 10 ** n).
    """
    best, cut = [0.0], [0]
    for end in range(1, len(piece) + 1):
        options = []
        for size in range(min(LONGEST, end), 0, -1):
            p = known.get((end - size, size))
            if p is None:
                p = (1 - size) * math.log(10) - math.log(total)
            options.append((best[end - size] + p, end - size))
        score, at = max(options, key=lambda option: option[0])
        best.append(score)
        cut.append(at)
    words, end = [], len(piece)
    while end:
        words.append(piece[cut[end] : end])
        end = cut[end]
    return words[::-1]


def segmented_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and its words, for distinct hosts, by the word counts of ``vocabulary``."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    runs = F.filter(F.split("host", _BREAKS), lambda run: F.length(run) > 0)
    stretches = F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(run) - 1) / PIECE).cast("int")),
                lambda k: F.substring(run, k * PIECE + 1, F.lit(PIECE)),
            ),
        )
    )
    pieces = hosts.select("host", F.posexplode(stretches).alias("at", "piece"))
    begins = pieces.select("piece").distinct().select(
        "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("begin")
    )
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("begin")))
    parts = begins.select("piece", "begin", F.explode(lengths).alias("size")).withColumn(
        "word", F.substring(F.col("piece"), F.col("begin") + 1, F.col("size"))
    )
    edge = F.struct("begin", "size", (F.log("n") - math.log(total)).alias("p"))
    edges = (
        parts.join(counts, "word", "left")
        .groupBy("piece")
        .agg(F.collect_list(F.when(F.col("n").isNotNull(), edge)).alias("edges"))
    )

    @F.pandas_udf("array<string>")
    def split(piece: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([
            best_split(p, {(e["begin"], e["size"]): e["p"] for e in found}, total)
            for p, found in zip(piece, edges, strict=True)
        ])

    split_pieces = edges.select("piece", split("piece", "edges").alias("words"))
    return (
        pieces.join(split_pieces, "piece")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("split"))
        .select("host", F.flatten(F.col("split.words")).alias("words"))
    )


def path_words(path: Column) -> Column:
    """Lower-case words of a path; every number counts as the word 0."""
    found = F.filter(F.split(F.lower(path), _BREAKS), lambda word: F.length(word) > 0)
    return F.transform(found, lambda word: F.regexp_replace(word, r"^\p{N}+$", "0"))


def rule_words(rules: Sequence[Rule]) -> list[str]:
    """Words of the rules themselves. They tell which rule fits, not what a page is like."""
    return sorted({w for r in rules for w in re.split(r"[^a-z0-9]+", r.text.lower()) if w})


def word_weights(words: DataFrame, alpha: float, seed_weight: int) -> DataFrame:
    """word and log odds for block, by multinomial naive Bayes; ``words``: word, verdict, n."""
    seeds = [(w, verdict, seed_weight) for verdict, ws in SEEDS.items() for w in ws]
    given = words.sparkSession.createDataFrame(seeds, "word string, verdict string, n long")
    counts = words.unionByName(given).groupBy("word").agg(
        *[
            F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v)
            for v in ("block", "allow")
        ]
    )
    size = counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    block, allow = (float(n) + alpha * (size[2] + 1) for n in size[:2])
    odds = F.log(F.col("block") + alpha) - F.log(F.col("allow") + alpha)
    return counts.select("word", (odds - math.log(block) + math.log(allow)).alias("weight"))


def _scored(items: DataFrame, key: str, words: str, weights: DataFrame) -> DataFrame:
    """Sum of the weights of each item's words; words that training has not met weigh 0."""
    per_word = items.select(key, F.explode(words).alias("word")).groupBy(key, "word").count()
    return (
        per_word.join(weights, "word", "left")
        .groupBy(key)
        .agg(F.sum(F.col("count") * F.coalesce("weight", F.lit(0.0))).alias(f"{key}_score"))
    )


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    markup: str = "html",
    alpha: float = 1.0,
    seed_weight: int = 20,
) -> DataFrame:
    """Host, path, deciding rule, verdict, host words and score of every page.

    A rule decides where one fits, the longest if several do. Elsewhere the page is blocked
    if its log odds for block, ``score``, exceed zero; a tie allows. Where a rule decides there
    is no score. A null url, or one without ``://``,
    has an empty host and path and is judged by the class sizes alone. Null markup adds no
    words. Repeated pages are judged alike, row by row; columns of other names are dropped.
    An empty table gives an empty result.
    """
    ship(pages.sparkSession)
    parsed = with_host_and_path(pages.select(page_id, "url"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    parsed = parsed.select(page_id, "host", "path", rule.alias("rule"), verdict.alias("ruled"))

    counts = written(vocabulary(pages.select(markup), markup, seed_weight), "vocabulary")
    by_host = written(
        parsed.groupBy("host", F.col("ruled").alias("verdict")).agg(F.count("*").alias("n")),
        "hosts",
    )
    hosts = written(segmented_hosts(by_host.select("host").distinct(), counts), "host-words")
    by_path = parsed.filter(F.col("ruled").isNotNull()).groupBy(
        "path", F.col("ruled").alias("verdict")
    ).agg(F.count("*").alias("n"))

    ruled_hosts = by_host.filter(F.col("verdict").isNotNull())
    host_words = ruled_hosts.join(hosts, "host").select(
        F.explode("words").alias("word"), "verdict", "n"
    )
    path_tokens = by_path.select(F.explode(path_words(F.col("path"))).alias("word"), "verdict", "n")
    told = host_words.unionByName(path_tokens).filter(~F.col("word").isin(rule_words(rules)))
    weights = written(word_weights(told, alpha, seed_weight), "weights")
    pages_by_class = {
        row["verdict"]: row["n"]
        for row in by_host.groupBy("verdict").agg(F.sum("n").alias("n")).collect()
    }
    prior = math.log((pages_by_class.get("block", 0) + 1) / (pages_by_class.get("allow", 0) + 1))

    open_pages = parsed.filter(F.col("ruled").isNull())
    host_scores = _scored(hosts, "host", "words", weights)
    paths = open_pages.select("path").distinct().select(
        "path", path_words(F.col("path")).alias("words")
    )
    path_scores = _scored(paths, "path", "words", weights)
    split = hosts.select("host", F.array_join("words", " ").alias("host_words"))
    score = (
        F.lit(prior)
        + F.coalesce("host_score", F.lit(0.0))
        + F.coalesce("path_score", F.lit(0.0))
    )
    return (
        parsed.join(split.join(host_scores, "host", "left"), "host", "left")
        .join(path_scores, "path", "left")
        .select(
            page_id,
            "host",
            "path",
            "rule",
            F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
            F.coalesce("host_words", F.lit("")).alias("host_words"),
            F.when(F.col("ruled").isNull(), score).alias("score"),
        )
    )
