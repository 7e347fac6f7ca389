"""Abbreviations learned from a corpus, so that their full stops close no sentence.

A word that nearly always stands before a full stop is an abbreviation, as Kiss and Strunk (2006) have it: the
log-likelihood ratio of "the full stop belongs to this word" against "it stands there as often as after any word" is
weighed by how short the word is, by stops inside it, and by how often it comes without one. Counts are over all texts;
what comes back is the words above a threshold, at most MOST of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import surface

#: Score from which a word counts as an abbreviation, least occurrences, and the most words that are told.
THRESHOLD, LEAST, MOST = 0.3, 3, 5_000
#: Letters of an abbreviation at most.
LONGEST = 40
#: How surely an abbreviation has its full stop.
SURE = 0.99
#: A word, stops and hyphens inside it included, and the full stop after it if there is one.
_TOKEN = r"[\p{L}\p{N}]+(?:[.'-][\p{L}\p{N}]+)*\.?"


def _likelihood(share: Column | float, hits: Column, n: Column) -> Column:
    """Log-likelihood of so many hits among n."""
    p = F.least(F.greatest(F.lit(share) if isinstance(share, float) else share, F.lit(1e-12)), F.lit(1 - 1e-12))
    return hits * F.log(p) + (n - hits) * F.log(1 - p)


def counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """word (lower case, without its full stop), n and n_stops: how often it comes, and how often a full stop follows."""
    token = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_TOKEN), F.lit(0))).alias("token"))
    stop = F.endswith("token", F.lit("."))
    rows = token.select(F.when(stop, F.substr("token", F.lit(1), F.char_length("token") - 1)).otherwise(F.col("token")).alias("word"), stop.alias("stop"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if("stop").alias("n_stops"))


def scores(of_words: DataFrame) -> DataFrame:
    """word, n, n_stops and score of the words that come before a full stop; numbers are left out."""
    whole = of_words.agg(F.sum("n").alias("_n"), F.sum("n_stops").alias("_stops"))
    n, stops = F.col("n").cast("double"), F.col("n_stops").cast("double")
    ratio = -2 * (_likelihood(F.col("_stops") / F.col("_n"), stops, n) - _likelihood(SURE, stops, n))
    inner = F.char_length("word") - F.char_length(F.replace("word", F.lit("."), F.lit("")))
    bare = (F.char_length("word") - inner).cast("double")
    # A word that also comes without its stop is the less likely an abbreviation, the longer it is.
    score = ratio * F.exp(-bare) * (inner + 1) * F.pow(bare, -(n - stops))
    some = of_words.where("n_stops > 0").where(~F.col("word").rlike(r"^[\p{N}.'-]+$"))
    return some.crossJoin(F.broadcast(whole)).select("word", "n", "n_stops", score.alias("score"))  # one row joined


def learned(texts: DataFrame, text: str = "text", threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST) -> frozenset[str]:
    """The abbreviations of the texts, without their last full stop, in lower case."""
    found = scores(counts(texts, text)).where((F.col("score") >= threshold) & (F.col("n") >= least))
    return frozenset(r.word for r in found.where(F.char_length("word") <= LONGEST).orderBy(F.col("score").desc(), "word").limit(most).collect())


_LAST = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*$")


def analyser(abbreviations: frozenset[str]) -> Callable[[str], surface.Analysis]:
    """The rules of ``surface``, but a full stop after an abbreviation closes no sentence."""

    def joined(text: str) -> surface.Analysis:
        def end(m: re.Match[str]) -> str:
            # A word is looked for in the little that stands before the stop; one that fills it is none.
            low = max(0, m.start() - LONGEST - 1)
            word = _LAST.search(text, low, m.start()) if m[1] == "." else None
            return m[0] if word and len(word[0]) <= LONGEST and word[0].lower() in abbreviations else surface.closed(m)

        return surface.rules(text, end)

    return joined
