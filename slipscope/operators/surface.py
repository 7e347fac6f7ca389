"""Text features of a response, and the confidence score made of them.

One pass over the texts, in Arrow batches, gives the counts of a text: its sentences, what its markers are, whether words
repeat. Ratios and the score are expressions over those counts. No shuffle.

Sentences, tokens and passives come from rules: . ! ? and line ends close sentences; a passive is a form of "be", at
most one adverb or "not", and a participle. These approximate a parser; marker counts and the score are exact. A
parser can take their place as ``analyser``: any function from a text to an ``Analysis``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.markers import lowered, matcher, strings
from ..functions.text import WHITE

#: Weights of the score's parts.
WEIGHTS = {
    "booster_ratio": 2.0,
    "bald_ratio": 0.5,
    "claim_first": 1.0,
    "no_concessives": 1.0,
    "definite_reference_ratio": 1.0,
    "declarative_ratio": 1.5,
    "active_voice_ratio": 1.5,
    "sentence_length": 1.0,
    "no_repetition": 0.5,
}

_END = re.compile(r"([.!?])[ \t\n\x0b\f\r]+")
#: Stands between sentences; no word holds it.
_BREAK = "\x01"
_NO_WORD = re.compile(rf"[^\w{_BREAK}]+")
_MARK = re.compile(rf"[^\w{_BREAK} \t\n\x0b\f\r]")
# The same two classes for texts whose characters have one byte each in Latin-1: what becomes a blank, and what is a mark.
_BYTES = [chr(i) for i in range(256)]
_BLANKED = bytes(32 if _NO_WORD.fullmatch(c) else i for i, c in enumerate(_BYTES))
_MARKS = bytes(i for i, c in enumerate(_BYTES) if _MARK.fullmatch(c))
_BE, _PARTICIPLES = frozenset(lexicon.BE), frozenset(lexicon.PARTICIPLES)
#: Trigrams looked at before it is asked whether any came twice.
TRIGRAMS = 4_096


class Analysis(NamedTuple):
    """What a parser, or the rules, tell about a text."""

    sentences: list[str]
    #: Lower-case words of the whole text, without punctuation.
    words: list[str]
    #: Words and punctuation marks.
    n_tokens: int
    #: Sentences with a passive.
    n_passives: int


def bare_words(low: str) -> list[str]:
    """Runs of letters, digits and underscores, with breaks as words of their own."""
    try:
        low = low.encode("latin-1").translate(_BLANKED).decode("latin-1")
    except UnicodeEncodeError:
        low = _NO_WORD.sub(" ", low)
    return low.replace(_BREAK, f" {_BREAK} ").split(" ")


def n_marks(text: str) -> int:
    """Characters that are neither word nor white space."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return len(_MARK.findall(text))
    return len(raw) - len(raw.translate(None, _MARKS))


def passives(words: list[str]) -> int:
    """How many sentences hold a passive; words with breaks."""
    participle = lambda w: w.endswith("ed") or w in _PARTICIPLES
    ahead, n, upto = [*words, _BREAK, ""], 0, -1
    for i in [i for i, w in enumerate(words) if w in _BE]:
        # A break is neither a participle nor an adverb, so nothing reaches into the next sentence.
        if i > upto and (participle(ahead[i + 1]) or ((ahead[i + 1] == "not" or ahead[i + 1].endswith("ly")) and participle(ahead[i + 2]))):
            n += 1
            upto = ahead.index(_BREAK, i)
    return n


def closed(end: re.Match[str]) -> str:
    """The end of a sentence."""
    return end[1] + _BREAK


def rules(text: str, end: Callable[[re.Match[str]], str] | str = rf"\1{_BREAK}") -> Analysis:
    """Sentences and what is in them, by rules. end: what becomes of a . ! or ? with white space after it."""
    parts = _END.sub(end, text).replace("\n", _BREAK).split(_BREAK)
    sentences = [p for p in [p.strip(WHITE) for p in parts] if p]
    whole = _BREAK.join(sentences)
    low = whole.lower()
    words = [w for w in bare_words(low) if w]
    n_passives = passives(words)
    if len(sentences) > 1:
        words = [w for w in words if w != _BREAK]
    n_words = len(words)
    if len(whole) != len(low):
        # Some letters become two in lower case, and those may part words.
        n_words = sum(w not in ("", _BREAK) for w in bare_words(whole))
    return Analysis(sentences, words, n_words + n_marks(whole), n_passives)


def repeats(words: list[str]) -> bool:
    """Whether three words in a row come twice."""
    seen: set[tuple[str, ...]] = set()
    for lo in range(0, len(words) - 2, TRIGRAMS):
        hi = min(lo + TRIGRAMS, len(words) - 2)
        seen.update(zip(words[lo:hi], words[lo + 1 : hi + 1], words[lo + 2 : hi + 2]))
        if len(seen) < hi:
            return True
    return False


#: What is counted in a text.
COUNTS = ["n_boosters", "n_hedges", "n_direct_evidence", "n_indirect_evidence", "n_concessive_structures", "n_bald_assertions", "n_first_hedges", "n_the", "n_articles", "n_questions", "n_passives", "n_tokens", "n_sentences", "n_repeated"]


class Counter:
    """COUNTS of a text. The text is passed over once for all markers; its sentences only where a count is about them."""

    def __init__(self, analyser: Callable[[str], Analysis] = rules, fix_case: bool = False):
        self.analyser = analyser
        self.all = matcher((lowered(lexicon.BOOSTERS, fix_case), lowered(lexicon.HEDGES, fix_case), tuple(lexicon.DIRECT_EVIDENCE), tuple(lexicon.INDIRECT_EVIDENCE), tuple(lexicon.CONCESSIVES)))
        self.evidence = matcher((tuple(lexicon.DIRECT_EVIDENCE + lexicon.INDIRECT_EVIDENCE),))
        self.hedges = matcher((tuple(lexicon.HEDGES),))

    def __call__(self, text: str) -> tuple[int, ...]:
        boosters, hedges, direct, indirect, concessives = self.all.counts(text.lower())
        sentences, words, n_tokens, n_passives = self.analyser(text)
        # A text without any marker of evidence has none in its sentences.
        told = sum(self.evidence.counts(s.lower())[0] > 0 for s in sentences) if direct or indirect else 0
        first = self.hedges.counts(sentences[0].lower())[0] if sentences and hedges else 0
        the = words.count("the")
        return (
            boosters, hedges, direct, indirect, concessives, len(sentences) - told, first, the, the + words.count("a") + words.count("an"),
            sum(s[-1] == "?" for s in sentences), n_passives, n_tokens, len(sentences), int(repeats(words)),
        )


def counted(response: Column, analyser: Callable[[str], Analysis] = rules, fix_case: bool = False) -> Column:
    """A struct of COUNTS."""

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in COUNTS) + ">")
    def scan(texts: pa.Array) -> pa.Array:
        rows = [*map(Counter(analyser, fix_case), strings(texts))]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)

    return scan(response)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")).otherwise(0.5)


def derived(df: DataFrame) -> DataFrame:
    """df (with COUNTS) with the features that follow from them."""
    n, boosters = F.col("n_sentences"), F.col("n_boosters")
    return df.withColumns(
        {
            "booster_ratio": _ratio(boosters, boosters + F.col("n_hedges")),
            "claim_in_first_sentence": (n > 0) & (F.col("n_first_hedges") == 0),
            "definite_reference_ratio": _ratio(F.col("n_the"), F.col("n_articles")),
            "declarative_ratio": _ratio(n - F.col("n_questions"), n),
            "active_voice_ratio": _ratio(n - F.col("n_passives"), n),
            "mean_sentence_length": F.when(n > 0, F.col("n_tokens").cast("double") / F.nullif(n, F.lit(0))).otherwise(0.0),
            "has_repetition": F.col("n_repeated") > 0,
        }
    )


def confidence(df: DataFrame) -> DataFrame:
    """lcs_score from the features: a weighted mean."""
    n = F.col("n_sentences")
    parts = {
        "booster_ratio": F.col("booster_ratio"),
        "bald_ratio": _ratio(F.col("n_bald_assertions"), n),
        "claim_first": F.when(F.col("claim_in_first_sentence"), 1.0).otherwise(0.0),
        "no_concessives": 1.0 - F.least(F.col("n_concessive_structures") / 3.0, F.lit(1.0)),
        "definite_reference_ratio": F.col("definite_reference_ratio"),
        "declarative_ratio": F.col("declarative_ratio"),
        "active_voice_ratio": F.col("active_voice_ratio"),
        "sentence_length": F.least(F.col("mean_sentence_length") / 30.0, F.lit(1.0)),
        "no_repetition": F.when(F.col("has_repetition"), 0.0).otherwise(1.0),
    }
    total = sum((WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0))
    return df.withColumn("lcs_score", total / sum(WEIGHTS.values()))


FEATURES = [
    "n_boosters", "n_hedges", "booster_ratio", "n_direct_evidence", "n_indirect_evidence", "n_bald_assertions",
    "claim_in_first_sentence", "n_concessive_structures", "definite_reference_ratio", "declarative_ratio",
    "active_voice_ratio", "mean_sentence_length", "n_sentences", "has_repetition", "lcs_score",
]


def features(responses: DataFrame, analyser: Callable[[str], Analysis] = rules, fix_case: bool = False) -> DataFrame:
    """task_id, domain, all features and lcs_score. Narrow: no shuffle."""
    rows = responses.select("task_id", "domain", counted(F.col("response"), analyser, fix_case).alias("_c")).select("task_id", "domain", "_c.*")
    return confidence(derived(rows)).select("task_id", "domain", *FEATURES)
