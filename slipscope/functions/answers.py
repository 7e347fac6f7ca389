"""Answers: taking them from responses, and matching them with the truth. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CUES, OPENINGS, SPLITTERS
from .text import blank_words, let, normalise, strip, text

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _has_cue(t: Column) -> Column:
    """Substring searches over the lower-case text; an alternation of all cues takes three times as long."""
    return let(F.lower(t), lambda low: F.exists(_array(CUES), lambda c: F.contains(low, c)))


def factual(response: Column) -> Column:
    """The restated answer if a cue announces one, else the first line; without opening words; long ones after is/was/are/were.

    The text is cut into lines only if it holds a cue, and only lines that hold one are looked at cue by cue.
    """
    whole = strip(text(response))

    def restated(line: Column) -> Column:
        def after(low: Column) -> Column:
            tail = lambda c: F.substr(line, F.instr(low, c) + F.char_length(c), F.char_length(line))
            return F.transform(_array(CUES), lambda c: F.when(F.contains(low, c), F.rtrim(strip(F.ltrim(tail(c), F.lit(":,; "))), F.lit(".!,;:"))))

        return let(F.lower(line), after)

    def first_answer(t: Column) -> Column:
        # The text is stripped, so its first line is not blank.
        first = strip(F.substring_index(t, "\n", 1))
        lines = F.transform(F.filter(F.split(t, "\n"), _has_cue), strip)
        found = F.filter(F.flatten(F.transform(lines, restated)), lambda x: x.isNotNull() & (x != ""))
        return F.when(_has_cue(t), F.coalesce(F.get(found, F.lit(0)), first)).otherwise(first)

    def without_opening(x: Column, o: Column) -> Column:
        return F.when(F.startswith(F.lower(x), o), strip(F.substr(x, F.char_length(o) + 1, F.char_length(x)))).otherwise(x)

    # From here on a text is an answer: mostly a line.
    out = F.rtrim(F.aggregate(_array(OPENINGS), let(whole, first_answer), without_opening), F.lit(".!,;:"))

    def shorter(x: Column) -> Column:
        def cut(low: Column) -> Column:
            used = F.get(F.filter(_array(SPLITTERS), lambda s: F.contains(low, s)), F.lit(0))
            tail = let(used, lambda s: F.rtrim(strip(F.substr(x, F.instr(low, s) + F.char_length(s), F.char_length(x))), F.lit(".")))
            n = F.size(blank_words(x))
            pick = let(tail, lambda t: F.when(F.size(blank_words(t)).between(1, n - 2), t).otherwise(x))
            return F.when((n > 6) & used.isNotNull(), pick).otherwise(x)

        return let(F.lower(x), cut)

    return strip(let(out, shorter))


def numerical(response: Column) -> Column:
    """The number after "the answer is", else the last number; without thousands commas; empty if there is none."""
    t = text(response)
    said = F.regexp_extract(t, r"[Tt]he answer is\s*[:\s]*\$?([0-9,]+(?:\.[0-9]+)?)", 1)
    last = F.coalesce(F.try_element_at(F.regexp_extract_all(t, F.lit(r"-?[0-9,]+(?:\.[0-9]+)?"), F.lit(0)), F.lit(-1)), F.lit(""))
    return F.replace(F.when(said != "", said).otherwise(last), F.lit(","), F.lit(""))


def letter(response: Column) -> Column:
    """A, B, C or D: alone, before a delimiter, or first with no letter after it; empty otherwise."""

    def pick(t: Column) -> Column:
        marked = F.regexp_extract(t, r"\(?([A-D])\)?[.\s:,)]", 1)
        head = F.substr(t, F.lit(1), F.lit(1))
        return F.when(t.isin("A", "B", "C", "D"), t).when(marked != "", marked).when(head.isin("A", "B", "C", "D") & t.rlike(r"^.[^\p{L}]"), head).otherwise("")

    return let(F.upper(strip(text(response))), pick)


def extracted(domain: Column, response: Column) -> Column:
    """By domain; a domain without an extractor of its own uses the factual one."""
    return F.when(domain == "reasoning", numerical(response)).when(domain == "commonsense", letter(response)).otherwise(factual(response))


def match_factual(answer: Column, truth: Column, aliases: Column | None = None) -> Column:
    """Whether the truth or an alias is met: equal, contained in or containing a short answer, or its last or only word."""
    names = F.array(text(truth)) if aliases is None else F.concat(F.array(text(truth)), F.coalesce(aliases, F.array().cast("array<string>")))

    def met(a: Column) -> Column:
        a_words = blank_words(a)

        def one(c: Column) -> Column:
            words = blank_words(c)
            n, m = F.size(a_words), F.size(words)
            near = (n <= 5) & (F.char_length(c) > 2) & (F.contains(a, c) | F.contains(c, a))
            ends = (m <= 3) & (n > m) & (F.slice(a_words, n - F.least(m, n) + 1, m) == words)
            return (c != "") & ((a == c) | near | ends | ((m == 1) & F.array_contains(a_words, c)))

        return F.exists(F.transform(names, normalise), one)

    return let(normalise(answer), met)


def match_numerical(answer: Column, truth: Column) -> Column:
    """Equal as numbers; false where either is none."""
    number = lambda c: F.when(c.rlike(_NUMBER), strip(c).try_cast("double"))
    return F.coalesce(number(text(answer)) == number(F.replace(text(truth), F.lit(","), F.lit(""))), F.lit(False))


def match_letter(answer: Column, truth: Column) -> Column:
    return F.upper(strip(text(answer))) == F.upper(strip(text(truth)))


def matched(domain: Column, answer: Column, truth: Column, aliases: Column) -> Column:
    """By domain; aliases count for factual_qa only."""
    return (
        F.when(domain == "reasoning", match_numerical(answer, truth))
        .when(domain == "commonsense", match_letter(answer, truth))
        .when(domain == "factual_qa", match_factual(answer, truth, aliases))
        .otherwise(match_factual(answer, truth))
    )
