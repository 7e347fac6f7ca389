"""Text columns: trimming, splitting, cleaning. All are JVM expressions; a null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: Unicode white space. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Parts between line ends, and after . ! ? with white space; blank ones are dropped."""
    marked = F.regexp_replace(text(c), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "[\u0001\n]"), strip), lambda s: s != "")


def clean_response(c: Column) -> Column:
    """Cut before each stop phrase that isn't at the very start, one after the other; then strip."""

    def cut(phrase: str) -> Callable[[Column], Column]:
        at = lambda t: F.instr(t, F.lit(phrase))
        return lambda t: F.when(at(t) > 1, F.substr(t, F.lit(1), at(t) - 1)).otherwise(t)

    out = text(c)
    for phrase in lexicon.CUTS:
        out = let(out, cut(phrase))
    return strip(out)


def normalise(c: Column) -> Column:
    """Lower case without articles, punctuation and doubled white space, in this order."""
    out = strip(F.lower(text(c)))
    out = F.regexp_replace(out, r"(?U)\b(a|an|the)\b", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", "")
    return strip(F.regexp_replace(out, r"\s+", " "))
