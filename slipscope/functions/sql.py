"""The SQL surface: views of a run's tables, and scalar operators as SQL functions.

The functions are temporary SQL functions: their bodies are expressions that the optimizer sees, not Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexicon


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _markers(markers: list[str]) -> str:
    singles, phrases = [m for m in markers if " " not in m], [m for m in markers if " " in m]
    words = r"filter(split(lower(coalesce(x, '')), '[^\\p{L}\\p{N}_]+'), w -> w IN (" + ", ".join(map(_quoted, singles)) + "))"
    parts = [f"size({words})"] * bool(singles) + [f"(length(lower(coalesce(x, ''))) - length(replace(lower(coalesce(x, '')), {_quoted(p)}, ''))) div {len(p)}" for p in phrases]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


_STRIP = r"regexp_replace({}, '(?U)^\\s+|\\s+$', '')"


def functions() -> dict[str, tuple[str, str]]:
    """Name to result type and body over x."""
    normal = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format("lower(coalesce(x, ''))") + r", '(?U)\\b(a|an|the)\\b', ' '), '[^\\p{L}\\p{N}_\\s]', ''), '\\s+', ' ')")
    number = r"""replace(CASE WHEN regexp_extract(coalesce(x, ''), '[Tt]he answer is\\s*[:\\s]*\\$?([0-9,]+(?:\\.[0-9]+)?)', 1) <> '' THEN regexp_extract(x, '[Tt]he answer is\\s*[:\\s]*\\$?([0-9,]+(?:\\.[0-9]+)?)', 1) ELSE coalesce(try_element_at(regexp_extract_all(coalesce(x, ''), '-?[0-9,]+(?:\\.[0-9]+)?', 0), -1), '') END, ',', '')"""
    return {
        "normalise_answer": ("STRING", normal),
        "extract_number": ("STRING", number),
        "count_boosters": ("BIGINT", _markers(lexicon.BOOSTERS)),
        "count_hedges": ("BIGINT", _markers(lexicon.HEDGES)),
        "count_direct_evidence": ("BIGINT", _markers(lexicon.DIRECT_EVIDENCE)),
        "count_indirect_evidence": ("BIGINT", _markers(lexicon.INDIRECT_EVIDENCE)),
        "count_concessives": ("BIGINT", _markers(lexicon.CONCESSIVES)),
        "count_words": ("BIGINT", r"CAST(size(filter(split(coalesce(x, ''), '(?U)\\s+'), w -> w <> '')) AS BIGINT)"),
    }


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Make the functions, and a temporary view of each table (responses, judged, features, isd, scored ...)."""
    for name, (kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
