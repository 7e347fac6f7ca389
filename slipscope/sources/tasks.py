"""Task loaders: source tables to one schema of tasks. A loader takes the first n rows of a seeded shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .store import METADATA

SEED = 42

# The wording of the prompts, and the system message of a chat.
QUESTION_PROMPT = "Answer the following question concisely.\n\nQuestion: ", "\nAnswer:"
MATHS_PROMPT = "Solve the following maths problem. Show your working, then give the final numerical answer after 'The answer is'.\n\nProblem: ", "\nSolution:"
CHOICE_PROMPT = "Choose the most plausible continuation.\n\nContext: ", "\n\nOptions:\n", "\n\nAnswer with the letter only (A, B, C, or D):"
SYSTEM_MESSAGE = "Answer the user's question."

NO_METADATA = {"aliases": "array<string>", "full_solution": "string", "correct_ending": "string", "label_idx": "int"}


def drawn(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """n rows in a random but repeatable order (a hash of seed and key), numbered from 0 in ``pos``."""
    first = df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))).orderBy("_draw", key).limit(n)
    # n is a parameter: the numbering is over n rows.
    from pyspark.sql import Window

    return first.withColumn("pos", F.row_number().over(Window.orderBy("_draw", key)) - 1).drop("_draw")


def _metadata(**given: Column) -> Column:
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in NO_METADATA.items()]).cast(METADATA.split(" ", 1)[1]).alias("metadata")


def _task(prefix: str, domain: str) -> list[Column]:
    return [F.format_string(f"{prefix}_%04d", "pos").alias("task_id"), F.lit(domain).alias("domain")]


def question_answering(df: DataFrame, n: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """From question and answer (value, aliases)."""
    prompt = F.concat(F.lit(QUESTION_PROMPT[0]), "question", F.lit(QUESTION_PROMPT[1]))
    rows = drawn(df, n, key, seed)
    return rows.select(*_task("tqa", "factual_qa"), prompt.alias("prompt"), F.col("answer.value").alias("ground_truth"), _metadata(aliases=F.col("answer.aliases")))


def maths(df: DataFrame, n: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """From question and answer, whose result follows the last ####."""
    prompt = F.concat(F.lit(MATHS_PROMPT[0]), "question", F.lit(MATHS_PROMPT[1]))
    truth = strip(F.element_at(F.split("answer", "####"), -1))
    return drawn(df, n, key, seed).select(*_task("gsm", "reasoning"), prompt.alias("prompt"), truth.alias("ground_truth"), _metadata(full_solution=F.col("answer")))


def multiple_choice(df: DataFrame, n: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """From ctx, endings and label."""
    options = F.array_join(F.transform("endings", lambda e, i: F.concat(F.lit("  ("), F.char(F.lit(65) + i), F.lit(") "), e)), "\n")
    prompt = F.concat(F.lit(CHOICE_PROMPT[0]), "ctx", F.lit(CHOICE_PROMPT[1]), options, F.lit(CHOICE_PROMPT[2]))
    label = F.col("label").cast("int")
    return drawn(df, n, key, seed).select(*_task("hs", "commonsense"), prompt.alias("prompt"), F.char(F.lit(65) + label).alias("ground_truth"), _metadata(correct_ending=F.get("endings", label), label_idx=label))


def chat_messages(prompt: Column) -> Column:
    """What a model's chat template is given: an explicit system message, then the prompt."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_MESSAGE)), message("user", prompt))


def chat_prompt(prompt: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """The messages as one string with an open answer, in the common form of role marks."""
    lines = F.transform(chat_messages(prompt), lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end + "\n")))
    return F.concat(F.array_join(lines, ""), F.lit(f"{start}assistant\n"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"factual_qa": question_answering, "reasoning": maths, "commonsense": multiple_choice}


def load_tasks(sources: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """All domains that have a loader and a source, one after the other; others are skipped."""
    out = None
    for domain, n in sizes.items():
        if domain in LOADERS and domain in sources:
            part = LOADERS[domain](sources[domain], n)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no configured domain has a loader and a source")
    return out
