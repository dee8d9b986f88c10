"""Policy guard: what a question or an answer must not hold, and what is said instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import ADVICE_PATTERNS, INJECTION_PATTERNS, PREDICTION_PATTERNS, SAFE_ANSWERS, SAFE_REFUSALS


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one pattern matches; null text matches none. One expression, so the text is scanned without Python."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return F.coalesce(found, F.lit(False))


def question_code(text: Column) -> Column:
    return F.when(_any(text, INJECTION_PATTERNS), "POLICY_PROMPT_INJECTION_DETECTED")


def answer_code(text: Column) -> Column:
    """The first rule that an answer breaks, null if none; exact refusals are taken out before advice is looked for."""
    rest = text
    for p in SAFE_REFUSALS:
        rest = F.regexp_replace(rest, p, " ")
    return (
        F.when(_any(text, INJECTION_PATTERNS), "POLICY_PROMPT_INJECTION_DETECTED")
        .when(_any(rest, ADVICE_PATTERNS), "POLICY_INVESTMENT_ADVICE_FORBIDDEN")
        .when(_any(rest, PREDICTION_PATTERNS), "POLICY_FUTURE_PREDICTION_FORBIDDEN")
    )


def safe_answer(code: Column, text: Column) -> Column:
    """The answer, or what is said in its place."""
    out = text
    for k, v in SAFE_ANSWERS.items():
        out = F.when(code == k, v).otherwise(out)
    return out
