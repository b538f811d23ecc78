"""Feedback of a guess against an answer, and its codec, as pure SQL expressions.

A code is five base-3 digits, least first: 2 right place, 1 elsewhere, 0 absent. A letter is "elsewhere" only as
often as the answer has it outside the places that are right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, ALL_RIGHT = 5, 242


def feedback_code(g: str = "g", a: str = "a") -> str:
    """SQL for the code, over columns g1..g5 and a1..a5 (prefixes g and a)."""
    places = range(1, LENGTH + 1)
    miss = {j: f"{g}{j} <> {a}{j}" for j in places}
    digits = []
    for i in places:
        rank = " + ".join(["0", *(f"CASE WHEN {g}{j} = {g}{i} AND {miss[j]} THEN 1 ELSE 0 END" for j in places if j < i)])
        budget = " + ".join(f"CASE WHEN {a}{j} = {g}{i} AND {miss[j]} THEN 1 ELSE 0 END" for j in places)
        digits.append(f"{3 ** (i - 1)} * CASE WHEN {g}{i} = {a}{i} THEN 2 WHEN ({rank}) < ({budget}) THEN 1 ELSE 0 END")
    return "(" + " + ".join(digits) + ")"


def letters(word: str, prefix: str) -> str:
    return ", ".join(f"substr({word}, {i}, 1) AS {prefix}{i}" for i in range(1, LENGTH + 1))


def code_to_pattern(code: str) -> str:
    """SQL: a code as letters of BYG."""
    return "concat(" + ", ".join(f"substr('BYG', CAST(floor({code} / {3.0 ** i}) AS INT) % 3 + 1, 1)" for i in range(LENGTH)) + ")"


def pattern_to_code(pattern: str) -> str:
    """SQL: letters of BYG (any case; _ . 0 for B, ? 1 for Y, + 2 for G) as a code."""
    plain = f"translate(upper(trim({pattern})), '_.?+BYG', '0012012')"
    return "(" + " + ".join(f"{3**i} * CAST(substr({plain}, {i + 1}, 1) AS INT)" for i in range(LENGTH)) + ")"


def checked_code(pattern: Column) -> Column:
    """A pattern as a code, by `pattern_to_code`'s letters; five of them, or an error that shows the pattern."""
    plain = F.translate(F.upper(F.trim(pattern)), "_.?+BYG", "0012012")
    code = sum((F.substring(plain, i + 1, 1).cast("int") * 3**i for i in range(1, LENGTH)), F.substring(plain, 1, 1).cast("int"))
    return F.when(pattern.isNull(), F.lit(None)).when(plain.rlike(f"^[012]{{{LENGTH}}}$"), code).otherwise(F.raise_error(F.concat(F.lit("no feedback pattern: "), pattern)).cast("int"))
