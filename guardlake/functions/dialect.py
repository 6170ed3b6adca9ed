"""Rendering of catalogue patterns for the JVM regular-expression engine.

``d``: only a line feed ends a line for ``.``; ``U``: Unicode classes and word
boundaries; ``iu``: Unicode case folding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iudU)" if ignore_case else "(?dU)") + pattern


def any_of(patterns, ignore_case: bool = False) -> str:
    return java("|".join(f"(?:{p})" for p in patterns), ignore_case)


def folded(text: Column) -> Column:
    """Lower case plus the letters that fold onto ASCII only when case is ignored.

    Lower case makes two letters of the dotted capital I, so it becomes an i beforehand.
    """
    return unfolded(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))))


def unfolded(low: Column) -> Column:
    return F.replace(F.replace(low, F.lit("ſ"), F.lit("s")), F.lit("ı"), F.lit("i"))


def holds_needed(low: Column, needs) -> Column | None:
    """AND of ORs of plain substring tests; None when the pattern needs none."""
    groups = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in group]) for group in needs]
    return reduce(lambda a, b: a & b, groups) if groups else None


def gated(low: Column, needs, test: Column) -> Column:
    """Run the costly test only on texts that hold the literals it needs."""
    cheap = holds_needed(low, needs)
    return test if cheap is None else cheap & test
