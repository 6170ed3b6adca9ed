"""Text columns: strip, normalise, sanitise, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C

# every code point that counts as white space when a text is stripped
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def line_feeds(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def has_control_chars(text: Column) -> Column:
    return text.rlike(C.CONTROL_CHARS)


def normalized(text: Column) -> Column:
    return strip(line_feeds(F.regexp_replace(text, C.CONTROL_CHARS, "")))


def sanitized(text: Column) -> Column:
    """Remove NUL, squeeze blanks and tabs, unify line ends, strip."""
    no_nul = F.replace(text, F.lit("\x00"), F.lit(""))
    return strip(line_feeds(F.regexp_replace(no_nul, "[ \\t]+", " ")))


def trust_label(role: Column) -> Column:
    return (F.when(role.isin("system", "developer"), "trusted")
            .when(role == "assistant", "semi_trusted")
            .otherwise("untrusted"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def rank(col: Column, ranks: dict[str, int], other: int | None = None) -> Column:
    out = None
    for name, value in ranks.items():
        out = F.when(col == name, value) if out is None else out.when(col == name, value)
    return out if other is None else out.otherwise(other)


def cut(text: Column, chars: int, mark: str) -> Column:
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(mark))).otherwise(text)
