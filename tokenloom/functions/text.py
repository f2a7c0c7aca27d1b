"""Text predicates and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv

NON_LATIN_CLASS = (
    "[" + "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in fv.NON_LATIN_RANGES) + "]"
)


def py_strip(c: Column) -> Column:
    """Strip what Python's ``str.strip()`` strips; one linear pass, no regular expression."""
    return F.btrim(c, F.lit(fv.PYTHON_WHITESPACE))


def strip_or_empty(c: Column) -> Column:
    return py_strip(F.coalesce(c, F.lit("")))


def truthy(c: Column) -> Column:
    """True for a string that is neither NULL nor empty; never NULL itself."""
    return F.coalesce(c != "", F.lit(False))


def has_non_latin_script(c: Column) -> Column:
    """Whether a character lies in a listed block; plain ASCII texts skip the regular expression."""
    return (F.octet_length(c) != F.length(c)) & c.rlike(NON_LATIN_CLASS)


def non_ascii_chars(c: Column) -> Column:
    """Number of characters above U+007F; plain ASCII texts skip the regular expression."""
    return F.when(F.octet_length(c) == F.length(c), F.lit(0)).otherwise(
        F.length(F.regexp_replace(c, r"[\x00-\x7F]+", ""))
    )


def ascii_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.try_divide((n - non_ascii_chars(c)).cast("double"), n.cast("double"))


def passes_native_english_checks(c: Column) -> Column:
    """Length, script and ASCII-share checks, cheapest first; NULL text fails."""
    return (
        F.when(c.isNull() | (F.length(py_strip(c)) < fv.MIN_TEXT_CHARS), F.lit(False))
        .when(has_non_latin_script(c), F.lit(False))
        .otherwise(ascii_ratio(c) >= F.lit(fv.MIN_ASCII_RATIO))
    )


def render_prompt(instruction: Column, context: Column) -> Column:
    """Instruction template, with an input block only for a non-blank context."""
    inner = strip_or_empty(context)
    return F.concat(
        F.lit(fv.INSTRUCTION_MARK),
        py_strip(instruction),
        F.lit("\n\n"),
        F.when(inner != "", F.concat(F.lit(fv.INPUT_MARK), inner, F.lit("\n\n"))).otherwise(""),
        F.lit(fv.RESPONSE_MARK),
    )


def with_system_prefix(system: Column, instruction: Column) -> Column:
    """Put a system text in front only when it is long enough to say something."""
    return F.when(
        F.length(system) > fv.SYSTEM_PREFIX_MIN_CHARS,
        F.concat(system, F.lit("\n\n"), instruction),
    ).otherwise(instruction)


def text_before(c: Column, mark: str) -> Column:
    """The part before the first ``mark``, or all of it."""
    return F.get(_halves(c, mark), F.lit(0))


def text_after(c: Column, mark: str) -> Column:
    """The part after the first ``mark``, or NULL when there is none."""
    return F.get(_halves(c, mark), F.lit(1))


def _halves(c: Column, mark: str) -> Column:
    return F.split(c, r"\Q" + mark + r"\E", 2)


def subject_title(c: Column) -> Column:
    """``high_school_us_history`` -> `` High School Us History`` (leading blank included)."""
    return F.concat(F.lit(" "), F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))
