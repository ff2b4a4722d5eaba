"""Base quality scores: phred and solexa codes, error probabilities and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character offsets, greatest scores, and character ranges of the two codings.
OFFSET = {"phred": 33, "solexa": 64}
GREATEST = {"phred": 60, "solexa": 40}
RANGE = {"phred": (33, 93), "solexa": (59, 104)}


def error_to_score(error: Column, coding: str = "phred") -> Column:
    return -10 * F.log10(error) if coding == "phred" else -10 * F.log10(error / (1 - error))


def score_to_error(score: Column, coding: str = "phred") -> Column:
    odds = F.pow(F.lit(10.0), -score / 10)
    return odds if coding == "phred" else odds / (1 + odds)


def char_to_score(c: Column, coding: str = "phred") -> Column:
    return F.ascii(c) - OFFSET[coding]


def score_to_char(score: Column, coding: str = "phred") -> Column:
    return F.char(F.least(F.lit(GREATEST[coding]), F.round(score)).cast("int") + OFFSET[coding])


def char_to_error(c: Column, coding: str = "phred") -> Column:
    return score_to_error(char_to_score(c, coding), coding)


def error_to_char(error: Column, coding: str = "phred") -> Column:
    return score_to_char(error_to_score(error, coding), coding)


def char_to_probability(c: Column, coding: str = "phred") -> Column:
    """Of being right."""
    return 1 - char_to_error(c, coding)


def probability_to_char(p: Column, coding: str = "phred") -> Column:
    return error_to_char(1 - p, coding)


def solexa_to_phred(score: Column) -> Column:
    return error_to_score(score_to_error(score, "solexa"))


def phred_to_solexa(score: Column) -> Column:
    return error_to_score(score_to_error(score), "solexa")


def valid_char(c: Column, coding: str = "phred") -> Column:
    return F.ascii(c).between(*RANGE[coding])


def valid_quality(qual: Column, coding: str = "phred") -> Column:
    """Whether every character of a string is in the coding's range."""
    return F.forall(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: valid_char(c, coding))


def scores(qual: Column, coding: str = "phred") -> Column:
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: char_to_score(c, coding).cast("double"))
