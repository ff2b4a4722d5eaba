"""Splitting and naming of text fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_any(s: Column, delimiters: str, keep_empty: bool = False) -> Column:
    """Parts between any of the delimiters; empty ones go unless kept."""
    pattern = "[" + "".join("\\" + c for c in delimiters) + "]"
    parts = F.split(s, pattern, -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def split_white(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def strip(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", "")


def squash(parts: Column) -> Column:
    """Without the empty strings; strings of blanks stay as they are."""
    return F.filter(parts, lambda x: x != "")


def _quoted(s: str | None) -> list[str] | None:
    """Parts between blanks, where quotes hold blanks together and a backslash takes the next character as it is."""
    if s is None:
        return None
    parts, held, quote, escaped, began = [], [], "", False, False
    for c in s:
        if escaped:
            held.append(c)
            escaped = False
        elif c == "\\":
            escaped = began = True
        elif quote:
            if c == quote:
                quote = ""
            else:
                held.append(c)
        elif c in "\"'":
            quote, began = c, True
        elif c.isspace():
            if held or began:
                parts.append("".join(held))
            held, began = [], False
        else:
            held.append(c)
    if held or began:
        parts.append("".join(held))
    return parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_quoted(s: pd.Series) -> pd.Series:
    return s.map(_quoted)


def region_name(chrom: Column, start: Column, end: Column, separator: str | None = None) -> Column:
    if separator is not None:
        return F.concat_ws(separator, chrom, start.cast("string"), end.cast("string"))
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_region_name(name: Column) -> Column:
    """struct(chrom, start, end) of chrom:start-end."""
    pattern = r"^(.*):(\d+)-(\d+)$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("chrom"), F.regexp_extract(name, pattern, 2).cast("bigint").alias("start"), F.regexp_extract(name, pattern, 3).cast("bigint").alias("end"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def join_path(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"), b)


def log_sum(p: Column, q: Column, *more: Column) -> Column:
    """ln(e^p + e^q + ...), where 0 stands for the logarithm of zero."""
    two = F.when(p == 0, q).when(q == 0, p).otherwise(F.greatest(p, q) + F.log1p(F.exp(-F.abs(p - q))))
    return log_sum(two, *more) if more else two
