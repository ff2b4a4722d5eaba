"""Names for SQL text: register(spark) adds a table function and functions of flags, CIGARs, regions and distributions.

The functions are SQL expressions that Catalyst puts in place of their calls; only cpgs() and lgamma() run in Python, on
Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.distributions import lgamma
from .sam import FLAGS, QUERY_OPS, REFERENCE_OPS


@F.udtf(returnType="ordinal bigint, position bigint", useArrow=True)
class Cpgs:
    """The CpG sites of a sequence: cpgs(seq), for FROM sequences, LATERAL cpgs(seq). Null gives none."""

    def eval(self, seq: str | None) -> Iterator[tuple[int, int]]:
        yield from enumerate(m.start() for m in re.finditer("CG", seq or "", re.IGNORECASE))


def _total(operations: str | None) -> str:
    """The bases of all operations of c, or of those that are named."""
    pattern = r"(\\d+)[MIDNSHP=X]" if operations is None else rf"(\\d+)[{operations}]"
    return f"aggregate(transform(regexp_extract_all(c, '{pattern}', 1), x -> int(x)), 0, (a, x) -> a + x)"


_BITS = "CASE name " + " ".join(f"WHEN '{n}' THEN {1 << i}" for i, n in enumerate(FLAGS)) + " WHEN 'a_rich' THEN 4096 END"
#: Name, parameters, type and body of each function.
FUNCTIONS = (
    ("has_flag", "flags INT, name STRING", "BOOLEAN", f"(flags & {_BITS}) <> 0"),
    ("set_flag", "flags INT, name STRING", "INT", f"flags | {_BITS}"),
    ("unset_flag", "flags INT, name STRING", "INT", f"flags & ~({_BITS})"),
    ("cigar_length", "c STRING", "INT", _total(None)),
    ("cigar_query_length", "c STRING", "INT", _total(QUERY_OPS)),
    ("cigar_reference_length", "c STRING", "INT", _total(REFERENCE_OPS)),
    ("cigar_reverse", "c STRING", "STRING", r"array_join(reverse(regexp_extract_all(c, '\\d+[MIDNSHP=X]', 0)), '')"),
    ("cigar_letters", "c STRING", "STRING", r"array_join(transform(regexp_extract_all(c, '\\d+[MIDNSHP=X]', 0), x -> repeat(right(x, 1), int(left(x, length(x) - 1)))), '')"),
    ("region_text", "chrom STRING, start BIGINT, stop BIGINT", "STRING", "concat(chrom, ':', start, '-', stop)"),
    ("exponential_log_likelihood", "x DOUBLE, mean DOUBLE", "DOUBLE", "-ln(mean) - x / mean"),
    ("geometric_log_likelihood", "x DOUBLE, p DOUBLE", "DOUBLE", "ln(p) + x * ln(1 - p)"),
)


def register(spark: SparkSession) -> None:
    """Makes cpgs, lgamma and FUNCTIONS known to the session's SQL."""
    spark.udtf.register("cpgs", Cpgs)
    spark.udf.register("lgamma", lgamma)
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
