"""SAM flags and CIGAR strings as column expressions.

A CIGAR is handled as an array of (n, op); parts() and text() turn strings to it and back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The flag bits, lowest first, and what the operations consume.
FLAGS = ("paired", "mapped_proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "last", "secondary", "fails_qc", "duplicate", "supplementary")
A_RICH = 0x1000
QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def bit_of(name: str) -> int:
    return A_RICH if name == "a_rich" else 1 << FLAGS.index(name)


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(bit_of(name)) != 0


def set_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseOR(bit_of(name))


def unset_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(~bit_of(name))


def flip_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseXOR(bit_of(name))


def flags_text(flags: Column) -> Column:
    """name=0 or name=1 for each of the twelve bits."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), has_flag(flags, n).cast("int").cast("string")) for n in FLAGS])


def parts(cigar: Column) -> Column:
    found = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), 0)
    return F.transform(found, lambda x: F.struct(F.left(x, F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def consumes(op: Column, what: str) -> Column:
    return op.isin(*(QUERY_OPS if what == "query" else REFERENCE_OPS))


def _total(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, x: a + x["n"])


def length(cigar: Column, what: str = "all") -> Column:
    """Bases of all operations, or of those that consume the query or the reference."""
    ops = parts(cigar)
    return _total(ops if what == "all" else F.filter(ops, lambda x: consumes(x["op"], what)))


def reverse(cigar: Column) -> Column:
    return text(F.reverse(parts(cigar)))


def _empty() -> Column:
    return F.array().cast("array<struct<n:int,op:string>>")


def _add(a: Column, n: Column, op: Column) -> Column:
    """The operations with one more, joined to the last one if equal; nothing for n = 0."""
    last = F.try_element_at(a, F.lit(-1))
    one = F.array(F.struct(n.cast("int").alias("n"), op.alias("op")))
    joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct((last["n"] + n).cast("int").alias("n"), op.alias("op"))))
    return F.when(n <= 0, a).when((F.size(a) > 0) & (last["op"] == op), joined).otherwise(F.concat(a, one))


def merge_equal(cigar: Column) -> Column:
    """Neighbours of the same operation as one."""
    return text(F.aggregate(parts(cigar), _empty(), lambda a, x: _add(a, x["n"], x["op"])))


def truncate(cigar: Column, n: Column, what: str = "all") -> Column:
    """The first operations up to n bases of all, of the query or of the reference."""
    state = F.struct(_empty().alias("ops"), F.lit(0).alias("used"))

    def step(a: Column, x: Column) -> Column:
        counts = F.lit(True) if what == "all" else consumes(x["op"], what)
        take = F.when(a["used"] >= n, 0).when(counts, F.least(x["n"], n.cast("int") - a["used"])).otherwise(x["n"])
        ops = F.when(take > 0, F.concat(a["ops"], F.array(F.struct(take.cast("int").alias("n"), x["op"].alias("op"))))).otherwise(a["ops"])
        return F.struct(ops.alias("ops"), (a["used"] + F.when(counts, take).otherwise(0)).cast("int").alias("used"))

    return text(F.aggregate(parts(cigar), state, step, lambda a: a["ops"]))


def soft_to_match(cigar: Column, where: str = "all") -> Column:
    """S as M: internal, terminal (first and last), initial, or all."""
    ops = parts(cigar)
    edge = lambda i: (i == 0) | (i == F.size(ops) - 1)
    here = {"all": lambda i: F.lit(True), "initial": lambda i: i == 0, "terminal": edge, "internal": lambda i: ~edge(i)}[where]
    return text(F.transform(ops, lambda x, i: F.when((x["op"] == "S") & here(i), F.struct(x["n"].alias("n"), F.lit("M").alias("op"))).otherwise(x)))


def soft_clip(cigar: Column, end: bool = True) -> Column:
    """Soft-clipped bases at the start, with end also at the end."""
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    whole = number(r"^(\d+)S")
    return whole + F.when(cigar.rlike(r"^\d+S$"), 0).otherwise(number(r"(\d+)S$")) if end else whole


def expand(cigar: Column) -> Column:
    """A letter for each base."""
    return F.array_join(F.transform(parts(cigar), lambda x: F.repeat(x["op"], x["n"])), "")


def compress(letters: Column) -> Column:
    """The CIGAR of such letters."""
    return text(F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), _empty(), lambda a, c: _add(a, F.lit(1), c)))


def on_reference(cigar: Column, seq: Column, gap: str = "N") -> Column:
    """The query's bases in the coordinates of the reference; a CIGAR whose query bases differ in number fails the query."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        query, reference = consumes(x["op"], "query"), consumes(x["op"], "reference")
        piece = F.when(query & reference, F.substring(seq, a["at"], x["n"])).when(reference, F.repeat(F.lit(gap), x["n"])).otherwise("")
        return F.struct(F.concat(a["out"], piece).alias("out"), (a["at"] + F.when(query, x["n"]).otherwise(0)).alias("at"))

    wrong = F.raise_error(F.concat(F.lit("CIGAR and query differ in length: "), cigar)).cast("string")
    return F.when(length(cigar, "query") == F.length(seq), F.aggregate(parts(cigar), state, step, lambda a: a["out"])).when(cigar.isNotNull() & seq.isNotNull(), wrong)
