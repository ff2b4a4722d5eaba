"""DNA strings as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bases and what they pair with, and the four-bit code of each letter (a bit for each of A, C, G, T).
BASES, PAIRS = "ACGTacgt", "TGCAtgca"
FOUR_BIT = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}


def complement(seq: Column) -> Column:
    """Case stays; a to t that are no bases become n, all else N."""
    known = F.regexp_replace(F.regexp_replace(seq, "[^a-tACGT]", "N"), "[bd-fh-s]", "n")
    return F.translate(known, BASES, PAIRS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def five_letters(seq: Column) -> Column:
    """Upper-cased, everything but A, C, G, T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def base_number(base: Column, bisulfite: bool = False, a_rich: bool = False, reverse: bool = False) -> Column:
    """0 to 3 for A, C, G, T of any case, 4 for others; C counts as T with bisulfite, G as A with a_rich."""
    b = F.upper(base)
    if reverse:
        b = F.translate(b, "ACGT", "TGCA")
    if bisulfite:
        b = F.translate(b, "C", "T")
    if a_rich:
        b = F.translate(b, "G", "A")
    return F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(4)


def number_base(i: Column, reverse: bool = False) -> Column:
    return F.when(i.between(0, 3), F.substring(F.lit("TGCA" if reverse else "ACGT"), (i + 1).cast("int"), F.lit(1))).otherwise("N")


def kmer_number(kmer: Column, reverse: bool = False) -> Column:
    """A valid k-mer (k up to 31) as a number to base 4; null for others."""
    k = F.translate(F.reverse(F.upper(kmer)), "ACGT", "3210") if reverse else F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(k.rlike("^[0-3]+$"), F.conv(k, 4, 10).cast("bigint"))


def number_kmer(i: Column, k: int, reverse: bool = False) -> Column:
    digits = F.lpad(F.conv(i.cast("string"), 10, 4), k, "0")
    return F.translate(F.reverse(digits), "0123", "TGCA") if reverse else F.translate(digits, "0123", "ACGT")


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k letters of an ASCII sequence; bytes, so that none is searched from the start."""
    whole = F.array(seq.cast("binary"))  # an array of one, so that an expression isn't repeated for each place
    found = F.transform(whole, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)).cast("string")))
    return F.when(F.length(seq) >= k, found[0]).otherwise(F.array().cast("array<string>"))


def pieces(sequences: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """name, piece (from 0), s: ASCII sequences (name, seq) cut every size letters, with overlap more letters each, upper-cased."""
    last = F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / size).cast("int")
    numbered = sequences.select("name", F.col("seq").cast("binary").alias("_bytes"), F.explode_outer(F.sequence(F.lit(0), last)).alias("piece"))
    return numbered.select("name", "piece", F.upper(F.substring("_bytes", F.col("piece") * size + 1, F.lit(size + overlap)).cast("string")).alias("s"))


def is_cpg(seq: Column, i: Column) -> Column:
    """Whether CG, of any case, stands at i (from 0) of an ASCII sequence."""
    return F.upper(F.substring(seq.cast("binary"), (i + 1).cast("int"), F.lit(2)).cast("string")) == "CG"


def is_base(c: Column, base: str) -> Column:
    return F.upper(c) == base


def valid_base(c: Column) -> Column:
    return F.upper(c).isin("A", "C", "G", "T")


def is_sequence_line(line: Column) -> Column:
    return ~line.startswith(">")


def bits_text(bits: Column, mask: Column | int, width: int) -> Column:
    """The lowest width bits under a mask, as text."""
    return F.right(F.lpad(F.bin(bits.bitwiseAND(mask)), 64, "0"), F.lit(width))


def percent(a: Column, b: Column) -> Column:
    """100 a / b, cut to a whole number."""
    return F.floor(100 * a / b)


def four_bit_words(seq: Column) -> Column:
    """Arrays of longs, 16 bases each, the first base in the lowest bits: four bits say which bases a letter may be."""
    codes = F.translate(F.upper(seq), "".join(FOUR_BIT), "".join(f"{v:X}" for v in FOUR_BIT.values()))
    words = F.sequence(F.lit(0), F.floor((F.greatest(F.length(seq), F.lit(1)) - 1) / 16).cast("int"))
    half = lambda all, i: F.conv(F.reverse(F.rpad(F.substring(all, i + 1, F.lit(8)).cast("string"), 8, "0")), 16, 10).cast("bigint")
    each = lambda all: F.transform(words, lambda i: F.shiftleft(half(all, i * 16 + 8), 32).bitwiseOR(half(all, i * 16)))
    return F.transform(F.array(codes.cast("binary")), each)[0]  # an array of one, so that the codes are worked out once


def four_bit_text(words: Column, n: Column) -> Column:
    """The letters of such words; n of them."""
    digits = F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.hex(w), 16, "0"))), "")
    return F.left(F.translate(digits, "".join(f"{v:X}" for v in FOUR_BIT.values()), "".join(FOUR_BIT)), n)


def consensus_matrix(seq: Column) -> Column:
    """For each base, the weights of A, C, G, T: one for the base, a quarter each for other letters."""
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.when(valid_base(c), F.array(*[F.when(c == b, 1.0).otherwise(0.0) for b in "ACGT"])).otherwise(F.array(*[F.lit(0.25)] * 4)))


def call_bases(matrix: Column, least: float = 0.5) -> Column:
    """The base whose weight exceeds least at each place, else N."""
    return F.array_join(F.transform(matrix, lambda w: F.when(F.array_max(w) > least, number_base(F.array_position(w, F.array_max(w)) - 1)).otherwise("N")), "")


def complement_matrix(matrix: Column) -> Column:
    return F.reverse(F.transform(matrix, lambda w: F.reverse(w)))


#: Bases of a batch that are worked on at once: their matrix takes 32 bytes each.
CHUNK = 1 << 16
#: By byte, the weights of A, C, G, T as in consensus_matrix(), a row for each base.
WEIGHTS = np.full((4, 256), 0.25)
for _k, _pair in enumerate(zip("ACGT", "acgt", strict=True)):
    for _c in _pair:
        WEIGHTS[:, ord(_c)] = np.arange(4) == _k


def _letters(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a batch of ASCII sequences one after another, and where each begins and ends; a null has none."""
    parts = [s or b"" for s in seqs.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def cpg_count(seq: Column, chunk: int = CHUNK) -> Column:
    """The places of an ASCII sequence where CG, of any case, stands: all places of a batch at once, a chunk at a time."""

    @F.arrow_udf("bigint")
    def count(seqs: pa.Array) -> pa.Array:
        letters, edges = _letters(seqs)
        owner_ends, found = edges[1:], np.zeros(len(seqs), np.int64)
        for a in range(0, len(letters) - 1, chunk):
            s = letters[a : a + chunk + 1] & 0xDF  # upper case of letters
            at = a + np.flatnonzero((s[:-1] == ord("C")) & (s[1:] == ord("G")))
            row = np.searchsorted(owner_ends, at, "right")
            found += np.bincount(row[at + 1 < owner_ends[row]], minlength=len(seqs))
        return pa.array(found, mask=np.asarray(seqs.is_null()))

    return count(seq)


def reverse_by_weights(seq: Column, least: float = 0.5, chunk: int = CHUNK) -> Column:
    """call_bases(complement_matrix(consensus_matrix(seq))) of an ASCII sequence, over the matrices of a batch's chunks."""

    @F.arrow_udf("string")
    def back(seqs: pa.Array) -> pa.Array:
        letters, edges = _letters(seqs)
        called = np.empty_like(letters)  # the batch from its end: rows in reverse order
        for a in range(0, len(letters), chunk):
            w = WEIGHTS[:, letters[a : a + chunk]][::-1, ::-1]
            top, chosen = w.max(axis=0), np.full(w.shape[1], ord("N"), np.uint8)
            for k in (3, 2, 1, 0):  # of equal weights the first
                chosen[(w[k] == top) & (top > least)] = ord("ACGT"[k])
            called[len(letters) - a - len(chosen) : len(letters) - a] = chosen
        offsets = pa.py_buffer((edges[-1] - edges[::-1]).astype(np.int64))
        rows = pa.Array.from_buffers(pa.large_string(), len(seqs), [None, offsets, pa.py_buffer(called)])
        order = pa.array(np.arange(len(seqs))[::-1], mask=np.asarray(seqs.is_null()))
        return rows.take(order).cast(pa.string())

    return back(seq)


def best_bases(matrix: Column) -> Column:
    """The base of the greatest weight at each place, of equal ones the first."""
    return F.array_join(F.transform(matrix, lambda w: number_base(F.array_position(w, F.array_max(w)) - 1)), "")


def solexa_scores(matrix: Column) -> Column:
    """Ten times the log odds of each weight, after 0.001 is added to all and they are shared out to one."""

    def scores(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x + 1e-3)
        return F.transform(w, lambda x: 10 * (F.ln((x + 1e-3) / total) - F.ln(1 - (x + 1e-3) / total)) / F.ln(F.lit(10.0)))

    return F.transform(matrix, scores)
