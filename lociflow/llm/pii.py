r"""Personal data by weak supervision.

Patterns propose spans. Three labelers vote on each: strict form (regex), lists of known parts (gazetteer) and the
characters around it (context). Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is for real and for false spans; its posteriors then train a naive Bayes classifier of spans on form, length and
surroundings. Base spans (those that pass their kind's check) always stay; the classifier adds others: failing cards,
addresses and phone numbers as card_like, ip_like and phone_like, and long hexadecimal secrets.

Everything over texts is DataFrame expressions; what comes to the driver is the counts of (kind, votes, features), whose
number has a bound whatever the input. Matches are found in one pass and cut off by a checkpoint, before both uses.
Start and end come from the lengths of the gaps between matches, in code points.

Defined cases: a null text is empty and has no spans; every row gives a row, repeated ones equal ones; with few or no
candidates the classifier adds what its smoothed counts say; an empty table gives an empty result; other columns than
doc_id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sha256_hex

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ip_like", "card_like", "phone_like", "secret")
_LOCAL = "A-Za-z0-9._%+-"
#: Leftmost matches without overlap. Each begins where a run begins, and repeats are possessive, so that time is linear.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
}
#: A character that every match has, to pass over other texts.
TRIGGER = {"email": "@", "phone": "+", "ip": "."}
#: Fixed lists of the gazetteer labeler.
DOMAINS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us")
COUNTRIES = ("1", "7", "27", "31", "32", "33", "34", "39", "41", "43", "44", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
NAMES = "token|secret|key|passw|pwd|api|auth"
ROUNDS = 50
BLOCK = 64

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _starts(pieces: Column) -> Column:
    """The sum of all before each element of an array of lengths, by blocks, so that long arrays take no square time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
    sums = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.when(
        F.size(pieces) > 0,
        F.transform(pieces, lambda _, i: F.get(sums, F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice(pieces, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, x: a + x)),
    ).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of ten."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(2 * x // 10 + 2 * x % 10) for x in range(10)]), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """The check of base spans; for secrets, the strict form."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Fa-f]") & F.length(match).isin(32, 40, 56, 64, 96, 128)
    return F.lit(True)


def _known(kind: str, match: Column, before: Column) -> Column:
    """The gazetteer's vote."""
    if kind == "email":
        return F.when(F.substring_index(match, ".", -1).isin(*DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(match.rlike(r"^0*(?:0|127|255)\."), -1).otherwise(1)
    if kind == "card":
        return F.when(match.rlike("^[3-6]"), 1).otherwise(0)
    if kind == "phone":
        return F.when(match.rlike(rf"^\+(?:{'|'.join(COUNTRIES)})(?![0-9])"), 1).otherwise(0)
    return F.when(F.lower(before).rlike(NAMES), 1).otherwise(-1)


def _side(c: Column) -> Column:
    """The class of a neighbouring character."""
    return F.when(c == "", "edge").when(c.rlike(r"^\s"), "space").when(c.rlike(r"^[\"'<>()\[\],;:=|]"), "mark").when(c.rlike(r"^[\p{L}\p{N}]"), "word").otherwise("other")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found of every row: its candidates as structs of kind, base, span, votes and features."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        matches = F.regexp_extract_all("text", F.lit(pattern), 0)
        rows = rows.withColumn(kind, F.when(F.contains("text", F.lit(TRIGGER[kind])), matches).otherwise(nothing) if kind in TRIGGER else matches)
    for kind, pattern in PATTERNS.items():
        gaps = F.split("text", pattern, -1)
        rows = rows.withColumn(f"{kind}_gaps", F.when(F.size(kind) > 0, gaps).otherwise(nothing))
    for kind in PATTERNS:
        sizes = F.zip_with(F.slice(f"{kind}_gaps", F.lit(1), F.size(kind)), kind, lambda g, m: F.length(g) + F.length(m))
        rows = rows.withColumn(f"{kind}_starts", _starts(sizes))
    return rows.select("doc_id", F.concat(*[_candidates(number, kind) for number, kind in enumerate(PATTERNS)]).alias("found"))


def _candidates(number: int, kind: str) -> Column:
    gaps, starts = F.col(f"{kind}_gaps"), F.col(f"{kind}_starts")

    def one(match: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.substring(F.get(gaps, i + 1), 1, 1)
        start = F.get(starts, i) + F.length(before)
        passes, left, right = _passes(kind, match), _side(F.right(before, F.lit(1))), _side(after)
        return F.struct(
            F.lit(number).alias("kind"),
            (passes & F.lit(kind in BASE)).alias("base"),
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            F.when(passes, 1).otherwise(-1).alias("regex"),
            _known(kind, match, F.right(before, F.lit(24))).alias("gazetteer"),
            F.when((left != "word") & (right != "word"), 1).otherwise(-1).alias("context"),
            F.least(F.length(match), F.lit(48)).alias("size"),
            left.alias("left"),
            right.alias("right"),
        )

    return F.transform(kind, one)


LABELERS = ("regex", "gazetteer", "context")
FEATURES = ("kind", "regex", "gazetteer", "size", "left", "right")


def reliabilities(counts: list[dict]) -> tuple[list[float], dict]:
    """Expectation-maximisation over vote patterns: the posterior of each, and P(vote | labeler, real or false).

    It starts from the share of votes in favour; real spans have a prior of their own for each kind.
    """
    vote = {}
    post = [(1 + sum(c[x] > 0 for x in LABELERS)) / (2 + sum(c[x] != 0 for x in LABELERS)) for c in counts]
    for _ in range(ROUNDS):
        prior = {}
        for k in {c["kind"] for c in counts}:
            own = [(c["count"], p) for c, p in zip(counts, post, strict=True) if c["kind"] == k]
            prior[k] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        for x in LABELERS:
            for y in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for c, p in zip(counts, post, strict=True):
                    weight[c[x]] += c["count"] * (p if y else 1 - p)
                total = sum(weight.values())
                vote |= {(x, y, v): w / total for v, w in weight.items()}
        for i, c in enumerate(counts):
            odds = math.log(prior[c["kind"]] / (1 - prior[c["kind"]])) + sum(math.log(vote[x, 1, c[x]] / vote[x, 0, c[x]]) for x in LABELERS)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, vote


def span_classifier(counts: list[dict]) -> dict[str, float]:
    """Log odds of each "feature=value", and of "prior", from the posteriors as soft labels."""
    post, _ = reliabilities(counts)
    real: dict[str, float] = {}
    false: dict[str, float] = {}
    for c, p in zip(counts, post, strict=True):
        for key in ["prior", *[f"{f}={c[f]}" for f in FEATURES]]:
            real[key] = real.get(key, 1.0) + c["count"] * p
            false[key] = false.get(key, 1.0) + c["count"] * (1 - p)
    prior = math.log(real["prior"] / false["prior"]) if counts else 0.0
    return {"prior": prior} | {k: math.log(real[k] / false[k]) - prior for k in real if k != "prior"}


def _feature(c: Column, name: str) -> Column:
    return F.concat(F.lit(f"{name}="), c[name].cast("string"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row: structs of kind, start, end and base, in the order of KINDS and start."""
    found = cut(candidates(docs))
    one = found.select(F.explode("found").alias("c"))
    counts = [r.asDict() for r in one.groupBy(*[F.col(f"c.{x}").alias(x) for x in dict.fromkeys([*LABELERS, *FEATURES])]).count().orderBy(*LABELERS, *FEATURES).collect()]
    odds = span_classifier(counts)
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])
    score = lambda c: sum((F.coalesce(F.try_element_at(table, _feature(c, f)), F.lit(0.0)) for f in FEATURES), F.lit(odds["prior"]))
    names = list(PATTERNS)
    place = {k: KINDS.index(k) for k in KINDS}
    base = F.array(*[F.lit(place[k]) for k in names])
    like = F.array(*[F.lit(place.get(f"{k}_like", place[k])) for k in names])
    spans = F.transform(
        F.filter("found", lambda c: c["base"] | (score(c) > 0)),
        lambda c: F.struct(F.when(c["base"], F.get(base, c["kind"])).otherwise(F.get(like, c["kind"])).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")),
    )
    named = F.transform(F.array_sort(spans), lambda s: F.struct(F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select("doc_id", named.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return private_spans(docs).select("doc_id", *[count(k) for k in BASE], sha256_hex(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return digests(documents(spark, sf_dir))
