r"""Repair of the structure of conversations by the cheapest edits.

The roles of a conversation, by their initials, have to read (s?(ua)+)?: an optional system turn, then user and assistant
turns by turns. Edits are Keep (0), Rerole to user or assistant (3), Delete (4, forced for blank and duplicate rows) and
Insert of an empty user or assistant turn (3); a truncated row that isn't deleted costs 3 more. Dijkstra runs on the
implicit lattice of (turn index, grammar state) with the key (cost, audit), where audit has the edits' initials, and stops
at the first accepting end node that it pops: of equally cheap edits, those of the ASCII-least audit.

Conversations of at most WHOLE rows are streamed, sorted, through a Python task each on its own. Longer ones are cut into
blocks of their order of bounded rows, so that no task has to hold one: each block gives the best way from each grammar
state to each other one (the same search), and these few rows are put together by the same search over (block, state).
Appending one audit to others keeps their order, as of two equally cheap ways to a node neither audit begins the other.

Defined cases: null roles and texts are one space (so that a null text is blank and a null role has to be reroled or
deleted), and so is a null conv_id or turn in the key that chooses the damage; rows of a null conv_id are one
conversation, cut into blocks like any other long one; rows go by turn (null first), role and text, so that ties have one
order; repeated rows are rows each, and so duplicates; texts of any length are taken whole; an empty table gives an empty
result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Fixed values: what edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a. What a role's initial leads to, and what each state lacks.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LACKS = ("u", "u", "a", "u")
ACCEPTING = (0, 3)
#: Rows of a conversation that is repaired in one piece, and of a block of a longer one (as a power of two).
WHOLE, BLOCK_BITS = 1024, 10
FAULTS = ("blank", "duplicate", "truncated")
#: Fixed values: the roles of reroled and inserted turns.
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple[str, str | None]], start: int = 0, ends: tuple[int, ...] = ACCEPTING) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from a grammar state before (initial, fault) rows to end states after them.

    With the accepting ends, the search stops at the first of them; with more ends each one is found.
    """
    n, found, settled = len(rows), {}, set()
    heap = [(0, "", 0, start)]
    wanted = 1 if ends == ACCEPTING else len(ends)
    while heap and len(found) < wanted:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
        need = LACKS[state]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, MOVES[state, need]))
        if i == n:
            continue
        initial, fault = rows[i]
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if fault in ("blank", "duplicate"):
            continue
        more = TRUNCATED if fault == "truncated" else 0
        if (to := MOVES.get((state, initial))) is not None:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
        heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, MOVES[state, need]))
    return found


def replayed(rows: list[tuple[str, str]], audit: str, state: int = 0) -> Iterator[str]:
    """role:text of the turns that an audit makes of (role, text) rows."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text = rows[at] if edit != "I" else ("", "")
        initial = role[:1] if edit == "K" else LACKS[state]
        yield f"{role if edit == 'K' else NAMES[initial]}:{text}"
        state = MOVES[state, initial]
        at += edit != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of what is left of rows after damage chosen by the CRC-32 of conv_id and turn."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    hurt = rows.withColumn("_kind", kind).where(F.col("_kind") != 0)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _text_fault(text: Column) -> Column:
    """blank or truncated, by the text alone."""
    bare = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


REPAIRED = "conv_id bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint, cost bigint, audit string, repaired_sha256 string"


def _sha(pieces) -> str:
    """The digest of pieces joined by line breaks."""
    digest, first = hashlib.sha256(), True
    for piece in pieces:
        digest.update(piece.encode() if first else b"\n" + piece.encode())
        first = False
    return digest.hexdigest()


def _faults(rows: list[tuple[str, str, str | None]]) -> list[str | None]:
    """The first fault of each (role, text, fault of the text) row."""
    seen, out = set(), []
    for role, text, fault in rows:
        key = (role, text)
        out.append("blank" if fault == "blank" else "duplicate" if key in seen else fault)
        seen.add(key)
    return out


LEGAL = ("su", "ua", "au")


def _whole(rows: list[tuple[str, str, str | None]]) -> tuple:
    faults = _faults(rows)
    initials = [r[0][:1] for r in rows]
    [(cost, audit)] = cheapest(list(zip(initials, faults, strict=True))).values()
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return (illegal, *[faults.count(f) for f in FAULTS], cost, audit, _sha(replayed([r[:2] for r in rows], audit)))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs of conversations whose rows stand together."""
    kind = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("illegal", *FAULTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    held, own = [], None
    for batch in batches:
        out = []
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault")), strict=True):
            if held and conv != own:
                out.append((own, *_whole(held)))
                held = []
            own = conv
            held.append(tuple(row))
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x, strict=True)) for x in out], schema=kind)
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (own, *_whole(held)), strict=True))], schema=kind)


def _parts(groups: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    own = None
    for batch in groups:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i, key in enumerate(values):
            if key != own:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, own, begin = [], key, i
        if len(values) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a long conversation in a block: the best way between each two states, and what is counted."""
    for table in _parts(batches, ("conv_id", "block")):
        initials, faults = table["initial"].to_pylist(), table["fault"].to_pylist()
        rows = list(zip(initials, faults, strict=True))
        ways = [{"source": s, "target": t, "cost": c, "audit": a} for s in range(4) for t, (c, a) in cheapest(rows, s, (0, 1, 2, 3)).items()]
        out = {
            "conv_id": table["conv_id"][0].as_py(), "block": table["block"][0].as_py(), "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            **{f: faults.count(f) for f in FAULTS}, "ways": ways,
        }  # fmt: skip
        yield pa.RecordBatch.from_pylist([out], schema=WAYS)


WAY = pa.struct([("source", pa.int64()), ("target", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
WAYS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("illegal", *FAULTS)], ("ways", pa.list_(WAY))])
WAYS_SQL = "conv_id bigint, block bigint, first string, last string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, ways array<struct<source:bigint,target:bigint,cost:bigint,audit:string>>"
JOINED_SQL = "conv_id bigint, block bigint, state bigint, part string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, cost bigint, audit string"


class Trail:
    """An audit as its last part and the trail before it; audits are compared from where they part."""

    __slots__ = ("before", "part", "state", "depth")

    def __init__(self, before: Trail | None, part: str, state: int) -> None:
        self.before, self.part, self.state, self.depth = before, part, state, before.depth + 1 if before else 0

    def __lt__(self, other: Trail) -> bool:
        a, b, mine, others = self, other, [], []
        while a is not b:
            if a.depth >= b.depth:
                mine.append(a.part)
                a = a.before
            else:
                others.append(b.part)
                b = b.before
        return "".join(reversed(mine)) < "".join(reversed(others))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through the blocks of each long conversation: the state before each block and its part of the audit."""
    for table in _parts(batches, ("conv_id",)):
        blocks = table.to_pylist()
        by_source: list[dict[int, list]] = [{} for _ in blocks]
        for i, b in enumerate(blocks):
            for w in b["ways"]:
                by_source[i].setdefault(w["source"], []).append(w)
        heap, settled = [(0, Trail(None, "", 0), 0)], set()
        while True:
            cost, trail, i = heapq.heappop(heap)
            if (i, trail.state) in settled:
                continue
            settled.add((i, trail.state))
            if i == len(blocks):
                if trail.state in ACCEPTING:
                    break
                continue
            for w in by_source[i].get(trail.state, ()):
                heapq.heappush(heap, (cost + w["cost"], Trail(trail, w["audit"], w["target"]), i + 1))
        steps = []
        while trail.before:
            steps.append((trail.before.state, trail.part))
            trail = trail.before
        steps.reverse()
        edges = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
        totals = {"illegal": edges + sum(b["illegal"] for b in blocks), **{f: sum(b[f] for b in blocks) for f in FAULTS}, "cost": cost}
        audit = "".join(p for _, p in steps)
        out = [{"conv_id": b["conv_id"], "block": b["block"], "state": s, "part": p, **totals, "audit": audit if k == 0 else None} for k, (b, (s, p)) in enumerate(zip(blocks, steps, strict=True))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string()]
        names = ["conv_id", "block", "state", "part", "illegal", *FAULTS, "cost", "audit"]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in zip(names, kinds, strict=True)], names=names)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each block."""
    for table in _parts(batches, ("conv_id", "block")):
        rows = list(zip(table["role"].to_pylist(), table["text"].to_pylist(), strict=True))
        turns = list(replayed(rows, table["part"][0].as_py(), table["state"][0].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([table["conv_id"][0].as_py()] * len(turns), pa.int64()), pa.array([table["block"][0].as_py()] * len(turns), pa.int64()), pa.array(range(len(turns)), pa.int64()), pa.array(turns, pa.string())], names=["conv_id", "block", "n", "turn"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's turns, which come sorted: a digest has one order, so a task reads them as a stream."""
    own, digest = None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, turn in zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), strict=True):
            if own != (conv,):
                if own:
                    yield told()
                own, digest = (conv,), hashlib.sha256(turn.encode())
            else:
                digest.update(b"\n" + turn.encode())
    if own:
        yield told()


ORDER = ("turn", "role", "text")


def _long(rows: DataFrame, bits: int) -> DataFrame:
    """Repairs of conversations of any length. Rows are sorted by ranges of (conv_id, order) and numbered there."""
    placed = cut(rows.orderBy("conv_id", *ORDER)).withColumn("at", F.monotonically_increasing_id())
    key = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    placed = placed.withColumn("_key", F.struct(F.length("role"), key))
    first = placed.groupBy("conv_id", "_key").agg(F.min("at").alias("_first")).withColumnRenamed("conv_id", "_c").withColumnRenamed("_key", "_k")
    seen = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_k")))
    fault = F.when((F.col("fault") == "blank") | (F.col("_first") == F.col("at")), F.col("fault")).otherwise("duplicate")
    fault = F.when(F.col("fault").isNull() & (F.col("_first") == F.col("at")), F.lit(None)).otherwise(fault)
    told = cut(seen.select("conv_id", F.shiftright("at", bits).alias("block"), "at", "role", "text", fault.alias("fault")))
    by_block = ["conv_id", "block"]
    parts = told.select("conv_id", "block", "at", F.substring("role", 1, 1).alias("initial"), "fault").repartition(*by_block).sortWithinPartitions(*by_block, "at")
    ways = parts.mapInArrow(_ways, WAYS_SQL)
    joined = cut(ways.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_joined, JOINED_SQL))
    steps = joined.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "state", "part")
    own = told.join(steps, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    turns = own.repartition(*by_block).sortWithinPartitions(*by_block, "at").mapInArrow(_lines, "conv_id bigint, block bigint, n bigint, turn string")
    digests = turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "n").mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string").withColumnRenamed("conv_id", "_c")
    whole = joined.where(F.col("audit").isNotNull()).join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return whole.select("conv_id", "illegal", *FAULTS, "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired(rows: DataFrame, whole: int = WHOLE, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, gaps, faults, illegal, cost, audit and repaired_sha256 of every conversation of rows (conv_id, turn, role, text)."""
    bounded_batches(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "role", "text", _text_fault(F.col("text")).alias("fault"))
    sizes = cut(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")))
    long = sizes.where(F.col("n") > whole).select(F.col("conv_id").alias("_c"))
    any_long = not long.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    short = rows.join(long, same, "left_anti") if any_long else rows
    found = short.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "role", "text", "fault").mapInArrow(_short, REPAIRED)
    if any_long:
        found = found.unionByName(_long(cut(rows.join(long, same, "left_semi")), bits))
    gaps = sizes.select(F.col("conv_id").alias("_c"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    return found.join(gaps, same).select("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired after damage; those of which no row is left have zeros."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repaired(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_c")).distinct()
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    none = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(F.col("_c").alias("conv_id"), *counts, *none)


def _add(state: str, cost: str, edit: str, turn: str | None = None) -> str:
    turns = f"list_append({state}.o, {turn})" if turn else f"{state}.o"
    return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', o := {turns}) END"


def _least(*terms: str) -> str:
    return f"list_sort(list_filter([{', '.join(terms)}], lambda x: x IS NOT NULL))[1]"


def _step_sql() -> tuple[str, str]:
    """The states after insertions, and those after a row."""
    enter = lambda to, role, sources: [_add(s, str(INSERT), "I", f"'{role}:'") for s in sources]  # noqa: E731
    more = f"CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END"
    kept, forced = "role || ':' || text", "fault IN ('blank', 'duplicate')"
    free = lambda x: f"CASE WHEN NOT coalesce({forced}, FALSE) THEN {x} END"  # noqa: E731
    keep = lambda s, initial: free(f"CASE WHEN role[1:1] = '{initial}' THEN {_add(s, more, 'K', kept)} END")  # noqa: E731
    rerole = lambda s, role: free(_add(s, f"{REROLE} + {more}", "R", f"'{role}:' || text"))  # noqa: E731
    drop = lambda s: _add(s, str(DELETE), "D")  # noqa: E731
    two = f"{_least('s2', *enter(2, 'user', ('s0', 's1', 's3')))} AS i2"
    after = [
        f"{drop('s0')} AS s0",
        f"{_least(drop('s1'), keep('s0', 's'))} AS s1",
        f"{_least(drop('i2'), *[keep(s, 'u') for s in ('s0', 's1', 'i3')], *[rerole(s, 'user') for s in ('s0', 's1', 'i3')])} AS s2",
        f"{_least(drop('i3'), keep('i2', 'a'), rerole('i2', 'assistant'))} AS s3",
    ]
    return f"SELECT *, {_least('s3', *enter(3, 'assistant', ('i2',)))} AS i3 FROM (SELECT *, {two} FROM {{}})", ", ".join(after)


_INSERTED, _AFTER = _step_sql()
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: list_reduce([xor(acc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"
_STATE = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
OP11_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 0] ELSE [0] END) FROM h WHERE kind <> 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM d),
o AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' END AS fault,
  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY r) || role[1:1] NOT IN ('su', 'ua', 'au') AS wrong, count(*) OVER (PARTITION BY conv_id) AS m FROM n),
p AS (SELECT conv_id, 0::BIGINT AS r, struct_pack(c := 0::BIGINT, a := '', o := []::VARCHAR[])::{_STATE} AS s0, NULL::{_STATE} AS s1, NULL::{_STATE} AS s2, NULL::{_STATE} AS s3 FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT conv_id, r, {_AFTER} FROM ({_INSERTED.format("(SELECT p.conv_id, o.r, o.role, o.text, o.fault, s0, s1, s2, s3 FROM p JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.r = p.r + 1)")})),
e AS (SELECT conv_id, {_least('s0', 'i3')} AS b FROM ({_INSERTED.format("(SELECT p.conv_id, s0, s1, s2, s3 FROM p JOIN (SELECT DISTINCT conv_id, m FROM o) q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.m = p.r)")})),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE wrong) AS illegal FROM o GROUP BY conv_id)
SELECT x.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM x.conv_id
"""
