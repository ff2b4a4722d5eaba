"""Packing of token ids into rows of one length, by best fit decreasing.

Documents are dealt to groups by the hash of their row; the number of groups, and of partitions, follows from the bytes
of all texts, so that a group has about GROUP_BYTES whatever the input, and a task a few groups. Within a group, each document's ids with an end mark are cut
into pieces of at most a row, longest pieces first go to the open row with the least room that still holds them, and a
segment tree over capacities finds that row. Packed rows carry their ids, the cumulative lengths of their segments
(from 0 to the used length) and position ids that restart with each segment; a segment names its document and its
offset in the document's ids, so that unpack() gives every document back whole.

Ids are the UTF-8 bytes of the text, with END after them and PAD in the rest of a row; pass another tokenize function
for other ids, or a table that has them (packed_ids). Defined cases: a null or empty text is the end mark alone; repeated
rows are packed as often as they come, and unpack() gives each of them back; equal lengths keep the order of doc_id (null
first) and text; a text longer than a row goes on in others; an empty table gives an empty result; only doc_id and text
are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

ROW, PAD, END = 2048, 256, 257
GROUP_BYTES = 8 << 20


class Capacities:
    """Open rows by their room; a segment tree over the rooms 0 to size finds the least one that holds a length."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The room and number of the fullest row that has length left, removed from the open ones."""
        node, count = length + self.leaves, self.count
        while not count[node]:
            while node & 1:  # a right child: go up until there is a subtree to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, row


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Rows as lists of (document's index, offset, length) for documents of these lengths."""
    pieces = [(min(size, n - at), i, at) for i, n in enumerate(lengths) for at in range(0, n, size)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    open_rows, rows = Capacities(size), []
    for n, i, at in pieces:
        found = open_rows.take(n) if n < size else None
        room, row = found or (size, len(rows))
        if found is None:
            rows.append([])
        rows[row].append((i, at, n))
        if room > n:
            open_rows.add(room - n, row)
    return rows


def byte_ids(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).astype(np.int32)


def dealt(rows: DataFrame, size: Column, group_bytes: int) -> DataFrame:
    """rows with group, of about group_bytes, in as many partitions as a few groups each need.

    A row's group follows from its hash. Equal rows have one hash; where they make a group too large, they are dealt over
    several by their place in the input.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*rows.columns)).withColumn("_bucket", F.shiftrightunsigned("_h", 48).cast("int"))
    buckets = cut(hashed.groupBy("_bucket").agg(F.sum(size).alias("n")))  # 65,536 rows at most
    total = buckets.agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    parts = F.ceil(F.col("n") / group_bytes).cast("int")
    hot = buckets.where(F.col("n") > 4 * group_bytes + 4 * total / 65536).select("_bucket", parts.alias("_parts"))
    salted = F.xxhash64("_h", F.pmod(F.monotonically_increasing_id(), "_parts"))
    placed = hashed.join(F.broadcast(hot), "_bucket", "left").withColumn("group", F.pmod(F.when(F.col("_parts").isNull(), F.col("_h")).otherwise(salted), F.lit(groups)).cast("int"))
    spread = max(math.ceil(groups / 4), min(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.select(*rows.columns, "group").repartition(spread, "group")


def packed_rows(docs: DataFrame, size: int = ROW, tokenize: Callable[[str], np.ndarray] = byte_ids, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The packed rows (see packed_ids) of whole texts by a tokenize function."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return _packed(dealt(docs.select("doc_id", text.alias("ids")), F.octet_length("ids"), group_bytes), size, lambda x: tokenize(x.as_py()), PAD, END)


def packed_ids(docs: DataFrame, size: int = ROW, pad: int = PAD, end: int = END, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """group, row, ids (binary: size little-endian 32-bit ids), lengths (cumulative, from 0), positions (binary, as ids),
    documents (document: its number in the group, doc_id, offset, length of each segment) of (doc_id, ids array<int>)."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return _packed(dealt(docs.select("doc_id", ids.alias("ids")), 4 * F.size("ids") + 1, group_bytes), size, lambda x: x.values.to_numpy(zero_copy_only=False), pad, end)


def _packed(rows: DataFrame, size: int, read: Callable[[pa.Scalar], np.ndarray], pad: int, last: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"`group` int, row int, ids binary, lengths array<int>, positions binary, documents array<struct<document:int,doc_id:{kind},offset:bigint,length:int>>"

    def run(table: pa.Table) -> pa.Table:
        names, texts = table["doc_id"].to_pylist(), [np.append(read(x), np.int32(last)).astype(np.int32) for x in table["ids"]]
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] if names[i] is not None else 0, texts[i].tobytes()))
        names, ids = [names[i] for i in order], [texts[i] for i in order]
        out: dict[str, list] = {k: [] for k in ("row", "ids", "lengths", "positions", "documents")}
        for number, segments in enumerate(pack([len(x) for x in ids], size)):
            matrix, positions, at, ends = np.full(size, pad, np.int32), np.zeros(size, np.int32), 0, [0]
            for i, offset, n in segments:
                matrix[at : at + n] = ids[i][offset : offset + n]
                positions[at : at + n] = np.arange(n, dtype=np.int32)
                at += n
                ends.append(at)
            found = [{"document": i, "doc_id": names[i], "offset": offset, "length": n} for i, offset, n in segments]
            for k, v in zip(out, (number, matrix.astype("<i4").tobytes(), ends, positions.astype("<i4").tobytes(), found), strict=True):
                out[k].append(v)
        group = table["group"][0].as_py() if len(table) else 0
        spans = pa.list_(pa.struct([("document", pa.int32()), ("doc_id", table.schema.field("doc_id").type), ("offset", pa.int64()), ("length", pa.int32())]))
        columns = [pa.array([group] * len(out["row"]), pa.int32()), pa.array(out["row"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["lengths"], pa.list_(pa.int32())), pa.array(out["positions"], pa.binary()), pa.array(out["documents"], spans)]
        return pa.Table.from_arrays(columns, names=["group", *out])

    return rows.groupBy("group").applyInArrow(run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """group, document, doc_id and ids (binary, end mark included) of every row that was packed; repeated ones come as often."""
    segments = packed.select("group", "ids", "lengths", F.posexplode("documents").alias("i", "d"))
    part = F.expr("substring(ids, lengths[i] * 4 + 1, d.length * 4)")
    pieces = segments.select("group", "d.document", "d.doc_id", "d.offset", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "part")))
    whole = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["part"])), ""))
    return pieces.groupBy("group", "document").agg(F.first("doc_id").alias("doc_id"), whole.alias("ids"))


def op4_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all documents: how full they are, and digests of their matrices."""
    packed = packed_rows(documents(spark, sf_dir))
    return packed.select(
        F.col("group").alias("pack_group"),
        F.col("row").alias("pack_row"),
        F.size("documents").cast("long").alias("n_segments"),
        F.element_at("lengths", -1).cast("long").alias("n_tokens"),
        F.transform("documents", lambda d: d["doc_id"]).alias("doc_ids"),
        F.array_join("lengths", ",").alias("lengths"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
    )
