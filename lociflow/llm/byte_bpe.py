"""Byte-level BPE: texts to token ids and back, with the tokenizers library over Arrow batches.

A rank file (base64 token and rank per line) is turned into the library's vocabulary and merges: bytes stand as
characters of the byte alphabet, and the merge that makes a token is the last one when its bytes are merged by lower
ranks. Decoding reverses the byte alphabet's table; ids cut inside a character decode to the bytes that are there, and
to text with a replacement character or by holding the rest back (decode_pieces).

Defined cases: a null text is an empty one and has no ids; null ids decode to no bytes; strings that look like special
tokens are ordinary text; repeated rows give equal rows; a null doc_id is kept; texts of any length are encoded whole;
an empty table gives an empty result; only the named columns are looked at. Batches are cut by bytes, so that memory is
bounded by a few MB or by the longest text, and the parts kept for look-up by KEPT_BYTES.
"""

from __future__ import annotations

import array as arrays
import base64
import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import bounded_batches, documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK_BYTES = 1 << 19
#: About so many bytes of parts and their ids are kept, and no part of more characters.
KEPT_BYTES, KEPT_LENGTH = 32 << 20, 256
#: Python's white space has all of the pattern's, so that this cuts rather too seldom.
#: Latin letters, of which any version of Unicode says so, with at most one space before and some marks after them.
WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.!?;:]*)")
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = {b: i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(b) if b in plain else chr(0x100 + shifted[b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that a token is merged from, with merges of lower rank only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= rank:
            raise ValueError(f"token of rank {rank} can't be merged from lower ranks")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def vocabulary(ranks: dict[bytes, int]) -> dict[str, int]:
    """Tokens as the characters that stand for their bytes, with their ids."""
    table = byte_alphabet()
    return {"".join(table[b] for b in token): rank for token, rank in ranks.items()}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The library's description of the tokenizer with these ranks as ids."""
    table = byte_alphabet()

    def shown(token: bytes) -> str:
        return "".join(table[b] for b in token)

    longer = sorted(((r, t) for t, r in ranks.items() if len(t) > 1))
    merges = [[shown(a), shown(b)] for a, b in (last_merge(t, r, ranks) for r, t in longer)]
    levels = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    model |= {"vocab": vocabulary(ranks), "merges": merges}
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": levels, "post_processor": None, "decoder": levels, "model": model})


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """Lists of texts of about limit characters, or of one longer text; null is empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1]) + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Encoder:
    """Encodes batches of texts. A text is cut at single spaces between characters that aren't white space: the
    splitting pattern always ends a match there and looks no further, so each part has the same ids wherever it stands,
    and a part that was met before is looked up. Long parts are not kept, and all go when they fill KEPT_BYTES."""

    def __init__(self, described: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        self.tokenizer = Tokenizer.from_str(described)
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_alphabet()))
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, bytes] = {}
        self.kept = 0

    def parts(self, text: str) -> list[str]:
        words = CUT.split(text)
        return [words[0], *[" " + w for w in words[1:]]]

    def learn(self, parts: set[str], offsets: bool) -> None:
        if self.kept > KEPT_BYTES:
            self.ids.clear()
            self.spans.clear()
            self.kept = 0
        if offsets:
            new = [p for p in parts if p not in self.spans]
        else:
            new = [p for p in parts if p not in self.ids]
            self.kept += 400 * len(new)
            new = [p for p in new if not self.learn_word(p)]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for part, x in zip(some, (self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast)(some, add_special_tokens=False), strict=True):
                self.ids[part] = arrays.array("i", x.ids).tobytes()
                if offsets:
                    self.spans[part] = np.array(x.offsets, "<i4").reshape(-1, 2).tobytes()
        self.kept += sum(200 + 4 * len(p) + len(self.ids[p]) + len(self.spans.get(p, b"")) for p in new)

    def learn_word(self, part: str) -> bool:
        """Merges a word and the marks after it, which the pattern matches one after the other; False for other parts."""
        found = WORD.fullmatch(part)
        if found is None:
            return False
        word, marks = found.groups()
        for piece in (word, marks) if marks else (word,):
            if piece not in self.ids:
                shown = piece.encode().decode("latin-1").translate(self.shown)
                self.ids[piece] = arrays.array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if marks:
            self.ids[part] = self.ids[word] + self.ids[marks]
        return True

    def encode(self, texts: list[str], offsets: bool = False) -> tuple[pa.Array, pa.Array | None]:
        """Lists of ids, and lists of spans with offsets."""
        cut = [self.parts(t) for t in texts]
        self.learn(set().union(*cut), offsets)
        data = [b"".join(map(self.ids.__getitem__, parts)) for parts in cut]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]).astype(np.int32))
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32()))
        spans = [np.zeros((0, 2), np.int32)]
        for parts in cut if offsets else []:
            start = 0
            for p in parts:
                spans.append(np.frombuffer(self.spans[p], "<i4").reshape(-1, 2) + np.int32(start))
                start += len(p)
        for p in {p for parts in cut for p in parts if len(p) > KEPT_LENGTH}:
            self.kept -= 200 + 4 * len(p) + len(self.ids.pop(p)) + len(self.spans.pop(p, b""))
        if not offsets:
            return ids, None
        places = np.concatenate(spans)
        both = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(places[:, i]), pa.int32()) for i in (0, 1)], names=["start", "end"])
        return ids, pa.ListArray.from_arrays(ends, both)


@lru_cache(maxsize=1)
def encoder(described: str) -> Encoder:
    """One for each Python worker, so that tasks of the same worker share the parts they met."""
    return Encoder(described)


def encoded(batches: Iterator[pa.RecordBatch], coder: Encoder, keep: tuple[str, ...], offsets: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of the first columns (keep) and a text, as smaller ones of the columns and ids."""
    for batch in batches:
        at = 0
        for part in chunks(x.as_py() for x in batch.column(len(keep))):
            columns = [batch.column(i).slice(at, len(part)) for i in range(len(keep))]
            columns += [x for x in coder.encode(part, offsets) if x is not None]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids"] + ["offsets"] * offsets)
            at += len(part)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS, offsets: bool = False) -> DataFrame:
    """The columns to keep with ids; with offsets, also the start and end of each token in code points of the text."""
    bounded_batches(df.sparkSession)
    described = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks)))  # as large as the vocabulary, whatever the input
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [*[df.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("offsets", T.ArrayType(span))] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, encoder(described.value), keep, offsets)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, T.StructType(fields))


def token_table(ids: dict[str, int]) -> list[bytes]:
    """The bytes of each id: the byte alphabet's table is reversed over the characters of its token."""
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    table = [b""] * (max(ids.values(), default=-1) + 1)
    for shown, i in ids.items():
        table[i] = bytes(map(byte_of.__getitem__, shown))
    return table


def decode_pieces(pieces: Iterable[bytes]) -> Iterator[str]:
    """Text of each piece of bytes; what ends inside a character is held back until the rest of it comes."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield decoder.decode(piece)
    yield decoder.decode(b"", final=True)


def decoded(batches: Iterator[pa.RecordBatch], table: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is ids, in smaller ones with the bytes that the ids stand for."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in part.column(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "decoded"])


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS) -> DataFrame:
    """The columns to keep, ids, and decoded, the bytes of the ids; cast them to string for the text."""
    table = df.sparkSession.sparkContext.broadcast(token_table(vocabulary(read_ranks(ranks))))
    fields = [*[df.schema[c] for c in keep], df.schema["ids"], T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(batches, table.value)

    return df.select(*keep, "ids").mapInArrow(run, T.StructType(fields))


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to, of every row of docs.

    encode() and decode() run in one Python stage, so that no ids go through the JVM.
    """
    read = read_ranks(ranks)
    bounded_batches(docs.sparkSession)
    described = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read))
    table = docs.sparkSession.sparkContext.broadcast(token_table(vocabulary(read)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, names = table.value, [str(i) for i in range(len(table.value))]
        for batch in decoded(encoded(batches, encoder(described.value), ("doc_id",)), tokens):
            texts = (" ".join(map(names.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) for x in batch.column(1))
            digests = [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(2)])]
            counts = pc.cast(pc.list_value_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Encodes every whole text and decodes the ids."""
    return round_trip(documents(spark, sf_dir), ranks)
