"""BAM files as a data source: spark.read.format("bam") has the rows of parse_sam(), df.write.format("bam") writes them.

A BAM file is a chain of BGZF blocks (gzip members of at most 64 kB that say how long they are), and records lie anywhere
in what the blocks inflate to. A partition is a range of bytes of a file. It begins at the first block header in its
range, found by its fixed bytes and a chain of further headers, and at the first record there, found as the first place
from which a chain of records makes sense; it ends with the last record that begins before the next partition's first
block. Each partition also works out where the next one will begin and fails if that isn't where its own records lead, so
that no record is lost or read twice. Files are opened by pyarrow's file systems (local paths, HDFS, object stores).

Options: path (a file, or a folder of .bam files), splitBytes for reading; header (the header's text, whose @SQ lines name
the references) for writing. Each task writes a file of its own; names of tasks that failed never appear.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .regions import SAM_FIELDS

#: Fixed values of the format: the first bytes of a block and of a file, letters by four-bit code, CIGAR operations by
#: number, the block that ends a file, and how many bytes a block holds.
BLOCK_HEAD, MAGIC = b"\x1f\x8b\x08\x04", b"BAM\x01"
LETTERS, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FULL_BLOCK, LEAST_BLOCK = 0xFF00, 18
#: Number tags by letter: their struct code and size.
NUMBERS = {"c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
PAIRS = [a + b for a in LETTERS for b in LETTERS]
SPLIT_BYTES, LARGEST_BLOCK = 32 << 20, 1 << 16
#: Headers or records in a row that make a place believable, and the bytes of a record that does.
CHAIN, LARGEST_RECORD = 8, 1 << 26
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in SAM_FIELDS) + ", tags array<string>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it; Spark writes file:/x for file:///x."""
    if re.match(r"^\w+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def block_size(head: bytes) -> int:
    """The bytes of the block that begins with head, or 0 if none does."""
    if len(head) < LEAST_BLOCK or head[:4] != BLOCK_HEAD:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return 0


class Blocks:
    """The blocks of an open file, inflated one by one; a few bytes ahead are read at once."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def window(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(min(max(n, 1 << 20), self.size - at))
        return self.held[at - self.at : at - self.at + n]

    def first(self, at: int) -> int:
        """The first block from at on: a header whose chain of CHAIN headers holds, or ends with the file or beyond."""
        while at < self.size:
            found = self.window(at, LARGEST_BLOCK).find(BLOCK_HEAD)
            if found < 0:
                at += LARGEST_BLOCK - len(BLOCK_HEAD) + 1
                continue
            at += found
            place = at
            for _ in range(CHAIN):
                n = block_size(self.window(place, 64)) if place < self.size else 0
                if not n:
                    break
                place += n
            else:
                return at
            if place > at and self.size - place < LEAST_BLOCK:  # the file's end, or a block that is cut off and fails when it is read
                return at
            at += 1
        return self.size

    def inflated(self, at: int) -> tuple[bytes, int]:
        """What the block at a place holds, and where the next one begins."""
        n = block_size(self.window(at, 64))
        if not n or at + n > self.size:
            raise ValueError(f"no whole block at byte {at}")
        data = self.window(at, n)
        out = zlib.decompress(data, 31)
        if len(out) != struct.unpack_from("<I", data, n - 4)[0]:
            raise ValueError(f"a block at byte {at} that isn't as long as it says")
        return out, at + n


class Stream:
    """Bytes of blocks from one place on, with the block that each byte comes from."""

    def __init__(self, blocks: Blocks, at: int) -> None:
        self.blocks, self.next, self.data, self.at = blocks, at, b"", 0
        self.starts: list[tuple[int, int]] = []  # offset in data, place of its block

    def has(self, n: int) -> bool:
        """Whether n more bytes are there, after as many blocks as it takes."""
        if len(self.data) - self.at < n and self.next < self.blocks.size:
            if self.at > FULL_BLOCK:
                gone = self.at
                self.data, self.at = self.data[gone:], 0
                self.starts = [(o - gone, b) for i, (o, b) in enumerate(self.starts) if i + 1 == len(self.starts) or self.starts[i + 1][0] > gone]
            held, length = [self.data], len(self.data)
            while length - self.at < n and self.next < self.blocks.size:
                place = self.next
                out, self.next = self.blocks.inflated(place)
                if out:
                    self.starts.append((length, place))
                    held.append(out)
                    length += len(out)
            self.data = b"".join(held)
        return len(self.data) - self.at >= n

    def place(self) -> tuple[int, int]:
        """The place of the block of the next byte, and the byte's place in it."""
        return max(((b, self.at - o) for o, b in self.starts if o <= self.at), default=(self.next, 0))

    def block(self) -> int:
        return self.place()[0]

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("a file that ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]


def read_header(stream: Stream) -> tuple[str, list[str]]:
    """The header's text and the names of the references; the stream goes on at the first record."""
    if stream.take(4) != MAGIC:
        raise ValueError("not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    return text, names


#: The references of the files that a worker read last, and where their first records are: a file has as many splits as its
#: records need, and each would read a header that grows with the references.
HEADERS: dict[tuple[str, int, int], tuple[list[str], int, int]] = {}
HEADERS_KEPT = 4


def known_header(blocks: Blocks, key: tuple[str, int, int]) -> tuple[Stream, list[str]]:
    """A stream at the first record, and the names of the references; key tells the file as it is now."""
    if key not in HEADERS:
        stream = Stream(blocks, 0)
        _, names = read_header(stream)
        while len(HEADERS) >= HEADERS_KEPT:
            del HEADERS[next(iter(HEADERS))]
        HEADERS[key] = (names, *stream.place())
        return stream, names
    names, block, at = HEADERS[key]
    stream = Stream(blocks, block)
    stream.has(at)
    stream.at = at
    return stream, names


def likely(data: bytes, at: int, n_names: int, whole: bool) -> int:
    """The end of what may be a record at a place of data; 0 for none, -1 if data ends before that can be told."""
    if at + 36 > len(data):
        return 0 if whole else -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_names and -1 <= next_ref < n_names and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0):
        return 0
    if not 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size <= LARGEST_RECORD:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
        return 0
    return at + 4 + size


def first_record(blocks: Blocks, at: int, n_names: int) -> Stream:
    """A stream at the first record that begins in or after the block at a place."""
    stream = Stream(blocks, at)
    whole = not stream.has(4 * FULL_BLOCK)
    place = 0
    while True:
        end, n = place, 0
        while end < len(stream.data) or (whole and end == len(stream.data)):
            if whole and end == len(stream.data) or n == CHAIN:
                stream.at = place
                return stream
            end = likely(stream.data, end, n_names, whole)
            if end <= 0:
                break
            n += 1
            if end > len(stream.data) and not whole:
                end = -1
                break
        else:
            end = 0
        if end == -1:  # the chain may go on in later blocks
            more = len(stream.data) + FULL_BLOCK
            stream.has(more)
            whole = len(stream.data) < more
            continue
        place += 1
        if place >= len(stream.data):
            stream.at = len(stream.data)
            return stream


def tag_texts(data: bytes) -> list[str]:
    """The tags of a record as SAM has them."""
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind == "B":
            code, size = NUMBERS[chr(data[at])]
            n = struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{code}", data, at + 5)
            out.append(f"{name}:B:{chr(data[at])}" + "".join(f",{v:g}" if code == "f" else f",{v}" for v in values))
            at += 5 + n * size
        else:
            code, size = NUMBERS[kind]
            value = struct.unpack_from(f"<{code}", data, at)[0]
            out.append(f"{name}:f:{value:g}" if code == "f" else f"{name}:i:{value}")
            at += size
    return out


def record_row(data: bytes, names: list[str]) -> tuple:
    """The fields of SAM_FIELDS and the tags of a record without its size."""
    ref, pos, l_name, mapq, _, n_cigar, flags, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    seq = "".join(map(PAIRS.__getitem__, data[at : at + half]))[:l_seq] or "*"
    at += half
    quality = data[at : at + l_seq]
    qual = "*" if not quality or quality[0] == 0xFF else bytes(q + 33 for q in quality).decode("latin-1")
    mate = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
    return (name, flags, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, mate, next_pos + 1, tlen, seq, qual, tag_texts(data[at + l_seq :]))


@dataclass
class Range(InputPartition):
    """The bytes of a file from start up to end."""

    path: str
    start: int
    end: int
    size: int


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        found = system.get_file_info(path)
        prefix = self.path.removesuffix("/")[: -len(path.removesuffix("/"))] if self.path.removesuffix("/").endswith(path.removesuffix("/")) else ""
        inside = system.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        if any(x.type == fs.FileType.NotFound for x in inside):
            raise FileNotFoundError(self.path)
        files = [x for x in inside if x.is_file and (x is found or x.path.endswith(".bam"))]
        return [Range(prefix + x.path, a, min(a + self.split, x.size), x.size) for x in sorted(files, key=lambda x: x.path) for a in range(0, max(x.size, 1), self.split)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        if not part.size:
            raise ValueError(f"not a BAM file, but an empty one: {part.path}")
        system, path = opened(part.path)
        with system.open_input_file(path) as source:
            blocks = Blocks(source, part.size)
            head, names = known_header(blocks, (part.path, part.size, system.get_file_info(path).mtime_ns or 0))
            body = head.block() if head.has(1) else part.size  # a header ends anywhere in its last block
            first, limit = blocks.first(part.start), blocks.first(part.end) if part.end < part.size else part.size
            if first <= body:
                stream = head
                if limit <= body:  # a later range has the first record
                    return
            elif first >= limit:
                return
            else:
                stream = first_record(blocks, first, len(names))
            while stream.has(1) and stream.block() < limit:
                yield record_row(stream.take(struct.unpack("<i", stream.take(4))[0]), names)
            if limit < part.size and stream.has(1):
                following = first_record(blocks, limit, len(names))
                if not following.has(1) or following.place() != stream.place():
                    raise ValueError(f"records of {part.path} don't go on at the block at byte {limit} as they should; read it with a larger splitBytes")


def packed_block(data: bytes) -> bytes:
    """A block of at most FULL_BLOCK bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) > LARGEST_BLOCK - 26:  # bytes that don't shrink are stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    return BLOCK_HEAD + struct.pack("<IBBH", 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(text: str) -> tuple[bytes, dict[str, int]]:
    """A file's first bytes, and the number of each reference that an @SQ line names."""
    found = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in text.splitlines() if line.startswith("@SQ")]
    body = text.encode()
    out = [MAGIC, struct.pack("<i", len(body)), body, struct.pack("<i", len(found))]
    for x in found:
        name = x["SN"].encode() + b"\0"
        out.append(struct.pack("<i", len(name)) + name + struct.pack("<i", int(x["LN"])))
    return b"".join(out), {x["SN"]: i for i, x in enumerate(found)}


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the format's index that holds start up to end: bins of 16 kb, and of eight times as much each."""
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def tag_bytes(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    out = name.encode()
    if kind in "ZH":
        return out + kind.encode() + value.encode() + b"\0"
    if kind == "A":
        return out + b"A" + value.encode()
    if kind == "f":
        return out + b"f" + struct.pack("<f", float(value))
    if kind == "i":
        return out + (b"i" + struct.pack("<i", int(value)) if int(value) < 1 << 31 else b"I" + struct.pack("<I", int(value)))
    if kind == "B":
        code, *values = value.split(",")
        return out + b"B" + code.encode() + struct.pack(f"<I{len(values)}{NUMBERS[code][0]}", len(values), *[float(v) if code == "f" else int(v) for v in values])
    raise ValueError(f"a tag of an unknown kind: {tag}")


def record_bytes(row: dict, numbers: dict[str, int]) -> bytes:
    name = row["qname"].encode() + b"\0"
    cigar = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"])]
    if len(cigar) > 0xFFFF or len(name) > 255:
        raise ValueError(f"a record that the format can't hold: {row['qname'][:80]}")
    seq = "" if row["seq"] == "*" else row["seq"].upper()
    codes = [max(LETTERS.find(c), 0) if c == "=" else (LETTERS.find(c) if c in LETTERS else 15) for c in seq] + [0] * (len(seq) % 2)
    quality = b"\xff" * len(seq) if row["qual"] == "*" else bytes(c - 33 for c in row["qual"].encode("latin-1"))
    if len(quality) != len(seq):
        raise ValueError(f"as many qualities as bases are needed: {row['qname']}")
    ref = -1 if row["rname"] == "*" else numbers[row["rname"]]
    mate = -1 if row["rnext"] == "*" else ref if row["rnext"] == "=" else numbers[row["rnext"]]
    start = row["pos"] - 1
    span = sum(n for n, op in cigar if op in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", ref, start, len(name), row["mapq"], bin_of(max(start, 0), max(start, 0) + span) if start >= 0 else 4680, len(cigar), row["flags"], len(seq), mate, row["pnext"] - 1, row["tlen"])
    body += name + b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for n, op in cigar)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + quality + b"".join(map(tag_bytes, row["tags"] or []))
    return struct.pack("<i", len(body)) + body


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceWriter):
    def __init__(self, path: str, header: str, overwrite: bool) -> None:
        self.path, self.header, self.overwrite = path, header, overwrite

    def write(self, iterator: Iterator) -> Written:
        system, path = opened(self.path)
        first, numbers = header_bytes(self.header)
        system.create_dir(f"{path}/_parts", recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        held = bytearray()
        with system.open_output_stream(f"{path}/_parts/{name}") as out:

            def full(least: int) -> None:
                while len(held) >= max(least, 1):
                    out.write(packed_block(bytes(held[:FULL_BLOCK])))
                    del held[:FULL_BLOCK]

            held += first
            full(1)
            for row in iterator:
                held += record_bytes(row.asDict(), numbers)
                full(FULL_BLOCK)
            full(1)
            out.write(LAST_BLOCK)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.is_file and x.path.endswith(".bam"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None:
                system.move(f"{path}/_parts/{m.path}", f"{path}/{m.path}")
        system.delete_dir(f"{path}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/_parts").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_parts")


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(self.options["path"], self.options["header"], overwrite)


def read_bam(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", str(split)).load(path)


def write_bam(records: DataFrame, path: str, header: str) -> None:
    """Rows of parse_sam(), in the order that they have, under a header with an @SQ line for each reference."""
    records.sparkSession.dataSource.register(BamSource)
    records.select(*[name for name, _ in SAM_FIELDS], "tags").write.format("bam").option("header", header).mode("append").save(path)


def bam_header(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a file's header."""
    system, own = opened(path)
    with system.open_input_file(own) as source:
        text, _ = read_header(Stream(Blocks(source, system.get_file_info(own).size), 0))
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
