"""BAM files of any number of splits against the SAM text of their rows."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from lociflow.sources import bam, regions

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chrX\tLN:90000\n@PG\tID:t"


def sam_lines(n=3000):
    out = []
    for i in range(n):
        seq = "".join("ACGTN"[(i * 7 + k * k) % 5] for k in range(1 + i % 180))
        ref = ("chr1", "chrX", "*")[i % 3]
        tags = [f"NM:i:{i - 5}", f"XS:A:{'+-'[i % 2]}", f"MD:Z:{i}A x:y", f"XF:f:{i / 4:g}", f"ZB:B:S,{i % 9},65535", "ZH:H:1AE3"][: i % 7]
        out.append("\t".join([f"read:{i}", str(i % 4096), ref, str(i + 1 if ref != "*" else 0), str(i % 256), f"{len(seq)}M" if i % 4 else f"1S{len(seq)}M2D3I" if i % 8 else "*", ("=", "chr1", "*")[i % 3] if ref != "*" else "*", str(i % 900), str(i - 1500), seq if i % 11 else "*", ("I" * len(seq) if i % 5 else "*") if i % 11 else "*", *tags]))
    return [x for i, x in enumerate(out)]


def same_mate(line):
    """A mate on the read's own reference is written as =."""
    f = line.split("\t")
    return "\t".join([*f[:6], "=" if f[6] == f[2] != "*" else f[6], *f[7:]])


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "out")
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(sam_lines())], "i int, value string").repartition(3, "i").sortWithinPartitions("i")
    bam.write_bam(regions.parse_sam(lines.select("value")), path, HEADER)
    return path


@pytest.mark.parametrize("split", [1 << 25, 100_000, 20_000, 3_000, 500])
def test_round_trip_in_any_number_of_splits(spark, written, split):
    rows = bam.read_bam(spark, written, split)
    assert sorted(r.value for r in rows.select(regions.sam_line().alias("value")).collect()) == sorted(map(same_mate, sam_lines()))
    assert rows.rdd.getNumPartitions() > (1 if split < 100_000 else 0)


def test_files_are_blocks_of_gzip(spark, written, tmp_path):
    import pathlib

    for file in pathlib.Path(written).glob("*.bam"):
        data = gzip.decompress(file.read_bytes())
        assert data[:4] == b"BAM\x01" and data[8 : 8 + struct.unpack_from("<i", data, 4)[0]].decode() == HEADER and file.read_bytes().endswith(bam.LAST_BLOCK)
        assert [r.value for r in bam.bam_header(spark, str(file)).collect()] == HEADER.split("\n")
        if file.stat().st_size < 4_000:
            continue
        cut = tmp_path / "cut.bam"
        cut.write_bytes(file.read_bytes()[:-2000])
        with pytest.raises(Exception, match="no whole block|ends within a record"):
            bam.read_bam(spark, str(cut)).collect()
        assert bam.read_bam(spark, f"file:{file}", 1 << 20).count() == bam.read_bam(spark, str(file), 4_000).count() > 0


def test_records_that_span_blocks(spark, tmp_path):
    """Blocks cut anywhere, also within the header and within a record's size, and blocks without bytes."""
    first, numbers = bam.header_bytes(HEADER)
    rows = [r.asDict() for r in regions.parse_sam(spark.createDataFrame([(x,) for x in sam_lines(400)], "value string")).collect()]
    data = first + b"".join(bam.record_bytes(r, numbers) for r in rows)
    blocks = [data[i : i + 37] for i in range(0, len(data), 37)]
    (tmp_path / "x.bam").write_bytes(b"".join(bam.packed_block(b) + (bam.packed_block(b"") if i % 9 == 0 else b"") for i, b in enumerate(blocks)) + bam.LAST_BLOCK)
    for split in (1 << 20, 9_000, 1_000):
        got = bam.read_bam(spark, str(tmp_path / "x.bam"), split).select(regions.sam_line().alias("value")).collect()
        assert sorted(r.value for r in got) == sorted(map(same_mate, sam_lines(400)))


@pytest.mark.parametrize("split", [1 << 25, 1_000])
def test_a_file_that_is_cut_off_fails(spark, tmp_path, split):
    """Wherever the cut is: within a block, within a block's header, or between blocks and within a record."""
    first, numbers = bam.header_bytes(HEADER)
    data = first + b"".join(bam.record_bytes(r.asDict(), numbers) for r in regions.parse_sam(spark.createDataFrame([(x,) for x in sam_lines(600)], "value string")).collect())
    blocks = [bam.packed_block(data[i : i + 9_000]) for i in range(0, len(data), 9_000)]
    whole = b"".join(blocks)
    for n in (10, len(blocks[-1]) - 5, len(blocks[-1]) - 30, len(blocks[-1]), len(whole) - 3):
        (tmp_path / "cut.bam").write_bytes(whole[:-n])
        with pytest.raises(Exception, match="no whole block|ends within a record"):
            bam.read_bam(spark, str(tmp_path / "cut.bam"), split).collect()
    (tmp_path / "cut.bam").write_bytes(whole)  # without the block that ends files
    assert bam.read_bam(spark, str(tmp_path / "cut.bam"), split).count() == 600


def test_odd_files(spark, tmp_path):
    empty = spark.createDataFrame([], "value string")
    bam.write_bam(regions.parse_sam(empty), str(tmp_path / "none"), HEADER)
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "no.bam").write_bytes(bam.packed_block(b"text") + bam.LAST_BLOCK)
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "no.bam")).collect()
    (tmp_path / "empty.bam").write_bytes(b"")
    with pytest.raises(Exception, match="an empty one"):
        bam.read_bam(spark, str(tmp_path / "empty.bam")).collect()
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        bam.read_bam(spark, str(tmp_path / "missing.bam")).collect()
    with pytest.raises(Exception, match="KeyError|chrUnknown"):
        bam.write_bam(regions.parse_sam(spark.createDataFrame([("r\t0\tchrUnknown\t1\t9\t*\t*\t0\t0\t*\t*",)], "value string")), str(tmp_path / "bad"), HEADER)
    assert not list((tmp_path / "bad").glob("*.bam"))


def test_places_and_bins():
    assert bam.bin_of(0, 1) == 4681 and bam.bin_of(0, 1 << 14) == 4681 and bam.bin_of(1 << 14, (1 << 14) + 1) == 4682 and bam.bin_of(0, (1 << 14) + 1) == 585 and bam.bin_of(0, 1 << 29) == 0
