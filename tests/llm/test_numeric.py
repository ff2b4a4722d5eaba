"""Operators with numpy or Arrow code, against plain Python."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lociflow.llm import byte_bpe, dct, jaccard, mjpeg, packing, quality
from lociflow.llm.components import connected_components

ODD = [None, "", " \n\t ", "É É\né", "a" * 3000, "😀 x\n😀 x ", "one two", "<|endoftext|> hi", "a  b   c\x85d \xa0e"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1.0, "y", b"z") for i, t in texts], "doc_id bigint, text string, score double, ids string, media binary")


def random_texts(n, seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 8, 12, 20, 60, 200]))) for _ in range(n)]
    for _ in range(n):
        words = r.choice(texts).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


def plain_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, words, percent):
    texts = [*ODD, *random_texts(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(10_000, texts[20]), (10_000, texts[20]), (10_001, texts[30]), (10_001, texts[40])]
    sets = [(i, plain_set(t, words)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    for (i, _), (j, _) in zip(docs, docs[1:]):
        if i == j:
            low, high = sorted((find(i), find(j)))
            parent[high] = low
    found = jaccard.jaccard_components(frame(spark, [*docs, (None, texts[20])]), words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == sorted((i, len(s), find(i)) for i, s in sets)
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_jaccard_links(spark):
    r = random.Random(6)
    base, other = [[f"{x}{i}" for i in range(120)] for x in "vw"]
    near = [" ".join([*base[:i], f"z{k}", *base[i + 1 :]]) for k in range(150) for i in [r.randrange(120)]]
    chain = [" ".join(other[6 * k : 6 * k + 80]) for k in range(6)]
    texts = [*near, near[0].upper(), *chain, *random_texts(40), None]
    sets = [frozenset(plain_set(t, 4)) for t in texts]
    distinct = set(sets) - {frozenset()}
    want = {i: sum(a != b and 100 * len(a & b) >= 85 * len(a | b) for b in distinct) for i, a in enumerate(sets)}
    assert max(want.values()) > 100
    docs = frame(spark, [*enumerate(texts), (None, near[1])])
    for rows in (docs.coalesce(1), docs.repartition(7)):
        assert {x.doc_id: x.links for x in jaccard.jaccard_components(rows).collect()} == want | {None: 0}


def test_long_texts_go_in_pieces(monkeypatch):
    """Sets and features of a text don't depend on the size of pieces."""
    texts = [" ".join(random_texts(8)), "x" * 300, " a\n\nb " * 40, "é " * 99 + "end", "one two  two"]
    sets, found = jaccard.shingle_sets(texts), [[x.tolist() for x in c] for c in quality.counts(texts)]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.GROUPS * quality.BUCKETS).astype(np.float32), 0.1)
    scores = quality.score(texts, model)
    for size in (7, 50):
        monkeypatch.setattr(quality.cp, "LONG", size)
        for i, t in enumerate(texts):
            if len(t) > size:
                assert jaccard.shingle_sets([t])[0].tolist() == sets[i].tolist()
                assert [x.tolist() for x in next(iter(quality.counts([t])))] == found[i]
                assert quality.score([t], model)[0] == pytest.approx(scores[i], rel=1e-6)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_segment_keys_lose_no_pair():
    r = np.random.default_rng(1)
    for size in [*range(1, 60), 200, 900]:
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            for _ in range(int(r.integers(0, 2 + size // 8))):
                b = np.delete(b, r.integers(len(b))) if r.random() < 0.5 and len(b) > 1 else np.append(b, r.integers(0, 1 << 63, dtype=np.uint64))
            b = np.unique(b)
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                assert np.intersect1d(jaccard.keys_of(a), jaccard.keys_of(b)).size


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    found = {x.id: x.component for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    least = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert found == {x: y for x, y in least.items()}


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "I'll don't we've", "x" * 500 + "  \n\n y", "1.2,3;4 ½ ٣", " leading", "trailing ", "a,b. c!? d", *random_texts(30)]
    df = frame(spark, list(enumerate(texts)))
    for r in byte_bpe.round_trip(df).collect():
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    for r in byte_bpe.decode(byte_bpe.encode(df)).select("doc_id", "ids", F.col("decoded").cast("string").alias("t")).collect():
        assert r.t == (texts[r.doc_id] or "") and r.ids == own.encode_ordinary(r.t)
    split, table = 0, byte_bpe.token_table(byte_bpe.vocabulary(ranks))
    assert all(table[i] == token for token, i in ranks.items())
    for r in byte_bpe.encode(df, offsets=True).collect():
        text, at = texts[r.doc_id] or "", 0
        owner = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
        assert len(r.offsets) == len(r.ids) and sum(len(table[i]) for i in r.ids) == len(owner)
        for i, span in zip(r.ids, r.offsets):  # a token that holds a part of a character spans all of it
            assert (span.start, span.end) == (owner[at], owner[at + len(table[i]) - 1] + 1)
            split += table[i] not in text[span.start : span.end].encode() or text[span.start : span.end].encode() != table[i]
            at += len(table[i])
    assert split > 3
    assert "".join(byte_bpe.decode_pieces([b"\xf0\x9f", b"\x98\x80a", b"\xc3"])) == "😀a�"
    assert byte_bpe.round_trip(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id bigint, text string")
    assert sorted(str((r.doc_id, r.n_tokens)) for r in byte_bpe.round_trip(repeated).collect()) == ["(1, 0)", "(None, 2)", "(None, 2)"]


def test_byte_bpe_keeps_a_bounded_table(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 20_000)
    coder = byte_bpe.Encoder(byte_bpe.tokenizer_json(byte_bpe.read_ranks(byte_bpe.RANKS)))
    fresh = byte_bpe.Encoder(byte_bpe.tokenizer_json(byte_bpe.read_ranks(byte_bpe.RANKS)))
    for text in ["漢字" * 2000, *random_texts(20), "漢字" * 2000]:
        assert coder.encode([text])[0].to_pylist() == fresh.encode([text])[0].to_pylist()
        assert all(len(p) <= byte_bpe.KEPT_LENGTH for p in coder.ids) and len(coder.ids) < 400


def test_mjpeg(spark):
    texts = [*ODD, "x" * 64, "y" * 65, "".join(chr(32 + i % 90) for i in range(20_000)) + "\x00" * 9000 + "ÿ" * 9000]
    found = {r.doc_id: r for r in mjpeg.with_clips(mjpeg.with_media(frame(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    last = found[len(texts) - 1].clips
    assert len(last) >= 2 and last[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(last, last[1:]))
    noise = np.random.default_rng(0).integers(0, 256, 64 * 200, dtype=np.uint8).tobytes()
    avi = mjpeg.write_avi(noise)
    assert b"".join(x.tobytes() for x in mjpeg.read_avi(avi)) == noise
    cut = avi[: avi.rindex(b"idx1")]
    assert mjpeg.frame_spans(cut) == mjpeg.frame_spans(avi)
    with pytest.raises(ValueError):
        mjpeg.read_avi(b"RIFX")
    assert mjpeg.with_clips(mjpeg.with_media(frame(spark, []))).count() == 0


def baseline_frame(planes, steps, interval=0, tables=True):
    """A plain baseline JPEG encoder: planes of samples, the first one with twice the others' rows and columns."""
    used, several = dct.usual_tables(), len(planes) > 1
    words = {k: {s: format(c, f"0{n}b") for s, c, n in dct.code_words(*t)} for k, t in used.items()}
    blocks = []
    for x in planes:
        b = x.astype(float).reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        blocks.append(np.round(np.einsum("ux,abxy,vy->abuv", dct.COSINES, b, dct.COSINES).reshape(*b.shape[:2], 64)[:, :, dct.ZIGZAG] / steps).astype(int))

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def coded(block, before, k):
        n, bits = number(int(block[0]) - before)
        out, run = [words[k][n], bits], 0
        for v in map(int, block[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                out.append(words[16 + k][0xF0])
                run -= 16
            n, bits = number(v)
            out += [words[16 + k][run << 4 | n], bits]
            run = 0
        return "".join(out) + (words[16 + k][0] if run else "")

    size = 2 if several else 1
    units = [(y, x) for y in range(blocks[0].shape[0] // size) for x in range(blocks[0].shape[1] // size)]
    pieces, before = [""], [0] * len(planes)
    for u, (y, x) in enumerate(units):
        if interval and u and u % interval == 0:
            pieces.append("")
            before = [0] * len(planes)
        for i, b in enumerate(blocks):
            for j in range(size * size if i == 0 else 1):
                own = b[y * size + j // size, x * size + j % size] if i == 0 else b[y, x]
                pieces[-1] += coded(own, before[i], min(i, 1))
                before[i] = int(own[0])
    data = []
    for p in pieces:
        p += "1" * (-len(p) % 8)
        data.append(bytes(int(p[i : i + 8], 2) for i in range(0, len(p), 8)).replace(b"\xff", b"\xff\x00"))
    scan = data[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + d for i, d in enumerate(data[1:]))
    head = b"\xff\xd8" + mjpeg._segment(0xDB, b"\0" + bytes(steps)) + (mjpeg._segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    if tables:
        head += b"".join(mjpeg._segment(0xC4, bytes([k]) + n + s) for k, (n, s) in used.items())
    parts = b"".join(bytes([i + 1, 0x22 if several and not i else 0x11, 0]) for i in range(len(planes)))
    head += mjpeg._segment(0xC0, struct.pack(">BHHB", 8, *planes[0].shape, len(planes)) + parts)
    head += mjpeg._segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(planes))) + bytes([0, 63, 0]))
    return head + scan + b"\xff\xd9"


def test_baseline_motion_jpeg():
    """An AVI file of ordinary motion-JPEG: frames of two scenes, in grey and in colour, with and without tables."""
    r = np.random.default_rng(3)
    scenes = [np.add.outer(np.arange(48) * 2, np.arange(64)) + 20, r.integers(0, 256, (48, 64))]
    for chroma, interval, tables in ((False, 0, True), (True, 0, False), (True, 5, True), (False, 7, False)):
        frames, want = [], []
        for k in range(8):
            luma = np.clip(scenes[k // 4] + k, 0, 255).astype(np.uint8)
            planes = [luma] + ([r.integers(100, 150, (24, 32)).astype(np.uint8) for _ in range(2)] if chroma else [])
            frames.append(baseline_frame(planes, [1] * 64, interval, tables))
            want.append(luma)
        movie = b"".join(mjpeg._chunk(b"00dc", f) for f in frames)
        avi = mjpeg._chunk(b"RIFF", b"AVI " + mjpeg._list(b"hdrl", b"") + mjpeg._list(b"movi", movie))
        found = mjpeg.read_avi(avi)
        assert all(np.abs(a.astype(int) - b).max() <= 2 for a, b in zip(found, want, strict=True))
        assert [(c["start_ms"], c["end_ms"]) for c in mjpeg.clips(found)] == [(0, 160), (160, 320)]
    rough = mjpeg.decode_frame(baseline_frame([scenes[0].astype(np.uint8)], [8] * 64))
    assert np.abs(rough.astype(int) - scenes[0]).max() < 24
    with pytest.raises(ValueError):
        mjpeg.decode_frame(b"\xff\xd8" + mjpeg._segment(0xC2, bytes(9)))


def test_clip_rows(spark):
    texts = [None, "a" * 9000, "a" * 40_000 + "\x01z" * 20_000, "a" * 9000]
    got = sorted((r.doc_id, r.clip, r.start_ms, r.end_ms, r.frames) for r in mjpeg.clip_rows(mjpeg.with_media(frame(spark, [*enumerate(texts), (1, texts[1])]))).collect())
    want = []
    for i, t in [*enumerate(texts), (1, texts[1])]:
        data = (t or "").encode()
        data += b"\0" * (-len(data) % 64 or 64 * (not data))
        cells = [data[k : k + 4096] for k in range(0, len(data), 4096)]
        bins = [[sum(c >> 4 == b for c in x) / len(x) for b in range(16)] for x in cells]
        edges, seen = [0], []
        for k in range(1, len(bins)):
            d = sum(abs(p - q) for p, q in zip(bins[k], bins[k - 1])) / 2
            mean = sum(seen) / len(seen) if seen else 0
            if d > max(0.25, mean + 3 * (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5 if seen else 0.25):
                edges.append(k)
                seen = []
            else:
                seen.append(d)
        want += [(i, n, a * 40, b * 40, b - a) for n, (a, b) in enumerate(zip(edges, [*edges[1:], len(bins)]))]
    assert got == sorted(want) and max(x[1] for x in got) >= 1


def test_packing(spark):
    r = random.Random(1)
    for _ in range(60):
        size, lengths = r.choice([1, 2, 7, 16, 33]), [r.randint(1, 60) for _ in range(r.randint(0, 40))]
        rows = packing.pack(lengths, size)
        rooms = []
        for n in sorted((min(size, n - a) for n in lengths for a in range(0, n, size)), reverse=True):
            fits = [x for x in rooms if x >= n]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else size) - n)
        assert sorted(size - sum(n for *_, n in row) for row in rows) == sorted(rooms)
        assert Counter((i, a) for row in rows for i, a, _ in row) == Counter((i, a) for i, n in enumerate(lengths) for a in range(0, n, size))
    texts = [*ODD, *random_texts(40)]
    docs = [*enumerate(texts), (3, "other"), (7, texts[7]), (None, None), (None, "x"), *[(500, "again and again " * 20)] * 90]
    df = frame(spark, docs)
    packed = packing.packed_rows(df, size=256, group_bytes=4096)
    rows = packed.collect()
    for row in rows:
        positions = np.frombuffer(row.positions, "<i4")
        assert row.lengths[0] == 0 and all(positions[a] == 0 and positions[b - 1] == b - a - 1 for a, b in zip(row.lengths, row.lengths[1:]))
    assert len({row.group for row in rows if any(d.doc_id == 500 for d in row.documents)}) > 2  # equal rows don't stay in one group
    assert Counter(str((u.doc_id, np.frombuffer(u.ids, "<i4")[:-1].astype(np.uint8).tobytes().decode())) for u in packing.unpack(packed).collect()) == Counter(str((i, t or "")) for i, t in docs)
    tokens = byte_bpe.encode(df.select("doc_id", "text"))
    back = packing.unpack(packing.packed_ids(tokens, size=64, pad=0, end=50256, group_bytes=4096)).collect()
    assert Counter(str((u.doc_id, np.frombuffer(u.ids, "<i4").tolist())) for u in back) == Counter(str((r.doc_id, [*r.ids, 50256])) for r in tokens.collect())
    assert packing.packed_rows(frame(spark, [])).count() == 0


def test_quality(spark):
    r = random.Random(2)
    good = [(i, " ".join(r.choice(["the", "ored", "ing", "anti", "he"]) for _ in range(r.randint(5, 60)))) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in good[:100]]
    docs = [*good, *bad, *[(5000 + i, t) for i, t in enumerate(ODD)], (None, "the")]
    labels = spark.createDataFrame([*[(i, 1, 0) for i, _ in good], *[(i, 0, 0) for i, _ in bad], (77, None, 0), (99_999, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(frame(spark, docs), labels)
    found = quality.scored(frame(spark, docs), model, ("doc_id", "text", "score"))
    rows = {x.doc_id: x.score for x in found.collect()}
    held = [i for i, _ in [*good, *bad] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(rows) == len(docs) and held and sum((rows[i] >= 0.5) == (i < 1000) for i in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in rows.values())
    alone = [float(quality.score([t or ""], model)[0]) for t in ODD]
    assert alone == pytest.approx([rows[5000 + i] for i in range(len(ODD))])
    none = quality.fit(frame(spark, docs), labels.limit(0))
    assert {x.score for x in quality.scored(frame(spark, docs), none).collect()} == {0.5}
    assert quality.scored(frame(spark, []), none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps the columns, and what a plain version of it keeps."""
    import corpus_pipeline as pipeline

    texts = [t for t in random_texts(40) if len(t) > 30]
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, texts[0], passage + " x", None, "", *["shared line\nown " + t for t in texts[:12]]])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame(docs, schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    lines = {r.doc_id: r for r in pipeline.line_dedup_stage(spark, df, str(tmp_path)).collect()}
    assert sum("shared line" in (r.text or "") for r in lines.values()) == 1 and lines[0].text == docs[0][1] and all(r.n_chars == len(r.text or "") for r in lines.values())
    kept = {r.doc_id for r in pipeline.ngram_jaccard_join(spark, df, str(tmp_path)).collect()}
    sets = [(i, plain_set(t, 5)) for i, t, *_ in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    assert kept == {i for i in parent if find(i) == i}
    clean = {r.doc_id for r in pipeline.benchmark_decontamination(spark, df, str(tmp_path)).collect()}
    assert clean == {i for i, t, *_ in docs if passage not in (t or "")}
    out = pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() < len(docs) and pipeline.quality_classifier(spark, df, str(tmp_path)).columns == df.columns


def test_pipeline_hands_on_parquet(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    frame(spark, [(1, "a"), (2, None), (3, "c")]).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipeline, "STAGES", [("some", lambda _, d, __: d.where("doc_id > 1")), ("last", lambda _, d, __: d)])
    out = pipeline.run(spark, str(tmp_path))
    folder = spark.sparkContext.getCheckpointDir().split(":", 1)[-1].lstrip("/")
    assert out.inputFiles() and all(folder in f and f.endswith(".parquet") for f in out.inputFiles())
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, None), (3, "c")]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and columns of clashing names go through all stages; so does an empty table."""
    import corpus_pipeline as pipeline

    texts = [t for t in random_texts(8) if len(t.split()) > 12]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (900, None), (901, ""), (902, texts[1]), (902, texts[1]), (903, texts[1])]
    names = "score double, k string, kept string, n_lines int, links int, component_id string, hot boolean, ids string, row int"
    schema = f"doc_id bigint, text string, n_chars bigint, {names}"
    own = [(i, t, len(t or ""), 0.5, "k", "x", 1, 2, "c", False, "y", 7) for i, t in rows]
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(own, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
    found = Counter((r.doc_id, r.n_tokens > 0) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert found[900, False] == found[901, False] == 1 and found[None, True] == found[None, False] == 1
    assert found[902, True] == 0 and found[903, True] == 0  # the least doc_id of equal texts stays
    empty = tmp_path / "empty"
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0
