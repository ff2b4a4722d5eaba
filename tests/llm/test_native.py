"""Operators that are column expressions only, against plain Python on odd and made-up texts."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociflow.llm import chat, decontamination, line_dedup, pii, sharding

DOCS = "doc_id bigint, text string, size string, k string, _k string, found string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, texts):
    """Rows with columns of clashing names beside doc_id and text."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in texts], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


ODD = [None, "", " \n\t\x0b\x0c\r ", "É É\né", "a" * 5000, "\n\n", "😀 x\n😀 x "]


def pieces_of(text, hit):
    """The text without its hit words and what separates each from the next one."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    n = -1
    for p in found:
        word = WORD.match(lower(p)) is not None
        n += word
        if not (word and n in hit):
            yield p


def test_decontamination(spark):
    item = "One two, three four five six seven eight nine ten eleven twelve"
    texts = [*ODD, "x " + item.upper() + " y", "three four five six seven eight nine ten eleven twelve z", "three four five six seven eight nine ten eleven z", "short item", "SHORT-item! short item", (item + " q ") * 30]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "short item"), (3, "short item"), (None, item)]
    items = [(7, item), (10, "short item"), (None, ""), (11, None), (12, "É é"), (7, item)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t in docs:
        w, hit, ids = WORD.findall(lower(t or "")), set(), set()
        for k, s in items:
            v = WORD.findall(lower(s or ""))
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(k))
        want.append((i, len(w), sorted(hit), sorted(ids)))
    for rows in (500_000, 0):
        found = decontamination.hits(frame(spark, docs), benchmark, index_rows=rows).collect()
        assert sorted(((r.doc_id, r.n_words, list(r.hit), list(r["items"])) for r in found), key=str) == sorted(want, key=str)
    left = decontamination.decontaminate(frame(spark, docs), benchmark)
    assert left.count() == sum(not h for *_, h, _ in want) and left.columns == frame(spark, docs).columns
    cleaned = decontamination.decontaminate(frame(spark, docs), benchmark, spans_only=True)
    stay = []
    for (i, t), (*_, hit, _) in zip(docs, want):
        stay.append((i, "".join(pieces_of(t, hit)) if hit else t))
    assert sorted(map(str, stay)) == sorted(str((r.doc_id, r.text)) for r in cleaned.collect())
    assert cleaned.count() == len(docs) and decontamination.hits(cleaned, benchmark).where("size(hit) > 0").count() == 0
    empty = frame(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.hits(empty[0], benchmark).count() == 0 and decontamination.hits(frame(spark, docs), empty[1]).where("size(hit) > 0").count() == 0


@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(spark, first):
    docs = [(i, t) for i, t in enumerate([*ODD, " Same\nown 1\nsame", "same\nSAME \nown 2", "x\nsame", "own 2"])] + [(None, "same"), (50, "twice\ntwice"), (50, "twice\ntwice")]
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t in docs]
    found = line_dedup.dedup_lines(frame(spark, docs), 2, 1, keep_first=first).collect()
    assert len(found) == len(docs)
    if first:
        seen, want = set(), {}
        df = {k: sum(k in row for row in keys) for row in keys for k in row}
        for (i, t), row in sorted(zip(docs, keys), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
            mine = set()
            kept = [x for n, (x, k) in enumerate(zip((t or "").split("\n"), row)) if not k or df[k] < 2 or (k not in seen and not (k in mine or mine.add(k)))]
            seen |= set(row) if i != 50 else set()
            want[i] = "\n".join(kept)
        assert {r.doc_id: r.kept for r in found} == want
    else:
        df = {k: sum(k in row for row in keys) for row in keys for k in row}
        want = sorted((str(i), "\n".join(x for x, k in zip((t or "").split("\n"), row) if not k or df[k] < 2)) for (i, t), row in zip(docs, keys))
        assert sorted((str(r.doc_id), r.kept) for r in found) == want
    for r in found:
        kept = [i for start, length in r.keep_runs for i in range(start, start + length)]
        assert len(kept) == r.n_lines - r.n_dropped and kept == sorted(set(kept)) and all(0 <= i < r.n_lines for i in kept)
        assert "\n".join((r.text or "").split("\n")[i] for i in kept) == r.kept
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_repeated_rows_and_hot_lines(spark, monkeypatch):
    """Ten equal rows are ten documents, as in the SQL; lines of a hot sample are dealt in parts, with the same result."""
    docs = [(1, "a\nown\na")] * 10 + [(2, "b\nb")] * 9 + [(i, f"hot \nline {i}\nHOT") for i in range(10, 60)] + [(None, "hot")]
    monkeypatch.setattr(line_dedup, "SAMPLED", 1.0)
    assert {r.h1 for r in line_dedup.hot_lines(frame(spark, docs)).collect()} and line_dedup.HOT_ROWS < 50
    monkeypatch.setattr(line_dedup, "SALTS", 4)
    few = {r.h1: r.parts for r in line_dedup.hot_lines(frame(spark, docs)).collect()}
    monkeypatch.setattr(line_dedup, "PART_ROWS", 1)  # parts follow the rows that the sample tells
    assert max(few.values()) == line_dedup.SALTS < max(r.parts for r in line_dedup.hot_lines(frame(spark, docs)).collect())
    con = duckdb.connect()
    table = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con.register("documents", table)
    want = sorted(map(str, con.sql(line_dedup.OP3_SQL).fetchall()))
    rows = line_dedup.dedup_lines(frame(spark, docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert sorted(str(tuple(r)) for r in rows.collect()) == want
    first = line_dedup.dedup_lines(frame(spark, docs), keep_first=True).collect()
    assert [r.kept for r in first if r.doc_id is None] == ["hot"] and all("hot" not in r.kept.lower() for r in first if r.doc_id is not None)


def test_line_dedup_plan(spark):
    """One exchange by ranges of hashes, one sort, and windows over it."""
    rows = line_dedup.streamed(line_dedup.line_places(frame(spark, [(1, "a")])).withColumn("part", F.xxhash64("h2")))
    plan = rows.where("documents > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(h1") == 1 and "hashpartitioning" not in plan and plan.count("Sort [") == 1 and plan.count("Window [") >= 2
    assert "Python" not in plan


def test_sharding(spark):
    docs = [(i, f"t{i % 9}") for i in range(3000)] + [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (None, None)] * 3 + [(None, f"n{i}") for i in range(40)]
    rows = sharding.shard_documents(frame(spark, docs), [1.0] * 5).collect()
    assert len(rows) == len(docs)

    def bid(k, s):
        return -math.log((int(hashlib.md5(f"{'' if k is None else k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    sizes = {(i, t): (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs}
    for r in rows:
        assert r.shard == min(range(5), key=lambda s: bid(r.doc_id, s)) and r.grown_shard == min(range(6), key=lambda s: bid(r.doc_id, s))
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(sizes[d] for d in docs)
    for s in range(5):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    small = sharding.assign_shards(frame(spark, docs).select("doc_id", "text"), "doc_id", [1.0] * 5, rows_per_group=20).collect()  # many groups in a shard
    assert sorted((r.shard, r.slot) for r in small) == sorted((r.shard, r.slot) for r in rows)
    heavy = sharding.shard_documents(frame(spark, docs[:3000]), [1.0, 3.0]).where("shard = 1").count()
    assert 0.7 < heavy / 3000 < 0.8
    assert sharding.shard_documents(frame(spark, []), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, docs), [])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if passes(k, m[0])]


def test_pii(spark):
    texts = [*ODD, "a@b.c.@x.y.z a@b.c_d@e.f", "😀 1.2.3.4.5.6.7.8 300.1.2.3.4 000255.1.1.1", "4485275742293310 4539 1488 0343 6467 4485  275742293310 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+1 (017) 555-7713. +12 ++1 2345678 +123456789012345678", "x" * 4000 + "@", "a@" + "b." * 6000, "1.1.1.1 " * 900, "+1" + " " * 500 + "x", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.c"), (2, "a@b.c"), (2, "a@b.c")]
    found = pii.digests(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in found) == sorted((str(i), sha(",".join(plain_spans(t or "")))) for i, t in docs)
    for r in found:
        if r.doc_id is not None and r.doc_id > 10:
            assert set(plain_spans(texts[r.doc_id])) <= set(r.spans.split(",")) or not plain_spans(texts[r.doc_id])
    assert pii.digests(frame(spark, [])).count() == 0


def test_what_the_classifier_adds(spark):
    """Planted secrets and near misses among look-alikes: precision and recall of the added spans."""
    r, rows, real = random.Random(9), [], set()
    digits = lambda n, of="0123456789abcdef": "".join(r.choice(of) for _ in range(n))
    for i in range(300):
        kind = i % 5
        if kind == 0:
            head, body = f"config: {r.choice(['api_key', 'secret', 'token', 'password'])} = ", digits(r.choice([32, 40, 64]))
            real.add((i, len(head), len(head) + len(body)))
        elif kind == 1:
            head, body = "see commit ", digits(r.choice([33, 35, 47, 51])) + "zz"
        elif kind == 2:
            head, body = "mail ", f"u{i}@host{i}.com"
        elif kind == 3:
            head, body = "from host ", f"10.{i % 200}.3.{i % 250}"
        else:
            head, body = "the sum is ", str(r.randrange(10**6))
        rows.append((i, f"{head}{body} and more words"))
    added = {(x.doc_id, s["start"], s["end"]) for x in pii.private_spans(frame(spark, rows)).collect() for s in x.spans if not s["base"]}
    assert len(added & real) / len(real) > 0.9 and len(added & real) / max(1, len(added)) > 0.9
    long = "token=" + digits(300) + " "
    found = pii.private_spans(frame(spark, [*rows, (999, long)])).where("doc_id = 999").first()
    assert all(s["end"] - s["start"] == 300 for s in found.spans)


def test_reliabilities_find_the_bad_labeler():
    counts = []
    for real, n in ((1, 900), (0, 600)):
        for a in (1, -1):
            for b in (1, -1):
                for c in (1, -1):
                    share = (0.9 if (a > 0) == real else 0.1) * (0.95 if (b > 0) == real else 0.05) * 0.5
                    counts.append({"kind": 0, "regex": a, "gazetteer": b, "context": c, "count": n * share})
    _, vote = pii.reliabilities(counts)
    assert vote["regex", 1, 1] == pytest.approx(0.9, abs=0.07) and vote["gazetteer", 0, 1] == pytest.approx(0.05, abs=0.07) and vote["context", 1, 1] == pytest.approx(0.5, abs=0.07)


def test_chat(spark):
    rows = [(1, 0, "system", "a\\b"), (1, 1, "user", "[INST]<s>\\l"), (1, 2, "assistant", "</s>\\a[/ROLE]"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "tool[TEXT]", "x[TEXT]y"), (None, None, None, None), (2, 0, "user", "😀"), (2, 0, "user", "😀"), (3, 0, "assistant", "é" * 3000)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string, n int")
    segments = chat.example_segments(df)
    got = [(r.conv_id, r.role, r.text) for r in chat.read_back(segments).collect()]
    assert sorted(got, key=str) == sorted(((c, r or "", t or "") for c, _, r, t in rows), key=str)
    for r in chat.whole_examples(segments).collect():
        target = r.text[r.loss_start : r.loss_end]
        assert r.text.endswith("<s>" + target + "</s>") and "[INST]" not in target
    assert chat.whole_examples(segments).count() == 3
    one = {r.conv_id: r for r in chat.digests(df).collect()}
    assert one[1].turns_sha256 == sha("".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)) and one[1].loss_sha256 == sha("</s>\\a[/ROLE]") and one[2].n_turns == 2
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_of_null_ids_and_of_many_turns(spark):
    """Rows of a null conv_id are told apart, and a long conversation's examples are cut from one text."""
    rows = [(None, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)] + [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat.digests(df).collect()
    lone = [r for r in found if r.conv_id is None]
    assert len(lone) == 3000 and {r.n_turns for r in lone} == {1} and sum(r.loss_chars for r in lone) == sum(len(r[3]) for r in rows[:3000] if r[2] == "assistant")
    [long] = [r for r in found if r.conv_id == 7]
    assert long.n_turns == 1200 and long.loss_sha256 == sha("".join(r[3] for r in rows[3000:] if r[2] == "assistant"))


def test_chat_examples(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "tool", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "user", "f")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    first = "[INST]a[/INST]<s>b</s>"
    second = first + "[ROLE]tool[TEXT]c[/ROLE]<s>d</s>"
    want = [(1, 1, first, "b"), (1, 3, second, "d"), (1, 4, second + "[INST]e[/INST]", None), (2, 0, "[INST]f[/INST]", None)]
    found = chat.examples(chat.example_segments(df)).collect()
    assert sorted((r.conv_id, r.n, r.text, r.loss_start and r.text[r.loss_start : r.loss_end]) for r in found) == want
    whole, own = chat.digests(df).collect(), chat.examples
    assert {r.conv_id: (r.n_turns, r.loss_chars, r.formatted_chars) for r in whole} == {1: (5, 2, len(second) + 14), 2: (1, 0, 14)}
    monkeypatch.setattr(chat, "examples", lambda s: own(s).where("n < 3"))  # the digests come from the examples
    assert {r.conv_id: r.n_turns for r in chat.digests(df).collect()} == {1: 2, 2: 1}
