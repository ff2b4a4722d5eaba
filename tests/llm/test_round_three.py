"""Conversation repair, quality rules and hard negatives against plain Python and their SQL on odd and made-up rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lociflow.llm import negatives, quality_rules, repair

SPACE = r"[\x20\x09-\x0D]"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def brute_repairs(rows):
    """All (cost, audit) of at most one insertion in a row of (initial, fault) rows, by trying everything."""
    best = None
    for edits in itertools.product("DKu a".replace(" ", ""), repeat=len(rows)):
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            roles, cost, audit = "", 0, ""
            for i in range(len(rows) + 1):
                roles, cost, audit = roles + inserts[i], cost + 3 * len(inserts[i]), audit + "I" * len(inserts[i])
                if i == len(rows):
                    break
                initial, fault = rows[i]
                if edits[i] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if fault in ("blank", "duplicate"):
                    cost = None
                    break
                more = 3 if fault == "truncated" else 0
                roles += initial if edits[i] == "K" else edits[i]
                cost, audit = cost + more + (0 if edits[i] == "K" else 3), audit + ("K" if edits[i] == "K" else "R")
            if cost is not None and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_cheapest_repair_is_the_least_of_all():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax "), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(4))]
        assert min(repair.cheapest(rows).values()) == brute_repairs(rows), rows


def plain_repair(rows):
    """gaps, faults, illegal, cost, audit and digest of the damaged rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(f"{SPACE}+$", "", text)
        faults.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # by layers: the least (cost, audit, turns) of each state
    into = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    layer = {0: (0, "", ())}

    def filled(layer):
        heap, done = [(v, k) for k, v in layer.items()], {}
        heapq.heapify(heap)
        while heap:
            (c, a, t), k = heapq.heappop(heap)
            if k in done:
                continue
            done[k] = (c, a, t)
            for initial, role in (("u", "user"), ("a", "assistant")):
                if k in into[initial]:
                    heapq.heappush(heap, ((c + 3, a + "I", (*t, f"{role}:")), into[initial][k]))
        return done

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(k, v, new=new):
            new[k] = min(new.get(k, v), v)

        for k, (c, a, t) in filled(layer).items():
            offer(k, (c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if k in into.get(role[:1], {}):
                offer(into[role[:1]][k], (c + more, a + "K", (*t, f"{role}:{text}")))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if k in into[initial]:
                    offer(into[initial][k], (c + 3 + more, a + "R", (*t, f"{name}:{text}")))
        layer = new
    cost, audit, turns = min(v for k, v in filled(layer).items() if k in (0, 3))
    numbers = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[faults.count(f) for f in repair.FAULTS], illegal, cost, audit, sha("\n".join(turns)))


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, n int, block string, _c string"


def made_conversations(spark):
    rng = random.Random(5)
    said = ["Hi.", "Why?", "no end", " \t\n", "", None, "Yes!  \n", "long " * 5000 + ".", "é ü。", "x\n."]
    rows = [(c if c else None, rng.choice([None, *range(6)]) if c % 5 == 0 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(said)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 50}.") for t in range(300)] + rows[:5]
    return spark.createDataFrame([(*r, 1, "b", "c") for r in rows], CONVERSATIONS)


@pytest.mark.parametrize(("whole", "bits"), [(1024, 10), (3, 2), (0, 3)])
def test_conversation_repair(spark, whole, bits):
    """Conversations in one piece, and cut into blocks of a few rows: the same repairs."""
    hurt = repair.damaged(made_conversations(spark))
    by_conv = {}
    for r in hurt.collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {c: plain_repair(rows) for c, rows in by_conv.items()}
    got = {r[0]: tuple(r[1:]) for r in repair.repaired(hurt, whole, bits).collect()}
    assert got == want


def test_conversation_damage(spark):
    rows = made_conversations(spark)
    want = []
    for r in rows.collect():
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = " " if r.role is None else r.role, " " if r.text is None else r.text
        if kind:
            one = (r.conv_id, r.turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [one] * (2 if kind == 3 else 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, repair.damaged(rows).collect()), key=key) == sorted(want, key=key)


def test_conversation_repair_of_a_table(spark, tmp_path):
    """The query with its SQL on odd rows; an empty table gives an empty result."""
    rows = made_conversations(spark)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(repair.op11_conversation_repair(spark, str(tmp_path))) == by_sql(repair.OP11_SQL, conversations=rows)
    rows.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert repair.op11_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_a_long_conversation_of_null_ids_is_cut(spark):
    """Rows of a null conv_id are one conversation, but no task takes them in one piece."""
    rows = spark.range(6000).select(F.lit(None).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    [got] = repair.repaired(rows).collect()
    assert tuple(got[1:]) == plain_repair([tuple(r[1:]) for r in rows.collect()])


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), len(re.findall("[A-Z]", text))


def odd_texts():
    rng = random.Random(11)
    sentence = "one two three four five six seven eight nine ten eleven twelve"
    few = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 16, 40)]
    return [None, "", " \n\t\x0b\x0c\r ", "É É\né\né\n", f"{sentence} {sentence}", f"{sentence} x {sentence}\n{sentence}", "A#B ||| <x> 😀*" * 9, "w " * 300, "UP " * 40, *few, "\n".join(["line of words"] * 4 + ["  "]), "z" * 100_000, " ".join(f"w{i}" for i in range(19)), " ".join(f"w{i}" for i in range(20))]


def test_quality_ledger(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "a b", 1, "y"), (3, texts[3], 1, "z")], "doc_id bigint, text string, n_words int, m string")
    got = quality_rules.ledger(docs)
    want = [(i, *plain_measures(t)) for i, t in [*enumerate(texts), (None, "a b"), (3, texts[3])]]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.drop("failures").collect()), key=order) == sorted(want, key=order)
    assert rows_of(quality_rules.ledger(docs.limit(0))) == [] == quality_rules.ablations(quality_rules.ledger(docs.limit(0))).collect()


def test_a_very_long_text_is_measured_whole(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda i: F.concat(F.lit("w"), F.when(i > 399_990, i - 399_990).otherwise(i))))
    [row] = quality_rules.ledger(spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))).collect()
    assert (row.n_words, row.n_repeat_words) == (400_000, 20)


def test_policies_and_ablations(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = quality_rules.ledger(docs)
    bits = {r.doc_id: r.failures for r in rows.collect()}
    names = [name for name, _ in quality_rules.RULES]
    policies = (quality_rules.Policy("a", tuple(names[:3])), quality_rules.Policy("b", tuple(names[2:])))
    for r in quality_rules.applied(rows, policies).collect():
        fails = {n for i, n in enumerate(names) if bits[r.doc_id] >> i & 1}
        assert (r.kept_a, r.kept_b) == tuple(not fails & set(p.rules) for p in policies)
    for r in quality_rules.ablations(rows, policies).collect():
        mask = next(p for p in policies if p.version == r.version).mask()
        bit = 1 << names.index(r.rule)
        hit = [b & mask for b in bits.values() if b & bit]
        others = 0
        for b in hit:
            others |= b & ~bit
        assert (r.n_docs, r.n_rejected, r.n_failed, r.n_alone, r.others) == (len(texts), sum(b & mask > 0 for b in bits.values()), len(hit), sum(b == bit for b in hit), others)
    with pytest.raises(ValueError, match="no such rule"):
        quality_rules.Policy("c", ("nothing",)).mask()


def test_quality_rules_keep_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_rules.op12_quality_rules(spark, folder).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in rows.collect()}
    assert kept[1] == 1.0
    assert kept[0] < 0.15


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, list int, block int, score bigint, anchor bigint"


def made_embeddings(spark, seed=2, n=700, d=5, scale=1.0):
    rng = random.Random(seed)
    vec = lambda: [scale * rng.gauss(0, 0.5) for _ in range(d)]
    rows = [(i, vec(), rng.choice([0, 1, 1, 1, 2, 40, -3])) for i in range(n)]
    hot = vec()
    rows += [(1000 + i, hot, rng.randrange(3)) for i in range(250)]  # one vector very often
    rows += [(None, vec(), 1), (2000, None, 1), (2100, [1.0, None, 0.0, 0.0, 0.0], 1), (2200, [float("nan")] * d, 1), (2300, [float("inf")] * d, 1), (2400, vec(), None), (2500, [0.5, 0.25], 1), (2600, [], 2), (2700, [0.0] * d, 2)]
    rows += [*rows[100:103], *rows[300:303]]  # repeated rows
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], EMBEDDINGS)


def plain_negatives(rows, low=30, high=90):
    import math

    own = set()
    for r in rows:
        if r.vec_id is None or r.label is None or r.embedding is None or any(x is None or not math.isfinite(x) for x in r.embedding):
            continue
        own.add((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(math.floor(256 * x) for x in r.embedding)))
    out = []
    for a, label, q in own:
        if a % 100:
            continue
        score = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, k) for i, k, v in own if i != a)
        for p, i, _ in [s for s in score if s[2] == label][:5]:
            good = [(j, -s) for s, j, k in score if k != label and low * -p <= 100 * -s <= high * -p][:10]
            out += [(a, i, r + 1, j, -p, s) for r, (j, s) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize(("sample", "first"), [(20_000, 4096), (50, 20)])
def test_hard_negatives(spark, sample, first):
    """In one round, and with few centroids and a few rows in the first of many rounds: the same rows."""
    rows = made_embeddings(spark)
    want = plain_negatives(rows.collect())
    got = negatives.hard_negatives(rows, sample=sample, first=first)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100


def test_hard_negatives_sql_and_empty(spark, tmp_path):
    rows = made_embeddings(spark, seed=4, n=300)
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(negatives.op13_hard_negatives(spark, str(tmp_path))) == by_sql(negatives.OP13_SQL, embeddings=rows)
    assert negatives.hard_negatives(rows.limit(0)).collect() == []


def test_hard_negatives_of_large_numbers_are_exact(spark):
    """Products that doubles can't hold."""
    rows = made_embeddings(spark, seed=9, n=60, scale=3e5)
    assert sorted(map(tuple, negatives.hard_negatives(rows).collect())) == plain_negatives(rows.collect())


def test_few_lists_are_read_where_clusters_lie_apart(spark):
    """Anchors take a part of the lists alone where the bounds allow it."""
    rng = random.Random(1)
    rows = [(i, [1.0 * ((i % 20) == k) + rng.gauss(0, 0.01) for k in range(20)], (i % 20) // 2) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    own = negatives.as_bytes(negatives.prepared(frame), 20)
    index = negatives.build(own, 20, 300.0**2)
    queries = own.where("vec_id % 100 = 1").select(F.col("vec_id").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q", F.lit(0).cast("bigint").alias("passed"), F.array(F.lit(30_000), F.lit(negatives.MOST), F.lit(negatives.LEAST)).alias("windows"))
    asked = negatives.asks(queries, index, True, 1, 1 << 40).where("list is not null")
    seen = sum(index.rows[r["list"]] for r in asked.select("list").distinct().collect())
    assert 0 < seen < 800
