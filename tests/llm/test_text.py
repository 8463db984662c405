"""Tokenizing, personal data, chat, quality, language and mixing."""

import collections
import hashlib
import heapq
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import bpe, chat, langid, mixing, pii, quality
from starloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(tokenizer_path())


def odd_texts():
    rng = random.Random(1)
    letters = "aaabbcdeéÉßΣςİ'’ \t\n \x1c\x85́ <|>19٣ñ中文🙂!!%%.#$st"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    parts = ["it", "'s", "'S", "'ll", "the", "ing", "tion", "an", "'", "re"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    return [*out, "a" * 5000, "<|endoftext|>a<|startoftext|> <|END|>", "ab" * 3000, "".join(rng.choice("etaoinshr") for _ in range(20000))]


def test_ids_and_decoding_are_the_library_s(codec, library):
    for text, want in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids.tolist() == want.ids
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_operators(spark, library):
    texts = [None, "", "Hello  World", "x" * 300, "Hello  World"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path(), ids="_ids").orderBy("doc_id").collect()
    want = [library.encode(t or "", add_special_tokens=False) for t in texts]
    assert [r["_ids"] for r in out] == [w.ids for w in want]
    assert [r["decoded"] for r in out] == [library.decode(w.ids, skip_special_tokens=False) for w in want]
    d = bpe.digests(df, tokenizer_path()).orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in d] == [hashlib.sha256(" ".join(map(str, w.ids)).encode()).hexdigest() for w in want]
    assert [r.n_tokens for r in d] == [len(w.ids) for w in want]
    assert bpe.digests(df.limit(0), tokenizer_path()).count() == 0


def plain_pii(text):
    out = []
    for kind, p in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE), strict=True):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) < 256, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii_texts():
    rng = random.Random(5)
    parts = ["a", "b", "_", "-", ".", "@", "@", "1", "2", "255", "256", "0001", " ", "+", "(", ")", "é", "🙂", "\n", "4111111111111111", "+1 (555) 555-1234", "10.0.0.1", "x@y.zz", "4111 1111 1111 1111 "]
    return [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]]


def test_personal_data(spark):
    texts = pii_texts()
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = plain_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert {joined([s]) for s in base} <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_long_texts_take_no_quadratic_time(spark):
    texts = ["a" * 200_000, "a." * 50_000 + "@b.c", "1" * 100_000, "1 " * 20_000, "1." * 50_000, "+1" + "(" * 100_000]
    assert pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)


def test_many_matches_in_a_text(spark):
    n = 30_000
    text = " ".join(f"a{i}@mail.com" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[1].n_email == n and got[1].base_sha256 == hashlib.sha256(joined(plain_pii(text)).encode()).hexdigest()
    assert {r.doc_id: r.text for r in pii.mask(df).collect()} == {1: " ".join(["<EMAIL>"] * n), 2: "x"}
    assert time.perf_counter() - began < 60  # twice 10 s and more a pass where a match costs time for each match before it


@pytest.mark.parametrize("scan", [2, 128])
def test_running_values_and_free_spans(spark, monkeypatch, scan):
    monkeypatch.setattr(pii, "SCAN", scan)
    rng = random.Random(3)
    rows, kind = [], "array<struct<kind:int,start:long,end:long>>"
    for _ in range(150):
        of = lambda n, w: [(rng.randrange(4), a, a + rng.randint(1, w)) for a in (rng.randrange(60) for _ in range(rng.randint(0, n)))]
        rows.append((of(5, 6), of(6, 9), [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]))
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, n array<long>")
    out = df.select("a", "b", "n", pii.running(F.col("n"), lambda x, y: x + y, 0).alias("sums"), pii.clear_of(F.col("a"), F.col("b")).alias("free"), pii.blocks(F.col("n"), 4).alias("blocks")).collect()
    for r in out:
        assert r.sums == [sum(r.n[: i + 1]) for i in range(len(r.n))]
        assert [x for b in r.blocks for x in b] == r.n and all(len(b) == 4 for b in r.blocks[:-1])
        want = [tuple(s) for s in r.a if not any(o.start < s.end and s.start < o.end for o in r.b)]
        assert sorted(map(tuple, r.free)) == sorted(want)


def test_pieces_between_cuts(spark, monkeypatch):
    monkeypatch.setattr(pii, "CUTS", (6, 2))
    rng, texts = random.Random(6), []
    for n in range(40):
        texts.append("é🙂 ".join(f"ann{i}@mail.example.com" if rng.random() < 0.7 else "word" for i in range(n)))
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: re.sub(r"ann\d+@mail\.example\.com", "<EMAIL>", t) for i, t in enumerate(texts)}


def test_masking(spark):
    rows = [(1, "write to ann@mail.example.com or 10.0.0.1 now 🙂", "k", "x", 1), (2, "nothing 1.2 here", None, None, None), (3, None, "", "", 2), (4, "ann@mail.example.com", "m", "m", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, masked string, kept_spans string, pii int")
    out = {r.doc_id: r for r in pii.mask(df).collect()}
    assert pii.mask(df).columns == df.columns
    assert out[1].text == "write to <EMAIL> or <IP> now 🙂" and out[1].kept_spans == "x" and out[1].pii == 1
    assert (out[2].text, out[3].text, out[4].text) == ("nothing 1.2 here", None, "<EMAIL>")
    assert pii.mask(df.limit(0)).count() == 0


def test_added_spans(spark):
    rows = [(i, f"et la {n} suite") for i, n in enumerate(["+1 (826) 555-4081 190.137.223.204"] + ["+1 (343) 555-7672"] * 30 + ["7536784127813050 4845168114407329"] + ["4111111111111111"] * 30)]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "ip:24:39,phone:6:23"
    assert "card:23:39" in got[31]


def test_em_tells_good_labelers_from_bad():
    counts = [(0, (1, 1, 1, 0, 1), 1, 500), (0, (-1, -1, -1, 0, -1), 1, 500), (0, (1, 1, -1, 0, 1), 1, 20)]
    a, b, c = pii.estimate(counts)
    assert a > 0.95 and b < 0.05 and c > 0.5


def cheapest(roles):
    heap, seen = [(0, 0, 0)], set()
    while True:
        cost, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s == 3:
            return cost
        label = lambda q: 0 if roles[i] == q else 1 if roles[i] == 3 else 2  # noqa: E731, B023
        for q, t in ({0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}[s]).items():
            heapq.heappush(heap, (cost + 3, i, t))
            if i < len(roles):
                heapq.heappush(heap, (cost + label(q), i + 1, t))
        if i < len(roles) and s:
            heapq.heappush(heap, (cost + 1 + label(s - 1), i + 1, s))


def test_chunks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """However many rows share a conversation, a turn number, or everything."""
    rows = [(None, None, "user", "x")] * 300 + [(None, 1, "assistant", f"y{i}") for i in range(200)] + [(7, i, "user" if i % 2 else "assistant", None) for i in range(100)]
    sizes = []
    real = chat.written
    monkeypatch.setattr(chat, "written", lambda df: (t := real(df), sizes.append(t.groupBy("chunk").count().agg(F.max("count")).first()[0]))[0])
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5), 16).collect()
    assert len(out) == 600 and max(sizes) == 16
    for conv in (None, 7):
        n = collections.Counter(r.merged for r in out if r.conv_id == conv)
        assert sum(n.values()) == (500 if conv is None else 100)
    roles = [2] * 200 + [1] * 300
    assert sum(r.cost for r in out if r.conv_id is None) == cheapest(roles)
    assert sum(r.cost for r in out if r.conv_id == 7) == cheapest([1 if i % 2 else 2 for i in range(100)])


def test_equally_cheap_repairs():
    """Of equal costs: keep, relabel, merge, insert; and a rerun takes the same."""
    for roles in ([1, 1, 2], [2, 2], [0, 2], [1, 2, 2, 1, 1, 2], [3, 3, 3]):
        a, b = (chat.repaired(roles, *chat.borders([chat.matrix(roles)])[0]) for _ in range(2))
        assert a == b
        ways = [s for s in chat.STEPS[chat.START][roles[0]]]
        assert [s[0] for s in ways] == sorted(s[0] for s in ways)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_chat_repair(spark, chunk):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(150):
        roles = [rng.choice(["system", "user", "assistant", "tool", None, "User "]) for _ in range(rng.randint(1, 12))]
        rows += [(c, t, r, f"t{t}" if rng.random() < 0.9 else None) for t, r in enumerate(roles)]
        want[c] = cheapest([chat.role_of(r) for r in roles])
    got = sorted(chat.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chunk).collect(), key=lambda r: (r.conv_id, r.turn))
    cost, text = collections.Counter(), collections.defaultdict(str)
    for r in got:
        cost[r.conv_id] += r.cost
        text[r.conv_id] += r.rendered
    assert len(got) == len(rows) and all(cost[c] == want[c] for c in want)
    for t in text.values():
        assert re.fullmatch("s?(ua)+e", "".join(x[0] for x in re.findall(r"<\|(\w+)\|>", t)))


def test_chat_odd_rows(spark):
    kind = "conv_id long, turn int, role string, text string, chunk string, h string, `row` int, before int, costs string"
    assert chat.repair(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, None, None, None, "c", "", 1, 1, ""), (None, 1, "user", "x" * 1_000_000, "c", "", 1, 1, ""), (1, 1, "user", "a", None, "", 1, 1, None), (1, 1, "user", "a", None, "", 1, 1, None)]
    out = chat.repair(spark.createDataFrame(rows, kind)).collect()
    assert len(out) == 4 and max(len(r.rendered) for r in out) > 1_000_000


def plain_counts(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    g = [0] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            g[i : i + 8] = [1] * 8
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, sum(g)


def test_quality_counts():
    rng = random.Random(2)
    parts = ["a ", "b ", "c d\n", "é#", "\t", "\x0b", "\x1c", "\n", "x y z "]
    for t in [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(800)]]:
        assert quality.statistics(t)[:5] == plain_counts(t)


def test_quality_rules_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    out = quality.digest(docs, even).where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in out) >= 0.95 * len(out)
    good = [r for r in out if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_quality_odd_tables(spark):
    kind = "doc_id long, text string, kept string, n_words string"
    docs = spark.createDataFrame([(1, "a " * 30, "k", "n"), (2, None, None, None), (None, " ".join(map(str, range(30))), "", "")], kind)
    labels = spark.createDataFrame([(1, None), (None, 0), (9, 1)], "doc_id long, quality int")
    out = quality.assess(docs, labels).orderBy("doc_id").collect()
    assert [(r.doc_id, r["_n_words"], r.base_failed, r["_kept"]) for r in out] == [(None, 30, False, True), (1, 30, True, False), (2, 0, True, False)]
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_fitting_is_bounded_where_documents_share_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, f"w{i} " * (i % 40 + 1)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad: (seen.append(len(bad)), [])[1])
    assert quality.fit(docs, labels, most=50) == [] and seen == [50]


def test_very_long_texts():
    t = "one two three, " * 200_000
    assert quality.statistics(t)[:1] == (600_000,)
    assert langid.Profiles([("a", [ord("e")]), ("b", [ord("x")])], 400).predict(t)[0] == "a"


def test_languages_equally_near(spark):
    """Ties go to the first by code point, repeated rows alike."""
    p = langid.Profiles([("de", [ord("a")]), ("en", [ord("a")])], 400)
    assert p.predict("aaa")[0] == "de"
    df = spark.createDataFrame([(i, "der und die", "de") for i in (1, 1, 3, 4)] + [(i, "the of and", "en") for i in (5, 6, 6, 9)], "doc_id long, text string, lang string")
    by = collections.defaultdict(set)
    for r in langid.digest(df).collect():
        by[r.doc_id].add(tuple(r))
    assert len(by) == 6 and all(len(v) == 1 for v in by.values())


def test_learned_rules_are_precise():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    rules = quality.learn(x, bad)
    caught = np.zeros(3000, bool)
    for r in rules:
        caught |= quality.covers(r, x, 3000)
    assert (caught & ~bad).mean() < 0.01 and (caught & bad).sum() > 0.9 * bad.sum()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def plain_language(text, profiles):
    words = re.findall(r"[^\W\d_]+", text.lower())
    c = collections.Counter()
    for w in words:
        p = f" {w} "
        c.update(w)
        for n in (2, 3):
            c.update(p[i : i + n] for i in range(len(p) - n + 1))
    code = lambda g: int("".join(f"{ord(ch):021b}" for ch in g), 2)
    own = sorted(c, key=lambda g: (-c[g], code(g)))[: langid.OWN]
    off = {k: sum(min(abs(i - gs.index(code(g))), langid.PROFILE) if code(g) in gs else langid.PROFILE for i, g in enumerate(own)) for k, gs in profiles}
    best = min(sorted(off), key=off.get)
    return best, 1 - off[best] / (langid.PROFILE * len(own))


def test_language_is_the_least_out_of_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn(docs)
    p = langid.Profiles(profiles, langid.PROFILE)
    for r in docs.limit(40).collect():
        got, want = p.predict(r.text), plain_language(r.text, profiles)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_language_odd_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 _", "en", "x"), (4, "the and of", "en", "x"), (5, "der und die", "de", "x"), (6, "the", None, None), (None, "of the", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.digest(df).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[6][0] == "en"
    kept = langid.known(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "None"]
    assert langid.digest(df.limit(0)).count() == 0


def plain_targets(sizes, weights, most):
    out = [0.0] * len(sizes)
    total, free = float(sum(sizes)), {i for i, n in enumerate(sizes) if n}
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if total * weights[i] / w > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = total * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        total -= sum(out[i] for i in over)
        free -= over
    return out


def test_targets():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        sizes, weights = [rng.choice([0, 1, 10, 1000]) for _ in range(n)], [i % 3 + 1 for i in range(n)]
        got = mixing.targets(sizes, weights, 3)
        assert got == pytest.approx(plain_targets(sizes, weights, 3))
        assert sum(got) == pytest.approx(sum(sizes))


@pytest.mark.parametrize("block", [4096, 64])
def test_mixing(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.allot(docs, block=block).collect()
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == words
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert [by[s][0].target for s in sorted(by)] == pytest.approx(plain_targets([sum(r.size for r in by[s]) for s in sorted(by)], [i % 3 + 1 for i in range(len(by))], 3))
    for rs in by.values():
        taken = sum(r.size * r.copies for r in rs)
        assert abs(taken - rs[0].target) < 0.02 * rs[0].target + 5
        assert all(0 <= r.copies <= 3 for r in rs)
    again = mixing.allot(docs.repartition(5), block=block).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in rows}


def test_flight_keeps_balance():
    rng = np.random.default_rng(4)
    words, count = rng.integers(1, 500, 400).astype(float), np.ones(400)
    p = np.full(400, 0.37)
    out = mixing.flight(p, words, count, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out @ words == pytest.approx(p @ words) and out.sum() == pytest.approx(p.sum())


def test_a_dominant_document_is_balanced():
    rng = np.random.default_rng(8)
    for seed in range(40):
        words = np.sort(np.r_[20_000, rng.integers(20, 600, 300)])[::-1].astype(float)
        for p in (0.2, 0.5, 0.85):
            out = mixing.settled(np.full(301, p), words, np.ones(301), True, np.random.default_rng(seed))
            assert set(out) <= {0.0, 1.0}
            assert abs(out @ words - p * words.sum()) < 60
    taken = [mixing.long_first(np.full(301, 0.5), words, np.random.default_rng(s))[0] for s in range(400)]
    assert 0.4 < np.mean(taken) < 0.6


def test_a_document_too_long_for_its_target():
    words = np.r_[5000.0, np.full(40, 100.0)]
    out = mixing.settled(np.full(41, 0.1), words, np.ones(41), True, np.random.default_rng(1))
    assert out[0] == 0 and abs(out @ words - 900) <= 50


def test_mixing_comes_near_every_target(spark):
    rows = mixing.allot(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(rows) > 10 and all(abs(r.taken - r.target) <= 0.005 * r.target for r in rows)


def test_null_ids_are_dealt_into_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(None, f"w{i} " * (i % 30 + 1), None) for i in range(1500)] + [(5, "a b", "s")] * 3, "doc_id long, text string, source string")
    seen = []
    one_round = mixing.one_round
    monkeypatch.setattr(mixing, "one_round", lambda units, last, seed: (seen.append(units.groupBy("sid", "block").count().agg(F.max("count")).first()[0]), one_round(units, last, seed))[1])
    rows = mixing.allot(docs, block=100).collect()
    assert len(rows) == 1503 and seen[0] < 200
    by = [r for r in rows if r.source is None]
    assert abs(sum(r.size * r.copies for r in by) - by[0].target) < 20


def test_mixing_odd_rows(spark):
    rows = [(1, "a b", "s", "x"), (1, "a b", "s", "x"), (2, None, None, "x"), (3, "", "t", None), (None, "c d e", None, "y"), (4, "a b c d", "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = mixing.digest(df).collect()
    assert len(out) == 6 and all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in out)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and set(r.copies for r in mixed.collect()) <= {"x", "y", None}
    assert mixing.digest(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [200, 301, 1000])
def test_mixing_a_source_of_one_repeated_row(spark, copies):
    """A row that most of its source repeats is taken by its share, not as a whole; documents of one length tie."""
    rows = [(1, "a " * 50, "x")] * copies + [(10 + i, f"w{i} " * 20, "x") for i in range(100)] + [(500 + i, "b " * 30, "y") for i in range(80)] + [(900, "c " * 40, None)] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("note", F.monotonically_increasing_id()).repartition(5)
    out = mixing.allot(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= 50 and r.most <= 3, r
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert words == {r.source: r.taken for r in out}
    assert mixed.where("doc_id = 1").groupBy("note").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
