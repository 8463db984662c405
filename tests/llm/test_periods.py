"""Decontamination, importance resampling and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from starloom.llm import decontaminate, periodic, resample, words
from starloom.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall((text or "").encode().lower())


# Decontamination


def plain_hits(docs, items, window=10):
    wins = []
    for i, t in items:
        w = folded(t)
        n = min(window, len(w))
        wins += [(i, w[s : s + n]) for s in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, found = folded(t), set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def soup(rng, low, high, letters=("a", "B", "é", "7", "an")):
    return "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(low, high)))


def contaminated_case(seed):
    rng = random.Random(seed)
    items = [(rng.choice([i, i, None]), soup(rng, 0, 16)) for i in range(14)]
    items += [(90, "b"), (91, "A an"), (92, "7 7 7"), (93, None), (94, ""), (95, "!"), (5, "zz yy xx ww vv uu tt ss rr qq pp"), (5, "k l m n o p q r s t u v"), (96, "nowhere to be found in any of these documents at all")]
    docs = [(d, soup(rng, 0, 60)) for d in range(40)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "x " + items[16][1] if items[16][1] else ""), (104, "Zz yy, xx ww vv uu tt ss rr qq zz"), (104, "zz yy xx ww vv uu tt ss rr qq"), (None, "k l m n o p q r s t u"), (3, docs[3][1]), (3, docs[3][1])]
    return docs, items


def answer(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontaminate(spark, seed):
    docs, items = contaminated_case(seed)
    got = decontaminate.digest(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS row", "2 AS shingle").repartition(5), spark.createDataFrame(items, ITEMS).selectExpr("*", "0 AS words"))
    assert answer(got) == sorted(plain_hits(docs, items), key=str)


def test_decontaminate_with_a_full_bitmap_and_pieces(spark, monkeypatch):
    """A bitmap that lets all shingles through, and texts cut into pieces of a few words."""
    docs, items = contaminated_case(3)
    monkeypatch.setattr(words.pieces, "__defaults__", (30,))
    texts = [t.encode() for _, t in docs if t]
    bits = np.full(1, 255, np.uint8)
    for k in (1, 2, 3):
        met = [(int(i[np.searchsorted(i[:, 2], a, side="right") - 1, 0]), int(a - i[np.searchsorted(i[:, 2], a, side="right") - 1, 2] + i[np.searchsorted(i[:, 2], a, side="right") - 1, 1])) for _, i, f in decontaminate.met(iter(texts), bits, [k], 10) for a in f[0][1]]
        assert sorted(met) == [(r, p) for r, t in enumerate(texts) for p in range(len(folded(t.decode())) - k + 1)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    few = decontaminate.occurrences(d, i, bits=3)[1]
    many = decontaminate.occurrences(d, i)[1]
    key = lambda t: sorted((r.row, r.start, r["size"], r.words) for r in t.collect())
    assert key(few) == key(many) and key(many)


def test_decontaminate_edges(spark):
    docs, items = contaminated_case(4)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert answer(decontaminate.digest(d.limit(0), i)) == []
    assert answer(decontaminate.digest(d, i.limit(0))) == sorted(plain_hits(docs, []), key=str)
    clean = decontaminate.decontaminate(d, i)
    assert clean.columns == d.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r, (*_, hit) in zip(d.collect(), plain_hits(docs, items), strict=True) if not hit)
    long = "w " * 300_000 + "zz yy xx ww vv uu tt ss rr qq " + "w " * 5
    assert [tuple(r)[1:4] for r in decontaminate.digest(spark.createDataFrame([(1, long)], DOCS), i).collect()] == [(300_015, 10, 1)]


def test_decontaminate_beside_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q = c.execute(ORACLE_SQL["op11_decontaminate"])
    names = [x[0] for x in q.description]
    df = QUERIES["op11_decontaminate"](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(q.fetchall())


# Resampling


def plain_features(text):
    w = folded(text)
    return len(w), [zlib.crc32(b" ".join(w[s : s + k])) % 10_000 for k in (1, 2, 3) for s in range(len(w) - k + 1)]


def plain_resample(docs, target):
    of_docs = [plain_features(t) for _, t in docs]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, f in of_docs:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text)[1], 1)
    big_s, big_t = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (d, _), (n, f) in zip(docs, of_docs, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[5] = k
    return sorted(((r[0], *r[2:]) for r in rows), key=str)


def resampled(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_resample(spark):
    rng = random.Random(7)
    vocabulary = ["the", "Of", "ñandú", "x" * 63, "y" * 64, "z" * 1000, "12", "中文字"]
    docs = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ";", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, docs[5][1]), (7, docs[7][1]), (7, docs[7][1]), (202, "w" * 300_000 + " the of " * 30)]
    target = [rng.choice(["the of", "12 ñandú the", "", None]) for _ in range(30)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'a' AS weight", "1 AS rank", "2 AS n_words").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampled(resample.digest(df, bench))
    assert got == plain_resample(docs, target) and sum(r[4] is not None for r in got) > 3
    drawn = resample.resample(df, bench)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in got if r[4] is not None}
    assert resampled(resample.digest(df, bench.limit(0))) == plain_resample(docs, [])
    assert resampled(resample.digest(df.limit(0), bench)) == []


def test_features_of_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "ccc" * 40]) for _ in range(rng.randint(0, 80))) for _ in range(30)]
    monkeypatch.setattr(words.pieces, "__defaults__", (20,))
    for size in (1, 50, 1 << 16):
        got = np.zeros((len(texts), 10_000), int)
        for w, piece, fresh, row in resample.blocks((t.encode() for t in texts), size):
            for bucket, last in resample.buckets(w, piece, fresh):
                np.add.at(got, (row[piece[last]], bucket), 1)
        for r, t in enumerate(texts):
            assert (got[r] == np.bincount(np.array(plain_features(t)[1], int), minlength=10_000)).all()


def test_resample_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert resampled(QUERIES["op12_resample"](spark, sf)) == plain_resample(docs, target)


# Runs


def plain_runs(w, least=2, ratio=2):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found[(i, j + q)] = min(q, found.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, ratio * q)), key=lambda r: (r[0], r[2]))


def words_of(rng, letters):
    w = [rng.randrange(letters) for _ in range(rng.randint(0, 50))]
    if rng.random() < 0.5:
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 8))]
        w = w + part * rng.randint(2, 9) + part[: rng.randint(0, 5)] + w[: rng.randint(0, 30)]
    return w


def test_all_runs_of_strings():
    rng = random.Random(2)
    for _ in range(600):
        w = words_of(rng, rng.choice([1, 2, 2, 3, 5]))
        start, end, period = periodic.runs(np.array(w, np.int64))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(w)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    start, end, period = periodic.runs(np.array(fib[-1], np.int64))
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(fib[-1])


def test_covering_squares_and_vocabulary():
    """Every different square with a primitive root has one node, and no node is anything else."""
    rng = random.Random(3)
    for _ in range(200):
        w = words_of(rng, 2)
        if len(w) < 2:
            continue
        ext = periodic.Extensions(np.array(w, np.int64))
        sa = np.argsort(ext.rank)
        assert [tuple(w[i:]) for i in sa] == sorted(tuple(w[i:]) for i in range(len(w)))
        low, high, k = periodic.vocabulary(*periodic.primitive(*periodic.covering(periodic.blocks(sa, ext), ext), ext), sa, ext)
        got = {(tuple(w[sa[a] : sa[a] + 2 * q]), b - a) for a, b, q in zip(low, high, k, strict=True)}
        squares = [tuple(w[i : i + 2 * q]) for i in range(len(w)) for q in range(1, (len(w) - i) // 2 + 1) if w[i : i + q] == w[i + q : i + 2 * q] and not any(q % r == 0 and w[i : i + q] == w[i : i + r] * (q // r) for r in range(1, q))]
        assert got == {(s, squares.count(s)) for s in squares} and len(got) == len(k)


def test_runs_of_texts():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[b"%d" % x for x in words_of(rng, rng.choice([1, 2, 3, 40]))] for _ in range(rng.randint(0, 6))]
        for least, ratio in ((6, 4), (2, 2), (9, 3)):
            assert periodic.found(texts, least, ratio) == [plain_runs(t, least, ratio) for t in texts]


def plain_digest(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = plain_runs(w, 6, 4)
    best = max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else None
    gone = {i for s, m, q in r for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in r)
    return (doc_id, len(r), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(map(str, words_of(rng, rng.choice([2, 3, 30]))))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (203, "a b\n" * 4), (204, "a a a a a"), (205, "a a a a a a x b b b b b b")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS runs", "2 AS start").repartition(3)
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in periodic.digest(df).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(*d) for d in docs), key=str)
    out = periodic.periodic_runs(df)
    assert out.columns == [*df.columns, "_runs", "collapsed"] and out.count() == len(docs)
    by = {r.doc_id: r for r in out.where("doc_id >= 200").collect()}
    assert [(r.start, r.length, r.period) for r in by[205]["_runs"]] == [(0, 6, 1), (7, 6, 1)] and by[205].collapsed == "a x b"
    assert by[200].collapsed is None and by[201].collapsed == "" and by[204].collapsed == "a a a a a"
    assert periodic.digest(df.limit(0)).count() == 0


def test_periodic_in_a_long_text(spark):
    rng = random.Random(6)
    w = [str(rng.randrange(5000)) for _ in range(60_000)]
    text = " ".join(w[:20_000] + w[100:4_100] * 6 + ["same"] * 50_000 + w[20_000:])
    r = periodic.digest(spark.createDataFrame([(11, text)], DOCS)).first()
    assert zlib.crc32(b"11") % 10 and (r.n_runs, r.start, r.length, r.period) == (2, 44_000, 50_000, 1)


def test_periodic_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in QUERIES["op13_periodic"](spark, sf).collect()]
    assert sorted(got) == sorted(plain_digest(*d) for d in docs) and sum(g[1] > 0 for g in got) > 10
