"""Repeated strings, repeated word windows and near duplicates against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import anchors, neardup, repeats, substring, suffix

DOCS = "doc_id long, text string"


def sentences(seed, letters, low, high, n=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def documents(seed, parts, most=12, n=120):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, most)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, parts[0] * 40), (n + 3, rows[0][1])]


def plain_bytes(rows, window):
    count = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = {}
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = 1
        spans = int((np.diff(np.r_[0, gone]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix(spark, hot):
    rows = documents(4, sentences(4, "abé", 5, 90))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(spark.createDataFrame(rows, DOCS), 40, 8, hot).collect()}
    assert got == plain_bytes(rows, 40)


def test_suffix_of_passages_of_over_fifty_words(spark):
    """Passages planted in two documents each: those of 400 bytes and more are removed whole, shorter ones and documents without one are left alone."""
    rng = random.Random(11)

    def words(n):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))) for _ in range(n)]

    rows, size = [], {}
    for n, least in enumerate([330, 380, 399, 400, 401, 450, 700, 2000] * 4):
        passage = words(51)
        while len(" ".join(passage)) < least:
            passage += words(1)
        passage = " ".join(passage)[:least]
        assert len(passage) == least and len(passage.split()) > 50
        for where in (0, 1):  # at the beginning of one text and at the end of the other, with signs of their own beside it
            text = passage + "[" + " ".join(words(200)) if where else " ".join(words(200)) + "]" + passage
            size[2 * n + where] = (least, text.replace(passage, "") if least >= 400 else text)
            rows.append((2 * n + where, text))
    rows += [(1000 + n, " ".join(words(rng.randint(1, 400)))) for n in range(60)]
    size |= {i: (0, t) for i, t in rows if i >= 1000}
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix.digest(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert got == {i: (least if least >= 400 else 0, hashlib.sha256(kept.encode()).hexdigest()) for i, (least, kept) in size.items()}


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix_of_frequent_strings(spark, monkeypatch, hot):
    """Strings of many rows are looked up in a broadcast table, with the same results, and no task gets all rows of one."""
    monkeypatch.setattr(suffix, "MANY", 3)
    test_suffix(spark, hot)
    rows = spark.range(4000, numPartitions=8).selectExpr("if(id % 2 = 0, -1, id) AS h", "1L AS k", "id", "unhex('00') AS tag", "id AS place")
    kept = suffix.again(rows, rows.groupBy("h", "k").agg(F.count("*").alias("n")))
    size = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(size) == 2000 and max(size) < 500


def test_suffix_at_full_size(spark):
    """The contract's 400 bytes on whole documents, some of them very long, against a count of all windows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(docs).collect()}
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(hash(b[s : s + 400]) for _, b in texts for s in range(len(b) - 399))
    wrong = 0
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 399):
            if count[hash(b[s : s + 400])] > 1:
                gone[s : s + 400] = 1
        spans = int((np.diff(np.r_[0, gone]) == 1).sum())
        wrong += got[i] != (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()).hexdigest())
    assert len(got) == len(rows) and wrong == 0 and max(len(b) for _, b in texts) > 20_000


def test_columns_find_windows_of_other_pieces():
    rng = random.Random(8)
    for _ in range(60):
        window, m = rng.randint(3, 8), rng.randint(1, 7)
        core = "".join(rng.choice("ab") for _ in range(2))
        pieces, at = [], []
        for _ in range(m):
            left = "".join(rng.choice("ab") for _ in range(rng.randint(0, window - 2)))
            right = "".join(rng.choice("ab") for _ in range(rng.randint(0, window)))
            while len(left + core + right) < window:
                right += "a"
            pieces.append((left + core + right).encode())
            at.append(len(left))
        group = np.array([rng.randrange(2) for _ in range(m)])
        flags = suffix.columns(pieces, group, np.array(at), window)
        for i, p in enumerate(pieces):
            for s in range(len(p) - window + 1):
                same = any(j != i and group[j] == group[i] and 0 <= s - at[i] + at[j] <= len(q) - window and q[s - at[i] + at[j] :][:window] == p[s : s + window] for j, q in enumerate(pieces))
                assert flags[i, s] == same


def plain_words(rows, window):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring(spark):
    rows = documents(5, [s + " " for s in sentences(5, "abcd ", 5, 120)])
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df).collect()}
    want = plain_words(rows, 20)
    assert got == want
    assert any(v[1] for v in want.values())
    kept = {r.doc_id: hashlib.sha256(r.kept.encode()).hexdigest() for r in substring.deduplicate(df).collect()}
    assert kept == {i: v[2] for i, v in want.items()}


def test_segments_cover_all_windows_alike(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 64)
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 2**63, 4, dtype=np.uint64)
    for _ in range(40):
        window = int(rng.integers(3, 12))
        gram = int(rng.integers(1, window + 1))
        docs = [rng.integers(0, 2, int(rng.integers(0, 200))) for _ in range(4)]
        anchor = {}
        seen = set()
        for d, first, n, h, _, _, place in anchors.segments(((i, numbers[x]) for i, x in enumerate(docs)), window, gram):
            for a, b, c, hh, p in zip(d.tolist(), first.tolist(), n.tolist(), h.tolist(), place.tolist(), strict=True):
                for s in range(b, b + c):
                    seen.add((a, s))
                    key = tuple(docs[a][s : s + window])
                    assert anchor.setdefault(key, (hh, p - s)) == (hh, p - s)
        assert seen == {(i, s) for i, x in enumerate(docs) for s in range(len(x) - window + 1)}


def test_sketch_never_loses_what_repeats(spark):
    rows = documents(6, [s + " " for s in sentences(6, "abc ", 30, 90)], n=60)
    df = spark.createDataFrame(rows, DOCS)
    kept = {(r.id, r.place) for r in repeats.suspected(df, substring.word_items, 20, 6, 6.0).collect()}
    count = collections.Counter()
    every = []
    for i, t in rows:
        if t:
            for _, first, n, h, _, _, _ in anchors.segments(iter([(i, substring.word_items(t.encode()))]), 20, 6):
                for f, m, x in zip(first.tolist(), n.tolist(), h.tolist(), strict=True):
                    count[x] += 1
                    every.append((i, f, m, x))
    places = {(i, p & ((1 << 45) - 1)) for i, p in kept}
    assert all((i, f << 9 | (m - 1)) in places for i, f, m, x in every if count[x] > 1)


def plain_join(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links, up = collections.Counter(), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (top(i), links[i]) for i in sets}


def copies(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(30, 200))] for _ in range(10)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return [*rows, (150, None), (151, ""), (152, "a b"), (153, "a  b"), (154, "a"), (155, rows[0][1])]


@pytest.mark.parametrize("blocks", [{}, {"tree_block": 16, "block": 16}])
def test_near_duplicates(spark, blocks):
    rows = copies(7)
    report = {}
    got = {r.id: (r.group, r.n_links) for r in neardup.join(spark.createDataFrame(rows, DOCS), report=report, **blocks).collect()}
    assert got == plain_join(rows)
    assert report["recall"] >= neardup.TARGET


def test_prefix_is_shortened_until_the_recall_is_met():
    k = neardup.prefix_length(0.8)
    assert 1 - (1 - 0.8**k) ** neardup.TREES >= neardup.TARGET > 1 - (1 - 0.8 ** (k + 1)) ** neardup.TREES
    assert neardup.prefix_length(0.99) == neardup.DEPTH


def test_prefixes_are_shortened_by_what_met():
    size = neardup.TREES * neardup.DEPTH
    close, far = {size - 2: 1000}, {size - 2: 1000, int(0.8 * size): 5000}
    assert neardup.recall(close, neardup.DEPTH) > neardup.TARGET > neardup.recall(far, neardup.DEPTH)
    assert neardup.recall(far, neardup.DEPTH) < neardup.recall(far, neardup.DEPTH - 1) < neardup.recall(far, neardup.DEPTH - 2)
    assert neardup.recall({}, 1) == 1.0 and neardup.recall({size // 2: 9}, neardup.DEPTH) == 1.0
    # Sightings of many simulated pairs give back how many there are, and how many of them met nowhere.
    rng = np.random.default_rng(2)
    agree = rng.random((20_000, neardup.TREES, neardup.DEPTH)) < 0.82
    tries = agree.all(axis=2)
    seen = collections.Counter()
    for n, t in zip(agree.sum(axis=(1, 2)).tolist(), tries.sum(axis=1).tolist(), strict=True):
        seen[n] += t
    assert 1 - neardup.recall(seen, neardup.DEPTH) == pytest.approx((~tries.any(axis=1)).mean(), abs=0.002)


@pytest.mark.parametrize("target, prefix", [(0.5, 6), (0.99999, 3)])
def test_forest_goes_as_far_as_the_target_asks(spark, target, prefix):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(9999)}" for _ in range(120)] for _ in range(30)]
    rows = []
    for i in range(300):
        w = list(base[i % 30])
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    report = {}
    got = {r.id: (r.group, r.n_links) for r in neardup.join(spark.createDataFrame(rows, DOCS), target=target, report=report).collect()}
    want = plain_join(rows)
    assert report["prefix"] >= prefix and report["recall"] >= target
    assert sum(got[i] == want[i] for i in want) >= target * 0.99 * len(want)


def test_nodes_are_runs_of_sorted_labels():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for depth in (3, 6):
        sig = rng.integers(0, 2, (60, 4, depth), dtype=np.uint32)
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(60)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "signature"])
        t = pa.Table.from_batches(neardup.label_rows(4, depth)(iter([batch]))).sort_by([(c, "ascending") for c in ("tree", *neardup.label_names(depth), "node")])
        parts = [t.slice(0, 70).to_batches(max_chunksize=9), t.slice(70).to_batches(max_chunksize=50)]
        members = collections.defaultdict(set)
        for part in parts:
            for b in neardup.node_rows(2, depth)(iter(part)):
                for x, k, n in zip(*(b.column(c).to_pylist() for c in ("depth", "key", "node")), strict=True):
                    members[x, k].add(n)
        got = sorted((x, sorted(m)) for (x, _), m in members.items() if len(m) > 1)
        runs = collections.defaultdict(list)
        for n in range(60):
            for tree in range(4):
                for x in range(2, depth + 1):
                    runs[tree, x, tuple(sig[n, tree, :x].tolist())].append(n)
        assert got == sorted((x, m) for (_, x, _), m in runs.items() if len(m) > 1)


def test_joined_places():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 40, (2, 30))
        up = list(range(40))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        assert neardup.joined(40, a, b).tolist() == [top(x) for x in range(40)]


def test_one_of_each_group_stays(spark):
    rows = [(i, t, "x") for i, t in copies(9)] + [(3, copies(9)[3][1], "x"), (None, "q w e r t y u", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    want = {g for g, _ in plain_join(copies(9)).values()}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert sorted((r.text or "") for r in kept.collect() if r.doc_id is None) == ["", "q w e r t y u"]


@pytest.mark.parametrize("digest", [suffix.digest, substring.digest, neardup.digest])
def test_empty_clashing_and_null_ids(spark, digest):
    assert digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c " * 100, 1, 1, "x"), (1, "a b c " * 100, 2, 2, None), (1, "other", 3, 3, ""), (1, "other", 3, 3, ""), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, h long, tag string")
    assert sorted(str(r.doc_id) for r in digest(df).collect()) == ["1", "1", "1", "None", "None"]


def alike_in_18_bits(words):
    """Two texts without a common passage whose 64-bit hashes end alike."""
    import xxhash

    rng, seen = random.Random(12), {}
    while True:
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(words))
        key = xxhash.xxh64_intdigest(text.encode(), 42) % (1 << 18)
        if key in seen:
            return seen[key], text
        seen[key] = text


def test_texts_of_one_id_stay_apart(spark):
    one, two = alike_in_18_bits(60)
    rows = [(None, one), (None, two), (1, two[210:])]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r.text for r in neardup.deduplicate(df).collect()) == sorted(t for _, t in rows)
    numbered = [(2, one), (3, two), rows[2]]
    assert sorted(tuple(r)[1:] for r in suffix.digest(df, 40, 8).collect()) == sorted(plain_bytes(numbered, 40).values())
    assert sorted(tuple(r)[1:] for r in substring.digest(df).collect()) == sorted(plain_words(numbered, 20).values())


def test_all_null_texts_are_alone(spark):
    df = spark.createDataFrame([(i, None) for i in range(4)], DOCS)
    assert sorted(tuple(r) for r in neardup.digest(df).collect()) == [(i, i, 0, 1) for i in range(4)]
