"""The stages in a row, each against a plain version on its own input."""

import collections
import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from starloom.llm import bpe  # noqa: E402
from starloom.llm.common import written  # noqa: E402
from starloom.llm.queries import tokenizer_path  # noqa: E402
from tests.llm.test_dedup import plain_join  # noqa: E402
from tests.llm.test_text import plain_pii, plain_targets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", None, 0), (900002, "12345 ###", "en", "src0", 9), (900003, "", None, "src1", 0)], docs.schema)
    at = [docs.unionByName(odd)]
    for _, stage in corpus_pipeline.STAGES:
        at.append(written(stage(spark, at[-1], SF)))
    return at


def test_names_and_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixing_sources", "bpe_encoding"]
    assert all(t.columns == tables[0].columns for t in tables[1:-1])


def test_language_stage(tables):
    assert {r.doc_id for r in tables[1].collect()} == {r.doc_id for r in tables[0].collect() if any(c.isalpha() for c in r.text or "")}


def test_near_duplicate_stage(tables):
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted({g for g, _ in plain_join(rows).values()})


def test_personal_data_stage(tables):
    before = {r.doc_id: r.text for r in tables[2].collect()}
    after = {r.doc_id: r for r in tables[3].collect()}
    assert after.keys() == before.keys()
    for i, t in before.items():
        base = plain_pii(t)
        assert all(t[s:e] not in after[i].text for _, s, e in base)
        if not base and not re.search("[0-9@]", t):
            assert after[i].text == t
        assert after[i].n_chars == len(after[i].text)


def test_mixing_stage(tables):
    before = {r.doc_id: r for r in tables[3].collect()}
    after = [r for r in tables[4].collect()]
    assert all(before[r.doc_id] == r for r in after)
    words = {i: len(re.findall("[^\\x20\\x09-\\x0d]+", r.text or "")) for i, r in before.items()}
    sources = sorted({r.source for r in before.values()}, key=lambda s: (s is None, s))
    sizes = {s: sum(words[i] for i, r in before.items() if r.source == s) for s in sources}
    goal = dict(zip(sources, plain_targets([sizes[s] for s in sources], [k % 3 + 1 for k in range(len(sources))], 3), strict=True))
    times = collections.Counter(r.doc_id for r in after)
    assert max(times.values()) <= 3
    for s in sources:
        mine = [i for i, r in before.items() if r.source == s]
        near = min((words[i] for i in mine if words[i]), default=0)
        assert abs(sum(words[i] * times[i] for i in mine) - goal[s]) <= max(0.05 * goal[s], near)


def test_encoding_stage(tables):
    c = bpe.Codec(tokenizer_path())
    want = sorted((r.doc_id, c.encode(r.text).tolist()) for r in tables[4].collect())
    assert sorted((r.doc_id, r.ids) for r in tables[5].collect()) == want


def test_empty_input(spark, tables):
    t = tables[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        t = written(stage(spark, t, SF))
        assert t.count() == 0


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs = docs if k == len(corpus_pipeline.STAGES) - 1 else written(docs)
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256, tuple(r.ids)) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_tables_of_finished_stages_are_removed(spark, monkeypatch):
    seen = []
    real = corpus_pipeline.release
    monkeypatch.setattr(corpus_pipeline, "release", lambda s, paths: (seen.extend(paths), real(s, paths)))
    out = corpus_pipeline.run(spark, SF)
    assert len(seen) > 10 and not any(os.path.exists(p.removeprefix("file://")) for p in seen)
    assert out.count() > 0


def test_odd_rows_and_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, tag string, h string, copies int, pii int, ids string, key string"
    long = "the quick brown fox jumps over " * 60_000
    texts = [None, "", "the of and", "the of and", long, "write to ann@mail.com now"]
    rows = [(d, t, lang, s, 1, "r", "i", "t", "h", 1, 1, "x", "k") for d, t, lang, s in [(None, texts[0], None, None), (1, texts[1], "en", None), (2, texts[2], "en", "a"), (2, texts[3], "en", "a"), (None, texts[4], "en", "b"), (5, texts[5], None, "a")]]
    docs = spark.createDataFrame(rows, kind)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        docs = out
    assert set(r.doc_id for r in docs.collect()) <= {None, 2, 5}
