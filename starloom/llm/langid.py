"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams (1 to 3 letters of blank-padded lower-case words) over all documents that
teach it. A document is given the language whose profile is the least out of place: the sum, over the document's own most
frequent n-grams, of the differences between both ranks, or of the profile's length where the profile lacks the n-gram.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing teaches; ties between languages go to
the first by code point; equally frequent n-grams are ranked by their codes, shorter ones first.
score = 1 - distance / largest possible distance. Texts are taken whole. The driver holds profiles only, PROFILE rows a
language. Columns of the input are kept; clashing new ones get underscores before them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from starloom.llm.common import free_name, small_batches

WORD = re.compile(r"[^\W\d_]+")
#: N-grams of a language's profile, and of a document's.
PROFILE = 400
OWN = 300
BLANK = 32
#: Counts that a task holds before it hands them on.
PENDING = 100_000
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text's lower-case words, each word between blanks: code points in 21 bits each."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != BLANK]  # n-grams don't reach over a blank
    return np.concatenate([c[c != BLANK], two, three])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for w in WORD.finditer(text) for c in w.group())


def counted(batches: Iterator, text: str, lang: str) -> Iterator:
    """Counts of (lang, n-gram) of a partition, in bounded tables."""
    import pyarrow as pa

    totals: dict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        flat = [(k, g, n) for k, t in totals.items() for g, n in t.items()]
        totals.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.int64())], names=["lang", "gram", "n"])

    for b in batches:
        langs = b.column(lang).to_pylist()
        for at in range(0, b.num_rows, 256):
            together = defaultdict(list)
            for k, t in zip(langs[at : at + 256], b.column(text).slice(at, 256).to_pylist(), strict=True):
                if t:
                    together[k].append(t)
            for k, ts in together.items():
                codes, n = np.unique(grams("\n".join(ts)), return_counts=True)
                t = totals[k]
                for g, m in zip(codes.tolist(), n.tolist(), strict=True):
                    t[g] += m
            if sum(map(len, totals.values())) > PENDING:
                yield rows()
    yield rows()


def learn(taught: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """(language, its most frequent n-grams in order) from all rows with a language."""
    rows = small_batches(taught).where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(lambda bs: counted(bs, "text", "lang"), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", first).where(F.col("rank") <= size).collect()
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in top:
        out[r["lang"]].append((r["rank"], r["gram"]))
    return [(k, [g for _, g in sorted(v)]) for k, v in sorted(out.items())]


class Profiles:
    """Ranks of n-grams in all profiles as one matrix, a row an n-gram in order."""

    def __init__(self, profiles: list[tuple[str, list[int]]], size: int):
        self.langs = [k for k, _ in profiles]
        self.size = size
        self.codes = np.unique(np.array([g for _, gs in profiles for g in gs], np.int64))
        self.rank = np.full((len(self.codes) + 1, max(1, len(profiles))), -1, np.int32)  # the last row: in no profile
        for j, (_, gs) in enumerate(profiles):
            self.rank[np.searchsorted(self.codes, np.array(gs, np.int64)), j] = np.arange(len(gs))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not len(self.codes) or not has_letter(text):
            return UNKNOWN, 0.0
        codes, n = np.unique(grams(text), return_counts=True)
        own = codes[np.argsort(-n, kind="stable")[:OWN]]
        row = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = self.rank[np.where(self.codes[row] == own, row, len(self.codes))]
        off = np.where(rank < 0, self.size, np.minimum(np.abs(rank - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        best = int(np.argmin(off))
        return self.langs[best], float(1 - off[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], text: str = "text", to: str = "lang_pred", score: str = "score", keep: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """docs (its columns in keep, all by default) with predicted language and score."""
    kept = docs.columns if keep is None else keep
    to, score = free_name(docs, to), free_name(docs, score)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = Profiles(profiles, size)
        for b in batches:
            column = b.column(b.schema.names.index(text))
            found = [p.predict(t) for at in range(0, b.num_rows, 256) for t in column.slice(at, 256).to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in kept], *new], names=[*kept, to, score])

    asked = small_batches(docs).select(*dict.fromkeys([*kept, text]))
    return asked.mapInArrow(run, StructType([*[docs.schema[c] for c in kept], StructField(to, StringType()), StructField(score, DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that teach nothing: crc32 of doc_id as text, modulo 4, is 2 (a null doc_id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def digest(docs: DataFrame) -> DataFrame:
    profiles = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs whose language can be told, with the predicted one in lang; those without a letter, or below the score, go."""
    profiles = learn(docs.where(~held_out()))
    out = identify(docs, profiles, to="lang_found", score="lang_score")
    to, score = out.columns[-2:]
    return out.where((F.col(to) != UNKNOWN) & (F.col(score) >= least)).withColumn("lang", F.col(to)).select(*docs.columns)
