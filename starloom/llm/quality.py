"""Quality rules as a learned decision list.

Statistics of each whole text feed rules that sequential covering learns from labelled documents: a rule grows by the threshold
condition that gains most information, is pruned back from its end on rows held aside, and is kept if it is precise enough there;
the rows that it covers leave, and the next rule grows. The list becomes one conditional Spark expression, in the rules' order.

Fitting uses the LABELLED labelled rows with the smallest hash of doc_id, or all if there are fewer, and as many of their documents, should
a doc_id have several; statistics and verdicts are those of all documents. The driver holds the statistics of that sample.

Defined results: a null text has no words; texts count whole; rows alike have results alike; of conditions that gain alike the first
ratio and the lowest limit are taken; an empty table gives an empty result; ratios over no words or lines are 0. Labels that are null or of unknown documents teach
nothing; several labels of a document all count. Without labels of both kinds there are no rules and every document that passes
the base checks is kept. Columns of the input are kept by assess(); clashing new ones get underscores before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from starloom.llm import anchors
from starloom.llm.common import free_name, small_batches

LABELLED = 20_000
WINDOW = 8
# Fixed values of the contract: blanks between words, and symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct")
#: What rules compare, from the counts.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "capitals": ("n_capitals", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "distinct": ("n_distinct", "n_words"),
}


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text."""
    import xxhash

    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    n = len(words)
    items = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    repeated = 0
    if n > WINDOW:
        h = anchors.Rolling(items, 0).every(WINDOW)
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[which] > 1)
        if len(twice):
            repeated = anchors.union_length(twice, twice + WINDOW)[0]
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    capitals = sum(1 for c in text if c.isupper()) if not text.isascii() else len(text) - len(text.translate(_NO_CAPITALS))
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        capitals,
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".,;:!?")),
        len(np.unique(items)),
    )


_NO_CAPITALS = {c: None for c in range(ord("A"), ord("Z") + 1)}


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs (its columns in keep) with COUNTS; the second result gives the names that they got."""
    kept = docs.columns if keep is None else keep
    names = {c: free_name(docs.select(*kept), c) for c in COUNTS}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            column = b.column(b.schema.names.index(text))
            rows = [statistics(t) for at in range(0, b.num_rows, 256) for t in column.slice(at, 256).to_pylist()]
            new = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in kept], *[pa.array(x) for x in new]], names=[*kept, *names.values()])

    schema = StructType([*[docs.schema[c] for c in kept], *[StructField(n, LongType()) for n in names.values()]])
    return small_batches(docs).select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema), names


def ratio(name: str, names: dict[str, str]) -> Column:
    over, under = RATIOS[name]
    top = F.col(names[over]).cast(DoubleType())
    return top if under is None else F.when(F.col(names[under]) > 0, top / F.col(names[under])).otherwise(0.0)


def base_failed(names: dict[str, str]) -> Column:
    n = F.col(names["n_words"])
    return (n < 20) | (100 * F.col(names["n_repeat_words"]) > 30 * n)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.limit if self.above else x[self.name] <= self.limit

    def column(self, names: dict[str, str]) -> Column:
        r = ratio(self.name, names)
        return r >= self.limit if self.above else r <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4) -> Rule:
    """Conditions added one by one, each with the largest information gain, until the rule covers bad rows only."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before = np.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            edge = np.flatnonzero(v[1:] > v[:-1])  # a limit lies between different values
            if not len(edge):
                continue
            p_low, all_low = np.cumsum(y)[edge], edge + 1
            middle = (v[edge] + v[edge + 1]) / 2
            for above, p, t in ((False, p_low, all_low), (True, p0 - p_low, p0 + n0 - all_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / t) - before), 0.0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Condition(name, above, float(middle[i])), float(g[i])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that does best on rows held aside."""

    def worth(r: Rule) -> float:
        c = covers(r, x, len(bad))
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 3), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precise: float = 0.95, most: int = 12, seed: int = 3) -> list[Rule]:
    """The decision list: rules that reject, in order."""
    rules: list[Rule] = []
    aside = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < most and bad[left & ~aside].any():
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = grow(*part(left & ~aside))
        rule = prune(rule, *part(left & aside)) if rule else rule
        if not rule:
            break
        c = covers(rule, x, len(bad)) & left
        good, hit = (~bad & c & aside).sum(), (bad & c & aside).sum()
        if hit < 2 or (hit + 1) / (hit + good + 2) < precise * (hit + 1) / (hit + 2) or (bad & c).sum() < precise * c.sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> list[Rule]:
    """Rules from the labelled sample."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `most` rows of two numbers
    stats, names = measured(rows, keep=["doc_id", "good"])
    # Where documents share a doc_id there may be more rows than labels.
    order = [F.xxhash64("doc_id"), "doc_id", "good", *names.values()]
    found = stats.orderBy(*order).limit(most).select("doc_id", "good", *[ratio(r, names).alias(r) for r in RATIOS]).collect()
    found.sort()
    if not found:
        return []
    x = {r: np.array([row[r] for row in found]) for r in RATIOS}
    return learn(x, np.array([row["good"] == 0 for row in found]))


def verdict(rules: list[Rule], names: dict[str, str]) -> Column:
    """The rules as one conditional expression: the first rule that holds decides."""
    out = None
    for rule in rules:
        c = rule[0].column(names)
        for more in rule[1:]:
            c = c & more.column(names)
        out = F.when(c, False) if out is None else out.when(c, False)
    return F.lit(True) if out is None else out.otherwise(True)


def assess(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, label: str = "quality") -> DataFrame:
    """docs with their counts, base_failed and kept."""
    rules = fit(docs, labels, label)
    stats, names = measured(docs, keep=keep)
    failed = base_failed(names)
    return stats.withColumn(free_name(stats, "base_failed"), failed).withColumn(free_name(stats, "kept"), ~failed & verdict(rules, names))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs, labels, keep=["doc_id"]).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])
