"""Personal data by weak supervision, in DataFrame operations only.

Base matches come from four patterns with their checks. Wider and tighter patterns add candidates. Labelers vote on each span:
the strict pattern, its checksum or value range, a gazetteer (top-level domains, issuer and country prefixes), words beside it
and its borders. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how
likely each pattern is personal data; on these likelihoods a logistic classifier of spans is trained. A candidate that the
classifier is sure of, and that overlaps no base match, is added; base matches always stay.

The driver holds counts of vote patterns, whose number is bounded by the labelers' votes (KINDS x 3^5 x DIGIT_STEPS), never
spans. Defined results: a null or empty text has no spans. Texts are searched whole, and no pattern steps back over a long
run; the time for a text's matches grows little faster than their number. Positions are code points, ends exclusive. Rows alike
have results alike; of added spans that overlap, those of the first kind stay. An empty table gives an empty result. Columns of
the input are kept; clashing new ones get underscores before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import free_name, written

# The kinds in their order, the base patterns (as the contract gives them), gazetteers and context words.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DOMAINS = "com org net edu gov mil int info biz io de fr es uk eu us ca it nl ch at be au jp cn br mx ru in example test invalid".split()
ISSUERS = "4|5[1-5]|2[2-7]|3[4-7]|30|6"
BESIDE = "mail email e-mail contact write call phone tel telephone mobile fax dial ring cell whatsapp card visa mastercard amex credit ip host server address addr correo teléfono tarjeta llamar courriel téléphone carte appeler kontakt telefon handy karte anrufen adresse".split()
AGAINST = "version v release isbn issn doi token key sha hash commit id build section chapter figure table".split()

#: The same languages as the base patterns without stepping back: possessive, and tried only where a run begins or the last match ended.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be of a kind. Every repetition is bounded.
WIDER = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}))(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?+(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A text without these can't match, so the pattern needn't run.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
NEEDED_WIDER = {"email": "at", "ip": "(.)|[.]", "card": None, "phone": None}
LABELERS = ("strict", "valid", "gazetteer", "context", "border")
DIGIT_STEPS = 5
CONTEXT = 32
#: Elements of a block of running values, and of a block of pieces between masked spans.
SCAN = 128
CUTS = (4096, 64)
FAR = 1 << 62
#: How sure the classifier must be of a span that it adds.
SURE = 0.9
SPAN = "array<struct<kind:int,start:long,end:long,value:string,left:string,right:string,base:boolean>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: inside lambdas Spark would compute an expression anew for each element."""
    return F.transform(F.array(value), f)[0]


def blocks(items: Column, size: int) -> Column:
    """An array in arrays of `size` elements."""
    last = F.floor((F.size(items) - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, F.lit(size)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def running(numbers: Column, combine: Callable[[Column, Column], Column], first: int) -> Column:
    """For each element of an array of longs, all up to it combined, `first` included.

    An array grows by copying, so each block of SCAN elements has its own running values, and the blocks' ends theirs.
    """
    zero = F.array(F.lit(first).cast("long"))
    scan = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
    tail = lambda xs: F.slice(xs, F.lit(2), F.size(xs))

    def together(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(tail(p), lambda v: combine(b, v))))

    return let(numbers, lambda xs: let(F.transform(blocks(xs, SCAN), scan), together))


def matches(text: Column, kind: int, pattern: str, base: bool) -> Column:
    """All leftmost matches that don't overlap. The gaps that split() gives between them tell where they are."""

    def spans(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: (F.length(x["left"]) + F.length(x["value"])).cast("long")), lambda a, b: a + b, 0)

        def span(x: Column, end: Column) -> Column:
            begin = end - F.length(x["value"])
            return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"), F.substring(x["left"], -CONTEXT, CONTEXT).alias("left"), F.substring(x["right"], 1, CONTEXT).alias("right"), F.lit(base).alias("base"))

        return F.zip_with(rows, ends, span).cast(SPAN)

    def rows(found: Column) -> Column:
        n = F.size(found)
        both = let(F.split(text, pattern, -1), lambda gaps: F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), n).alias("left"), F.slice(gaps, F.lit(2), n).alias("right")))
        return F.when(n > 0, let(both.cast("array<struct<value:string,left:string,right:string>>"), spans)).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rows)


def clear_of(spans: Column, others: Column) -> Column:
    """The spans, in order of start, that overlap none of the others: both are put in order together and reached from both sides."""
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(own).alias("own"))

    def checked(both: Column) -> Column:
        reach = running(F.transform(both, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"]).cast("long")), lambda a, b: F.greatest(a, b), 0)
        ahead = F.reverse(running(F.reverse(F.transform(both, lambda s: F.when(s["own"], F.lit(FAR)).otherwise(s["start"]).cast("long"))), lambda a, b: F.least(a, b), FAR))
        rows = F.arrays_zip(both.alias("s"), reach.alias("reach"), ahead.alias("ahead")).cast("array<struct<s:struct<start:long,end:long,kind:int,own:boolean>,reach:long,ahead:long>>")
        free = F.filter(rows, lambda x: x["s"]["own"] & (x["reach"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["end"]))
        return F.transform(free, lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end")))

    return let(F.sort_array(F.concat(F.transform(spans, mark(True)), F.transform(others, mark(False)))), checked)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    n = F.length(digits(value))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    octets = F.regexp_replace(value, r"[\[\]()]", "").rlike(rf"^{part}(?:\.{part}){{3}}$")
    return F.when(kind == 1, octets).when(kind == 2, n.between(13, 19) & F.when(n.between(13, 19), F.call_function("luhn_check", digits(value))).otherwise(False)).when(kind == 3, n.between(9, 15)).otherwise(True)


def found(docs: DataFrame, text: str, base: str, wider: str) -> DataFrame:
    """docs with two arrays of spans: what the base patterns match, valid or not, and what the wider ones match."""
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast(SPAN)
    has_digit = t.rlike("[0-9]")

    def of(patterns: dict[str, str], needed: dict[str, str | None], is_base: bool) -> Column:
        out = []
        for k, kind in enumerate(KINDS):
            need = needed[kind]
            may = has_digit if kind != "email" else F.lit(True)
            if need:
                may = may & F.greatest(*[t.contains(x) for x in [*need.split("|"), *need.split("|")]])
            out.append(F.when(may, matches(t, k, patterns[kind], is_base)).otherwise(empty))
        return F.concat(*out)

    return docs.withColumn(base, of(FAST, NEEDED, True)).withColumn(wider, of(WIDER, NEEDED_WIDER, False))


def word_vote(words: list[str]) -> str:
    return r"(?i)(?:^|[^\p{L}])(?:" + "|".join(words) + r")[^\p{L}]{0,6}$"


def votes(s: Column) -> list[Column]:
    """1, 0 or -1 of each labeler for a span."""
    kind, value = s["kind"], s["value"]
    tight = [rf"^{EMAIL}$", rf"^{IP}$", r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$", r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}$"]
    strict, gazetteer = F.lit(False), F.lit(0)
    for k, pattern in enumerate(tight):
        strict = F.when(kind == k, value.rlike(pattern)).otherwise(strict)
    n = F.length(digits(value))
    domain = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(DOMAINS)
    plain = digits(value)
    gazetteer = (
        F.when(kind == 0, F.when(domain, 1).otherwise(-1))
        .when(kind == 2, F.when(plain.rlike(f"^(?:{ISSUERS})") & n.between(13, 19), 1).otherwise(-1))
        .when(kind == 3, F.when(value.rlike(r"^(?:\+|00)[1-9]"), 1).otherwise(0))
        .otherwise(F.when(plain.rlike("^0"), -1).otherwise(0))
    )
    context = F.when(s["left"].rlike(word_vote(BESIDE)), 1).when(s["left"].rlike(word_vote(AGAINST)) | s["left"].rlike("[=#/][\"']?$"), -1).otherwise(0)
    border = F.when(s["left"].rlike(r"[\p{L}0-9_]$") | s["right"].rlike(r"^[\p{L}0-9_]"), -1).otherwise(1)
    return [F.when(strict, 1).otherwise(-1), F.when(valid(kind, value), 1).otherwise(-1), gazetteer, context, border]


def digit_step(s: Column) -> Column:
    n = F.length(digits(s["value"]))
    return F.when(n == 0, 0).when(n < 9, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4)


def estimate(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 40) -> list[float]:
    """EM of one class and conditionally independent labelers, a kind at a time: the likelihood of each row (kind, votes, digits, n).

    A labeler starts as right four times of five, and a prior worth a few spans holds it there: without one, EM may swap the classes.
    """
    out = [0.5] * len(counts)
    for kind in range(len(KINDS)):
        rows = [i for i, r in enumerate(counts) if r[0] == kind]
        right = [{(v, y): (0.1 if v == 0 else 0.72 if (v > 0) == y else 0.18) for v in (-1, 0, 1) for y in (False, True)} for _ in LABELERS]
        prior = 0.5
        for _ in range(rounds if rows else 0):
            for i in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(counts[i][1]):
                    a += math.log(right[j][v, True])
                    b += math.log(right[j][v, False])
                out[i] = 1 / (1 + math.exp(min(50.0, b - a)))
            total = sum(counts[i][3] for i in rows)
            true = sum(out[i] * counts[i][3] for i in rows)
            prior = (true + 2) / (total + 4)
            for j in range(len(LABELERS)):
                seen = {(v, y): 20 * (0.1 if v == 0 else 0.72 if (v > 0) == y else 0.18) for v in (-1, 0, 1) for y in (False, True)}
                for i in rows:
                    v, n = counts[i][1][j], counts[i][3]
                    seen[v, True] += out[i] * n
                    seen[v, False] += (1 - out[i]) * n
                for y in (False, True):
                    whole = sum(seen[v, y] for v in (-1, 0, 1))
                    right[j] |= {(v, y): seen[v, y] / whole for v in (-1, 0, 1)}
    return out


def features(kind: int, vote: tuple[int, ...], step: int) -> list[int]:
    return [1, *(int(kind == k) for k in range(len(KINDS))), *(int(v > 0) for v in vote), *(int(v < 0) for v in vote), *(int(step == k) for k in range(DIGIT_STEPS))]


def train(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 400) -> list[float]:
    """Weights of a logistic classifier on EM's likelihoods; rows count by the logarithm of how often they occur."""
    like = estimate(counts)
    x = [features(k, v, d) for k, v, d, _ in counts]
    weight = [math.log1p(n) for *_, n in counts]
    total = sum(weight) or 1.0
    w = [0.0] * len(features(0, (0,) * len(LABELERS), 0))
    for _ in range(rounds):
        slope = [0.001 * a for a in w]
        for row, p, n in zip(x, like, weight, strict=True):
            off = (1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, row, strict=True)))))) - p) * n / total
            slope = [g + off * b for g, b in zip(slope, row, strict=True)]
        w = [a - 2.0 * g for a, g in zip(w, slope, strict=True)]
    return w


def likelihood(s: Column, w: list[float]) -> Column:
    """The classifier as a column expression."""
    v, step, k = votes(s), digit_step(s), len(KINDS)
    score = F.lit(w[0])
    for j in range(k):
        score = score + F.when(s["kind"] == j, w[1 + j]).otherwise(0.0)
    for j in range(len(LABELERS)):
        score = score + F.when(v[j] > 0, w[1 + k + j]).when(v[j] < 0, w[1 + k + len(LABELERS) + j]).otherwise(0.0)
    for j in range(DIGIT_STEPS):
        score = score + F.when(step == j, w[1 + k + 2 * len(LABELERS) + j]).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def fit(spans: DataFrame, base: str, wider: str) -> list[float]:
    """Weights from all spans of a table that found() made: only counts of vote patterns come to the driver."""
    s = spans.select(F.explode(F.concat(base, wider)).alias("s"))
    keys = [F.col("s")["kind"].alias("kind"), *(v.alias(n) for v, n in zip(votes(F.col("s")), LABELERS, strict=True)), digit_step(F.col("s")).alias("step")]
    rows = s.select(*keys).groupBy("kind", *LABELERS, "step").agg(F.count("*").alias("n")).collect()
    return train(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["step"], r["n"]) for r in rows))


def classified(base: Column, wider: Column, w: list[float]) -> tuple[Column, Column]:
    """(base spans that pass their checks, wider ones that the classifier is sure of): arrays of struct(kind, start, end) in order."""
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    kept = F.sort_array(F.transform(F.filter(base, lambda s: valid(s["kind"], s["value"])), short))
    sure = F.filter(wider, lambda s: (likelihood(s, w) >= SURE) & valid(s["kind"], s["value"]))
    return kept, F.sort_array(F.transform(sure, short))


def detect(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """docs and their spans: array of struct(kind int, start long, end long, added boolean), by kind, then start.

    Patterns run once over the texts; the table of texts and spans is written, and read again to train and to classify.
    """
    # The input's columns travel in a struct, where their names can't clash with those used here.
    out = free_name(docs, to)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    table = written(found(rows, "text", "base_spans", "wider_spans").drop("text"))
    return final(table, "base_spans", "wider_spans", fit(table, "base_spans", "wider_spans"), "spans").select("row.*", F.col("spans").alias(out))


def final(spans: DataFrame, base: str, wider: str, w: list[float], to: str) -> DataFrame:
    """spans and the array `to` of base matches that pass and of added spans that overlap none of them."""
    kept, sure = classified(F.col(base), F.col(wider), w)
    step = spans.withColumn("kept_spans", kept).withColumn("sure_spans", sure)
    mark = lambda added: lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(added).alias("added"))
    step = step.withColumn("free_spans", F.when(F.size("sure_spans") > 0, clear_of(F.col("sure_spans"), F.col("kept_spans"))).otherwise(F.col("sure_spans")))
    # Of added spans that overlap, those of the first kind stay; spans of one kind come from one pattern and never overlap.
    of = lambda k: F.filter("free_spans", lambda s: s["kind"] == k)
    alone = F.concat(of(0), *[clear_of(of(k), F.filter("free_spans", lambda s, k=k: s["kind"] < k)) for k in range(1, len(KINDS))])
    added = F.sort_array(F.concat(F.transform("kept_spans", mark(False)), F.transform(alone, mark(True))))
    return step.withColumn(to, F.when(F.size("free_spans") > 0, added).otherwise(F.transform("kept_spans", mark(False))))


def joined_spans(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The four counts of base matches, the digest of base spans and all spans, for each document; texts never shuffle."""
    table = written(found(docs.select("doc_id", "text"), "text", "base_spans", "wider_spans").select("doc_id", "base_spans", "wider_spans"))
    out = final(table, "base_spans", "wider_spans", fit(table, "base_spans", "wider_spans"), "spans")
    base = F.filter("spans", lambda s: ~s["added"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == kind))).cast("long").alias(f"n_{KINDS[kind]}")

    n = [count(k) for k in range(len(KINDS))]
    added = F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added")
    return out.select("doc_id", *n, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), added)


def between(text: Column, offset: Column, cuts: Column, sizes: tuple[int, ...]) -> Column:
    """text, whose first character is at `offset`, from the first cut's a to the last one's b, with each cut's name after its piece a..b.

    A string is counted from its beginning, so cuts go by blocks: a block's stretch of text is taken first, and cut itself.
    """
    if not sizes:
        piece = lambda c: F.concat(text.substr((c["a"] - offset + 1).cast("int"), (c["b"] - c["a"]).cast("int")), c["name"])
        return F.array_join(F.transform(cuts, piece), "")

    def stretch(block: Column) -> Column:
        a, b = block[0]["a"], F.element_at(block, -1)["b"]
        return let(text.substr((a - offset + 1).cast("int"), (b - a).cast("int")), lambda t: between(t, a, block, sizes[1:]))

    return F.array_join(F.transform(blocks(cuts, sizes[0]), stretch), "")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with <KIND> in the place of each span; overlapping spans become one, of the first one's kind."""
    to = free_name(docs, "pii")
    found_ = detect(docs, text, to)
    t, name = F.col(text), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def masked(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)

        def done(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), F.slice(reach, F.lit(1), F.size(reach) - 1))
            cuts = F.zip_with(spans, before, lambda s, a: F.struct(a.alias("a"), s["start"].alias("b"), F.get(name, s["kind"]).alias("name")))
            fresh = F.filter(cuts, lambda c: c["b"] >= c["a"])
            rest = t.substr((F.element_at(reach, -1) + 1).cast("int"), F.length(t))
            return F.concat(let(fresh, lambda cs: between(t, F.lit(0), cs, CUTS)), rest)

        return let(reach, done)

    by_place = F.sort_array(F.transform(to, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found_.withColumn(text, F.when(F.size(to) > 0, let(by_place, masked)).otherwise(t)).select(*docs.columns)
