"""Queries opN_<name>(spark, sf_dir) of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import bpe, chat, decontaminate, langid, mixing, neardup, neighbours, periodic, pii, quality, resample, substring, suffix
from starloom.llm.common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(read(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(read(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix": op1_suffix,
    "op2_neardup": op2_neardup,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_substring": op7_substring,
    "op8_langid": op8_langid,
    "op9_mixing": op9_mixing,
    "op10_neighbours": op10_neighbours,
    "op11_decontaminate": op11_decontaminate,
    "op12_resample": op12_resample,
    "op13_periodic": op13_periodic,
}

WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents)"""


def folded(table: str, key: str, to: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{to} AS (SELECT {key}, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws FROM {table})"


ORACLE_SQL: dict[str, str] = {
    "op2_neardup": "WITH RECURSIVE " + WORDS + """,
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s + 1 : s + 5], ' ') k FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, least(len(ws), 1)))) s FROM w)),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) m FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
tops AS (SELECT doc_id, min(reach) class_id FROM r GROUP BY doc_id),
deg AS (SELECT a doc_id, count(*) n_links FROM l GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) n_links,
CAST(CASE WHEN len(ws) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY array_to_string(ws, ' ')) END AS BIGINT) copies
FROM w JOIN tops USING (doc_id) LEFT JOIN deg USING (doc_id)""",
    "op11_decontaminate": "WITH " + folded("documents", "doc_id", "w") + ", " + folded("benchmark", "item_id", "t") + """,
win AS (SELECT DISTINCT item_id, least(len(ws), 10) k, array_to_string(ws[s + 1 : s + 10], ' ') g FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, least(len(ws), 1)))) s FROM t)),
sizes AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, s, k, array_to_string(ws[s + 1 : s + k], ' ') g FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) s FROM w, sizes)),
m AS (SELECT doc_id, s, k, item_id FROM occ JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(*) n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) i FROM m) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) n, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) i FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(h.n, 0) AS BIGINT) n_hit, CAST(coalesce(d.n, 0) AS BIGINT) n_items,
sha256(coalesce(ids, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated FROM w LEFT JOIN hit h USING (doc_id) LEFT JOIN named d USING (doc_id)""",
    "op7_substring": "WITH " + WORDS + """,
win AS (SELECT doc_id, unnest(range(0, len(ws) - 19)) s, ws FROM w),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s + 1 : s + 20], ' ') ORDER BY doc_id, s) rn FROM win),
gone AS (SELECT DISTINCT doc_id, s + o i FROM k, (SELECT unnest(range(0, 20)) o) WHERE rn > 1),
word AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) - 1 i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) t, count(*) n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
