"""From raw documents to token ids: five stages, each a table of documents that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import bpe, langid, mixing, neardup, pii
from starloom.llm.common import read, release, scope, written
from starloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null or letterless texts) go; lang becomes the predicted language.

    A null doc_id teaches as an empty one; documents without lang teach nothing; of languages equally near the first by code point is
    taken; repeated rows are judged alike; an empty table stays empty.
    """
    return langid.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more) the document with the smallest doc_id stays.

    A null doc_id comes last; of documents with one doc_id the one whose text has the smallest hash stays; of repeated rows (doc_id and text)
    one. Documents without words (null, empty) have no duplicates but repeated rows. An empty table stays empty.
    """
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind in angle brackets; n_chars follows the text.

    A null text stays null, and its n_chars becomes null; of spans that overlap the first one by place, end and kind gives the name; repeated
    rows are masked alike; an empty table stays empty.
    """
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them.

    A null source is a source, the last one; null and empty texts have no words and are taken as often as their source's documents are,
    or once more, by lot; repeated rows (doc_id, source and text) are taken alike, and documents of one length in the order of
    their hashes; an empty table stays empty.
    """
    return mixing.mix(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the digest of what they decode to.

    A null or empty text has no ids; repeated rows are encoded once and have the same ids; an empty table stays empty.
    """
    distinct = docs.groupBy("doc_id", "lang", "source", "text").agg(F.count("*").cast("int").alias("times"))
    out = bpe.encode(distinct, tokenizer_path(), decoded="decoded")
    out = out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), F.explode(F.sequence(F.lit(1), "times")))
    return out.drop("col")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the profiles nor the joins and encoders; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; what a stage wrote on its way goes as soon as its result is a table."""
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with scope() as mine:
            docs = written(stage(spark, docs, sf_dir))
        release(spark, [*before, *mine[:-1]])
        before = mine[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
