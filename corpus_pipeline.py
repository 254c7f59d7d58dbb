"""A training corpus from `documents`: STAGES in order, each on all that the one before kept.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each group of documents linked by five-word shingles with a Jaccard similarity of
   0.8 or more, the one with the smallest doc_id stays.
3. secrets: found secrets are masked in the text.
4. mixing: documents are taken 0, 1 or 2 times, so that sources come near their target weights.
5. encoding: token ids of every taken document; decoding checks them.

Cases.  Null texts count as empty.  Texts without words are in no group: all their rows stay.  Rows of one
doc_id with texts of different groups are different documents.  A null doc_id stands for a group only where
all its ids are null.  Of repeated rows one stays, the first by its JSON form.  Other columns, whatever their
names, are carried along until the last stage, which returns doc_id, lang and source beside the ids.  Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import bpe, common, mixing, ngram_join, quality, secrets

WORDS, SIMILARITY = 5, Fraction(4, 5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fitted(spark, docs, sf_dir)
    name = common.free_name("__quality", docs.columns)
    return quality.score(docs, model, keep=tuple(docs.columns), name=name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join.representatives(docs, WORDS, SIMILARITY)
    # the columns of docs are one column here, so that no name of theirs clashes
    packed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        ngram_join.text_key().alias("key"),
        F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"),
    )
    same = packed["id"].eqNullSafe(kept["doc_id"]) & (packed["key"] == kept["text_key"])
    worded = packed.where("worded")
    once = worded.join(kept.where("times = 1"), same, "left_semi")
    # rows of one id and text meet in an aggregate, which combines before it shuffles
    one = worded.join(kept.where("times > 1"), same, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return packed.where("not worded").select("row.*").unionByName(once.select("row.*")).unionByName(one.select("row.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.samples_from(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.allocate(docs, keep=tuple(docs.columns))
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias(common.free_name("__copy", docs.columns))
    return mixed.where("__mix_copies > 0").select(*docs.columns, copies).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_ids(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Classifiers, trees and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each but the last is written and read again."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
        common.drop(*before)  # the next stage reads only what this one wrote
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
