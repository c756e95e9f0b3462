"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

run() writes each stage's result as Parquet and reads it back as the next one's docs. All stages
but the last return the columns of documents; the last returns the pieces of the packed sequences.
What a stage writes for itself is deleted when its result is written, and that when the next one's is.

Cases: null, empty and letterless texts go in the first stage, as their language is unknown; other
nulls stay. Copies of one text leave the one with the smallest id, repeated rows of an id one row with the least of
its other columns; rows of one id with different texts go or stay together, rows without an id stay. A text of which the third stage leaves only white space goes. Very
long texts pass every stage whole and end as several pieces. Empty tables give empty results. Extra
columns are not passed on, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import bin_packing, jaccard_join, language_id, source_mix, suffix_dedup
from mailloom.llm.common import materialize, release, scratch, sweeping, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a language is rejected below this probability
LEAST_LANGUAGE = 0.5
#: largest expected share of the tokens that the mix draws; the targets may allow less
MIX_BUDGET = 0.9


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is recognised; a missing language is filled in."""
    model = language_id.train_language(docs)
    found = language_id.predict_language(docs, model, keep=("text", "lang", "source", "n_chars"))
    found = found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_LANGUAGE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by n-gram similarity, directly or not, the one with the smallest id."""
    more = materialize(jaccard_join.jaccard_classes(docs).where("class_id <> doc_id").select("doc_id"))
    if more.count() <= jaccard_join.BROADCAST_IDS:
        more = F.broadcast(more)
    docs = docs.join(more, "doc_id", "left_anti").select(*COLUMNS)
    # rows that share an id: equal texts become one row, the least of the other columns
    twice = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if not twice.limit(1).count():
        return docs
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("of"))
    return docs.join(twice, "doc_id", "left_anti").unionByName(one.select("doc_id", "text", "of.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier text has; those of which nothing is left go."""
    cut = suffix_dedup.repeated_spans(docs, with_text=True, keep=("lang", "source"))
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    drawn = source_mix.mix_sources(docs, source_mix.MixSettings(budget=MIX_BUDGET, bounded=True))
    return drawn.where("drawn").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of texts, with their places in training sequences."""
    return bin_packing.pack_documents(docs.select("doc_id", source_mix.token_count(F.col("text")).alias("n_tokens")))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("suffix_dedup", without_repeats),
    ("source_mix", mixed),
    ("bin_packing", packed),
]

#: no SQL states language identification or difference-cover sorting; the tests hold brute-force versions against it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        path, before = scratch(spark), docs
        with sweeping(spark):
            docs = materialize(stage(spark, docs, sf_dir), path)
        if k:
            release(before)
    return docs
