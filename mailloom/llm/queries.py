"""The registered queries of this subpackage: thin applications of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import line_clean

    return line_clean(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .language_id import predict_language, train_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(docs["doc_id"])
    model = train_language(docs.where(~held))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.withColumn("held_out", held_out(found["doc_id"]))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .quality_model import score_quality, train_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(~held_out(labels["doc_id"])).withColumnRenamed("quality", "label"))
    found = score_quality(docs, model)
    return found.withColumn("held_out", held_out(found["doc_id"]))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_topk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_index import exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .source_mix import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "drawn")


def op7_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bin_packing import pack_documents
    from .source_mix import token_count

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs.select("doc_id", token_count(docs["text"]).alias("n_tokens")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality mark of the document that its address ends in."""
    from pyspark.sql import functions as F

    from .url_filter import UrlRule, judge_urls, url_parts

    rules = [UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    item = F.regexp_extract(url_parts(F.col("url"))[1], r"/([0-9]{1,18})(?:\.[a-zA-Z]+)?/?$", 1)
    marked = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    labels = pages.select("page_id", item.try_cast("bigint").alias("doc_id")).join(marked, "doc_id")
    return judge_urls(pages, labels.select("page_id", "bad"), rules)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
