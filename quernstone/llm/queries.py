"""One thin query per numbered operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import table

#: The host rules of op10: fixed values.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: ``labels`` rows taken as those of the page with that number; low quality or toxic is bad."""
    from quernstone.llm.url_reputation import judge_urls

    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).withColumn("bound", F.round("bound", 6))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernstone.llm.packing import PackParams, pack

    return pack(spark, table(spark, sf_dir, "documents"), PackParams(public_tokenizers.path("byte_bpe_50k.json")))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.ppm import score_texts

    return score_texts(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.toxicity import score_toxicity

    return score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.decontamination import find_leaks

    return find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.near_dup import duplicate_groups

    return duplicate_groups(spark, table(spark, sf_dir, "documents"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.cover_tree import vector_groups

    return vector_groups(spark, table(spark, sf_dir, "embeddings"))


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.html_main import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.licenses import scan_licenses

    return scan_licenses(spark, table(spark, sf_dir, "documents"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.threshold_search import rank_documents

    return rank_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.whitening import whiten

    return whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.spotsigs import fingerprints

    return fingerprints(spark, table(spark, sf_dir, "documents"))
