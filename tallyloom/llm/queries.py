"""Queries of the text operators (p6 to p8). Each imports its operator when it runs, so that the list of queries is cheap to load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary() -> tuple[str, str]:
    """Path and split pattern of the byte-level vocabulary the queries count tokens with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Feeds that must not share a container: posts come by mail and by the API in different editions.
APART = {"mail_gateway": {"api_export"}, "api_export": {"mail_gateway"}}


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a text above 2,048 tokens, with its container; feeds of APART share none."""
    from tallyloom.llm.packing import pack

    return pack(_documents(spark, sf_dir), "doc_id", "text", "source", *_vocabulary(), apart=APART)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items, tokens and share of unused space of p6_containers."""
    from tallyloom.llm.packing import fill_report

    return fill_report(p6_containers(spark, sf_dir))


def _faults(spark: SparkSession, sf_dir: str, packed: DataFrame) -> DataFrame:
    """One row: texts, texts placed whole and once, containers above the capacity, containers with feeds of APART together."""
    docs = _documents(spark, sf_dir).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "source")
    per_text = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("d"), F.max("piece_no").alias("last"), F.max(F.col("first_token") - F.col("piece_no") * 2048).alias("gap"), F.min(F.when(F.col("n_tokens") < 2048, F.col("piece_no"))).alias("short"))
    whole = (F.col("n") == F.col("d")) & (F.col("last") == F.col("n") - 1) & (F.col("gap") == 0) & F.coalesce(F.col("short") == F.col("last"), F.lit(True))
    texts = docs.select("doc_id").join(per_text, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(whole).alias("n_placed_once"))
    feeds = packed.join(docs, "doc_id").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), *[F.max((F.coalesce("source", F.lit("")) == s).cast("int")).alias(s) for s in APART])
    bins = feeds.agg(F.count_if(F.col("used") > 2048).alias("n_too_full"), F.count_if(sum(F.col(s) for s in APART) > 1).alias("n_mixed"))
    return texts.withColumn("_k", F.lit(1)).join(bins.withColumn("_k", F.lit(1)), "_k").drop("_k")


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether p6_containers places every text once and keeps capacity and feeds apart."""
    from tallyloom.session import cut

    return _faults(spark, sf_dir, cut(p6_containers(spark, sf_dir)))


def p6_strict_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_faults, with no two copies of a text in one container, whatever their number."""
    from tallyloom.llm.packing import pack
    from tallyloom.session import cut

    return _faults(spark, sf_dir, cut(pack(_documents(spark, sf_dir), "doc_id", "text", "source", *_vocabulary(), apart=APART, strict=True)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.leakage import leaked_items

    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    return leaked_items(_documents(spark, sf_dir), "doc_id", "text", items, "item_id", "text")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each item in each document: exact or proximity, with its place in both."""
    from tallyloom.llm.leakage import leaked_passages

    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    return leaked_passages(_documents(spark, sf_dir), "doc_id", "text", items, "item_id", "text")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents each leaked item is found in."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.truncation import cut_texts

    return cut_texts(_documents(spark, sf_dir), "doc_id", "text", "source").distinct()


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a text per source, as p8_shares counts them."""
    return p8_shares(spark, sf_dir).select("source", "n_posts")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut posts per source."""
    from tallyloom.llm.truncation import truncation_shares

    return truncation_shares(_documents(spark, sf_dir), "doc_id", "text", "source")


QUERIES = {
    "p6_containers": p6_containers, "p6_report": p6_report, "p6_faults": p6_faults, "p6_strict_faults": p6_strict_faults, "p7_found": p7_found, "p7_passages": p7_passages, "p7_items": p7_items,
    "p8_found": p8_found, "p8_shares": p8_shares, "p8_sources": p8_sources,
}

_PLACED = "SELECT count(*) AS n_texts, count(*) AS n_placed_once, CAST(0 AS BIGINT) AS n_too_full, CAST(0 AS BIGINT) AS n_mixed FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"
#: What SQL can say about the results: that nothing is lost, placed twice or too full.
ORACLES = {"p6_faults": _PLACED, "p6_strict_faults": _PLACED, "p8_sources": "SELECT source, count(*) AS n_posts FROM documents WHERE text IS NOT NULL GROUP BY 1"}
