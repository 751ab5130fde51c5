"""A corpus from raw documents in five stages, each on all that the one before it kept.

Language ID drops documents that it finds no language in; the n-gram join keeps one of each
group of near copies; decontamination drops documents with a benchmark passage; secret scans
mask secrets in place; BPE gives each text's ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import bpe, decontam, lang_gru, ngram_join, secrets
from linkforge.llm.text import fresh
from linkforge.session import settled, ship, table

#: The share of noise, a class of the language network, from which on a document is in no language. At a half, of 3,000 held-out
#: labelled documents each of sf0.1 and check_h two and one were dropped (a license line, words of abuse), and of 200 texts of random letters or keys all.
NOISE = 0.5
#: The stages' rows: SQL can't express a trained network.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is less than half noise, whatever language or mix of them it is in.

    Null and empty texts go. Rows that repeat, and rows with a null doc_id, stay or go by their text. An empty table stays empty.
    """
    ship(spark)
    net = lang_gru.train(*lang_gru.sample(docs))
    pred, score, noise = (fresh(name, docs.columns) for name in ("lang_pred", "score", "noise"))
    found = lang_gru.predict(docs, net, out=(pred, score, noise))
    return found.where((F.col(pred) != "und") & (F.col(noise) < NOISE)).select(*docs.columns)


def _marked(docs: DataFrame, ordered: bool = False) -> tuple[DataFrame, str]:
    """docs with a number for each content of doc_id and text: what stages decide by, so that no row stands in for another of its id.

    ordered: whole doc_ids that come with one text are their own numbers, so that numbers rank as ids do; others lie above them.
    """
    mark = fresh("mark", docs.columns)
    text = F.xxhash64(F.lit(29), "text", F.col("text").isNull())
    content = F.xxhash64(F.lit(29), "doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    if not ordered or docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn(mark, content), mark
    top = 1 << 62
    above = content.bitwiseAND(F.lit((1 << 61) - 1)) + top
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi").select("doc_id")
    several = settled(several, "several")
    odd = F.col("doc_id").isNull() | (F.col("doc_id") >= top)
    if several.limit(1).count():
        docs = docs.join(several.withColumn(mark, F.lit(True)), "doc_id", "left")
        odd = odd | F.col(mark).isNotNull()
    return docs.withColumn(mark, F.when(odd, above).otherwise(F.col("doc_id").cast("long"))), mark


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the least doc_id; rows without one stay.

    A document that occurs in several rows of one doc_id and text stays once; different texts of one doc_id are documents of their own.
    """
    ship(spark)
    marked, mark = _marked(docs, ordered=True)
    slim = marked.select(F.col(mark).alias("doc_id"), F.col("text"))
    found = ngram_join.jaccard_components(slim, n=5, num=80, den=100).select(F.col("doc_id").alias("mark"), "component_id").distinct()
    ids = marked.select(F.col(mark).alias("mark"), "doc_id").distinct()
    found = settled(found.join(ids, "mark"), "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    stays = found.groupBy("component_id").agg(F.min_by("mark", order).alias("mark")).select(F.col("mark").alias(mark))
    kept = marked.where("doc_id is not null").join(stays, mark, "left_semi").dropDuplicates([mark])
    return kept.unionByName(marked.where("doc_id is null")).select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship(spark)
    marked, mark = _marked(docs)
    found = decontam.contaminated(marked.select(F.col(mark).alias("doc_id"), F.col("text")), table(spark, sf_dir, "benchmark"))
    found = settled(found.select(F.col("doc_id").alias(mark)).distinct(), "contaminated")
    return marked.join(found, mark, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    ship(spark)
    return secrets.redact(docs, samples=secrets.labelled() + secrets.found_samples(docs)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document; a null text has no ids."""
    import public_tokenizers

    ship(spark)
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("clean_of_benchmark", clean_of_benchmark),
    ("without_secrets", without_secrets),
    ("encoded", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
