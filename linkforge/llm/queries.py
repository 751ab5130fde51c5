"""The registered queries of this subpackage: each applies its operator to a whole table. And their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import bpe, decontam, lang_gru, near_vectors, ngram_join, ordinal, resample, reshard, secrets, suffix_dedup, token_files, warc, whitening
from linkforge.session import shared_dir, ship, table

#: Shards of op3's layout before and after, the end id of op2, and the tail probability that op4 keeps a document at.
OLD_SHARDS, SHARDS, END_ID, KEEP = 32, 40, 1, 0.5


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), END_ID)
    return token_files.read_documents(spark, path)


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)), F.lit(0))
    placed, _ = reshard.reshard(docs, SHARDS, old, OLD_SHARDS)
    path = shared_dir(spark, "shards")
    reshard.write_shards(placed, path)
    files = reshard.with_slots(spark.read.parquet(path))  # the columns of documents again
    return files.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("old_shard").cast("int").alias("old_shard"),
    )


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 good, null where a label is. Where labels differ, toxic and low quality win."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", grade.alias("grade"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    feats, grades = ordinal.sample(docs, graded(table(spark, sf_dir, "labels")), "doc_id", "text", "grade")
    model = ordinal.fit(feats, grades, 3)
    found = ordinal.predict(docs, model)
    tail = [F.round(F.col("tails")[k], 6).alias(name) for k, name in ((0, "p_not_toxic"), (1, "p_good"))]
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), *tail).withColumn("kept", F.col("p_not_toxic") >= KEEP)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    warc.write(pages, path)
    responses = warc.read(spark, path).where("record_type = 'response'")
    revisits = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    one = responses.select(F.col("page_id").cast(kind), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    two = revisits.select(F.col("page_id").cast(kind), F.col("payload_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col("refers_to").cast(kind))
    return one.unionByName(two)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = lang_gru.train(*lang_gru.sample(docs))
    found = lang_gru.predict(docs.select("doc_id", "text"), net, keep=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, samples=secrets.labelled() + secrets.found_samples(docs))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, seed=2024, percent=10, least_words=20)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """op1 to op13 and the pipeline; each ships the package to the executors first."""
    import corpus_pipeline

    own = [op1_near_vectors, op2_token_files, op3_reshard, op4_ordinal_quality, op5_decontaminate, op6_warc, op7_bpe, op8_ngram_join, op9_language, op10_secrets, op11_suffix_dedup, op12_resample, op13_whitening]
    named = {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}

    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return query

    return {k: shipped(f) for k, f in named.items()}


#: Brute force over all pairs of a label: fit for the small tables that the driver compares.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(comp.c, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(comp.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN comp ON comp.a = e.vec_id
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""


#: CRC-32 is worked out from its polynomial: a table of 256 entries, then one step a byte of each distinct word.
OP12_SQL = r"""
WITH RECURSIVE step(b, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS crc_of FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS word FROM d), qw AS (SELECT unnest(words) AS word FROM q),
u AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM qw)),
h AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM u, crc
),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM qw JOIN h USING (word) GROUP BY bucket),
g AS (
  SELECT b.range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM qw) + 10000))))::BIGINT AS gain
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range
),
w AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)
),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM x WHERE n_features >= 20) THEN place END AS rank FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_resample": OP12_SQL, "op1_near_vectors": OP1_SQL, "op6_warc": OP6_SQL}
