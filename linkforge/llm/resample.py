"""Importance resampling towards a target distribution: hashed n-grams of a position table, gains of buckets, Gumbel top draws.

A position table (row, pos, word) holds every word of every text. For order k, lead() over a text's positions brings the k - 1
words that follow, and they are joined by spaces. Features fall into hashed buckets; the gain of a bucket compares its share
among the target's features with its share among all. What is joined to the features is the table of gains, which holds one
row a bucket whatever the input; everything else is aggregated on the map side first.

Cases. Null and empty texts, and texts without words, have no features: weight 0, never drawn where least_words > 0. A null id
is drawn as an empty one. Rows that repeat are rows of their own, also in the counts; ties of score go to the smaller id, nulls
last. Empty tables give no rows, and an empty target only gains of an empty target. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.session import release, settled

#: Words: letters of any case and whatever lies beyond ASCII. Upper-case ASCII letters are lowered after the cut.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z lowered, nothing else; ASCII words by the fast built-in."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_table(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(row, *keep, pos, word): one row a word, and one with null pos and word for a text without words."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    at = df.select(F.monotonically_increasing_id().alias("row"), *keep, words.alias("words"))
    return at.select("row", *keep, F.posexplode_outer("words").alias("pos", "raw")).select("row", *keep, "pos", _lowered(F.col("raw")).alias("word"))


def features(table: DataFrame, n: int, buckets: int) -> DataFrame:
    """The position table with hits: each position's buckets, one an order from 1 to n that its text still has words for."""
    def bucket(gram: Column) -> Column:
        return (F.crc32(gram.cast("binary")) % buckets).cast("int")

    grams = [F.col("word")]
    if n > 1:
        text = Window.partitionBy("row").orderBy("pos")
        names = [f"next_{k}" for k in range(1, n)]
        table = table.withColumns({name: F.lead("word", k).over(text) for k, name in enumerate(names, 1)})
        # A run that would pass the text's end is no feature.
        grams += [F.when(F.col(names[k - 1]).isNotNull(), F.concat_ws(" ", "word", *names[:k])) for k in range(1, n)]
    return table.withColumn("hits", F.array_compact(F.array(*map(bucket, grams))) if n > 1 else F.array(bucket(grams[0])))


def bucket_counts(df: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """(bucket, hits): how often each bucket is met in all texts; one row a bucket at most."""
    found = features(position_table(df, text), n, buckets).where("word is not null")
    return found.select(F.explode("hits").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("hits"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for each bucket: floor(1000 ln) of the target's smoothed share over the raw one, from two tables of bucket counts."""
    both = (
        raw.select("bucket", F.col("hits").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("hits").alias("t")))
        .unionByName(raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
        .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    )
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    num = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)
    den = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets)
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(num / den)).alias("gain"))  # one row of sums


def weights(docs: DataFrame, key: str, text: str, table: DataFrame, n: int, buckets: int) -> DataFrame:
    """(row, key, n_words, n_features, weight) of every row: the floored mean of its features' gains."""
    found = features(position_table(docs, text, key), n, buckets)
    # One row a bucket, so its size is known before it is sent.
    by_bucket = F.broadcast(table)
    if n == 1:
        scored = found.select("row", key, "pos", F.col("hits")[0].alias("bucket")).join(by_bucket, "bucket", "left")
    else:
        # A position without words still counts as a row of its text.
        scored = found.select("row", key, "pos", F.posexplode_outer("hits").alias("order", "bucket")).join(by_bucket, "bucket", "left")
    first = F.col("pos").isNotNull() if n == 1 else F.col("pos").isNotNull() & (F.col("order") == 0)
    out = scored.groupBy("row", key).agg(F.count(F.when(first, 1)).alias("n_words"), F.count("gain").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    down = F.expr("(total - pmod(total, n_features)) div n_features")
    return out.select("row", key, "n_words", "n_features", F.when(F.col("n_features") == 0, F.lit(0)).otherwise(down).cast("long").alias("weight"))


def gumbel(key: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, settled, with column name: 0, 1, 2... in the given order, by ranges that tasks sort apart; no task sees all rows.

    The driver keeps one count a partition.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = settled(cut.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = dict(cut.groupBy("_part").count().collect())
    begin, run = {}, 0
    for part in sorted(sizes):
        begin[part], run = run, run + sizes[part]
    starts = cut.sparkSession.createDataFrame(list(begin.items()) or [(0, 0)], "_part int, _begin long")
    out = cut.join(F.broadcast(starts), "_part").withColumn(name, F.col("_begin") + F.col("_nth")).drop("_part", "_nth", "_begin")
    out.settled_path = cut.settled_path
    return out


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, buckets: int = 10_000, seed: int = 0, percent: int = 10, least_words: int = 20) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs; rank counts the drawn rows from 1, null where undrawn.

    Drawn are the floor(percent * N / 100) rows of highest score among the N with least_words words at least.
    """
    counts = settled(bucket_counts(docs, text, n, buckets), "raw-counts")
    table = settled(gains(counts, bucket_counts(target, target_text, n, buckets), buckets), "gains")
    scored = settled(weights(docs, key, text, table, n, buckets).withColumn("score", F.col("weight") + gumbel(key, seed)), "scored")
    release(counts, table)
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    order = [F.col("score").desc(), F.col(key).asc_nulls_last()]
    ranked = numbered(scored.where(enough), order, "_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    some = ranked.select(key, "n_features", "weight", "score", rank.alias("rank"))
    return some.unionByName(scored.where(~enough).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
