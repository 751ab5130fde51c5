"""Repeated ids with different content, ids that are texts, repetitive texts, and columns named like an operator's own."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkforge.llm import bpe, decontam, lang_gru, near_vectors, ngram_join, ordinal, resample, reshard, secrets, suffix_dedup, token_files, warc, whitening

PROSE = [" ".join(f"{w}{i * j % 89}" for j, w in enumerate(["alpha", "beta", "gamma", "delta", "of", "the"] * 12)) for i in range(1, 7)]
#: Names of columns that operators make themselves, outside and inside.
NAMES = ["lang_pred", "score", "noise", "refers_to", "payload_digest", "_payload", "_k", "_rank", "_block", "_lead", "_begin", "_key", "row", "shard", "slot", "size", "old_shard", "component_id", "n_shingles",
         "n_links", "kept", "rep", "id", "label2", "spans", "n_tokens", "ids", "start", "weight", "rank", "pos", "word", "tid", "k", "a", "n", "digest", "key", "x", "t", "h", "mark", "expected_grade", "tails", "item_id", "edits", "end", "patterns"]


def frame(spark, rows, kind="long"):
    """Documents with every name in NAMES as one more column."""
    more = ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(d, t, "en", "s", None, *NAMES) for d, t in rows], f"doc_id {kind}, text string, lang string, source string, n_chars long, {more}")


def test_archives_keep_every_payload(spark, tmp_path):
    x, y = "x" * 150, "y" * 150
    rows = [(1, x), (5, x), (5, y), (9, y), (5, "short"), (None, y)]
    df = spark.createDataFrame([(p, "u", h, *NAMES[3:7]) for p, h in rows], "page_id long, url string, html string, refers_to string, payload_digest string, _payload string, _k string")
    path = f"file://{tmp_path}/w"
    warc.write(df, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"").decode()) for r in warc.read(spark, path).collect()), key=str)
    assert got == sorted([("1", "response", None, x), ("5", "revisit", "1", ""), ("5", "response", None, y), ("9", "revisit", "5", ""), ("5", "response", None, "short"), (None, "response", None, y)], key=str)
    ids = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    for r in ids.values():
        if r["refers_to_record"]:
            assert ids[r["refers_to_record"]]["payload_digest"] == r["payload_digest"]


def test_ranges_of_an_archive_read_each_record_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 7 % 90)) for i in range(200)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(df.coalesce(1), path)
    want = sorted((r["page_id"], bytes(r["payload"] or b"")) for r in warc.read(spark, path).collect())
    for size in (300, 1000, 4097):
        some = warc.read(spark, path, split_bytes=size)
        assert some.rdd.getNumPartitions() > 5
        assert sorted((r["page_id"], bytes(r["payload"] or b"")) for r in some.collect()) == want


def test_near_copies_judge_rows_by_text(spark):
    a, b = PROSE[0], PROSE[1]
    docs = frame(spark, [(3, a), (7, a), (7, b), (7, b), (None, a), (None, PROSE[2]), (8, None), (8, ""), (9, PROSE[3]), (9, PROSE[4])])
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, a), (7, b), (None, a), (None, PROSE[2]), (8, None), (8, ""), (9, PROSE[3]), (9, PROSE[4])], key=str)


def test_clean_of_benchmark_judges_rows_by_text(spark, tmp_path):
    spark.createDataFrame([(1, PROSE[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(1, f"see {PROSE[5]}"), (1, PROSE[0]), (None, PROSE[5]), (None, PROSE[1]), (2, None)])
    got = corpus_pipeline.clean_of_benchmark(spark, docs, f"file://{tmp_path}")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, PROSE[0]), (None, PROSE[1]), (2, None)], key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_clashing_columns_and_text_ids(spark, tmp_path, kind):
    rows = [(i if kind == "long" else f"d{i}", t) for i, t in enumerate([*PROSE, PROSE[0], None, ""])]
    docs = frame(spark, rows, kind)
    ids = sorted(str(d) for d, _ in rows)

    def same(df, key="doc_id"):
        assert sorted(str(r[key]) for r in df.select(key).collect()) == ids

    net = lang_gru.train([t for _, t in rows if t], ["en"] * 7, steps=2)
    same(lang_gru.predict(docs, net))
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and set(kept.select("noise", "score").distinct().collect()) <= {("noise", "score")}
    same(ngram_join.jaccard_components(docs))
    assert {str(r["doc_id"]) for r in decontam.contaminated(docs, spark.createDataFrame([(1, PROSE[2])], "item_id long, text string")).collect()} == {ids[2]}
    same(secrets.scan(docs))
    same(secrets.redact(docs))
    same(suffix_dedup.repeats(docs, 64))
    same(resample.resample(docs, docs, n=2, buckets=31))
    same(bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")))
    path = f"file://{tmp_path}/t"
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1)
    same(token_files.read_documents(spark, path, kind))
    placed, _ = reshard.reshard(docs, 3, F.lit(0), 1)
    out = reshard.with_slots(placed)
    same(out)
    assert set(out.select("_rank", "_block", "_lead", "_begin", "row").distinct().collect()) == {("_rank", "_block", "_lead", "_begin", "row")}
    feats, grades = ordinal.sample(docs, docs.select("doc_id", F.lit(1).alias("grade")), "doc_id", "text", "grade")
    same(ordinal.predict(docs, ordinal.fit(feats, grades, 3)))
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"), *NAMES)
    same(near_vectors.near_duplicates(vectors), "vec_id")
    assert {str(r["vec_id"]) for r in whitening.whiten(vectors).collect()} == set(ids)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *NAMES)
    warc.write(pages, f"file://{tmp_path}/w")
    same(warc.read(spark, f"file://{tmp_path}/w"), "page_id")


def test_vectors_of_one_id_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (1, [1.0, 0.0], 2), (4, [1.0, 0.0], 2)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (1, 1, 1, True), (4, 1, 1, False)])


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    p = decontam.Patterns.of([(1, "-" * 400), (2, "=-" * 200)])
    for text in ("-" * 300_000, "=-" * 100_000, "-" * 99 + "=" * 99):
        buf = np.frombuffer((text + " end of it").encode(), np.uint8)
        tracemalloc.start()
        found = {i for _, k, _, _ in decontam.search(p, buf, np.array([0, len(buf)])) for i in p.items[k]}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == ({1} if text[:2] == "--" and len(text) > 1000 else {2} if text[0] == "=" else set()) and peak < 400 << 20


def test_benchmark_items_of_equal_passages_are_all_named():
    p = decontam.Patterns.of([(1, PROSE[0]), (2, PROSE[0])])
    buf = np.frombuffer(PROSE[0].encode(), np.uint8)
    assert {i for _, k, _, _ in decontam.search(p, buf, np.array([0, len(buf)])) for i in p.items[k]} == {1, 2}


def test_spans_of_a_long_log_take_linear_time():
    model = secrets.Markov(secrets.labelled())
    r = random.Random(2)
    line = lambda i: f"token={hashlib.md5(str(i).encode()).hexdigest()} q7Gz2LxP9vT4mWn8RbYc1KdH{r.randrange(99)} "
    took = []
    for n in (1000, 8000):
        text = "".join(map(line, range(n)))
        at = time.time()
        found = secrets.spans(text, model)
        took.append(time.time() - at)
        taken = sorted((s, e) for k, s, e in found if k != "random")
        assert all(not any(a < e and s < b for a, b in taken[max(0, i - 3) : i + 3]) for k, s, e in found[:200] if k == "random" for i in [next((j for j, t in enumerate(taken) if t[0] >= s), len(taken))])
    assert took[1] < 24 * took[0] + 0.5


def test_ids_are_read_by_range(spark, tmp_path):
    docs = spark.createDataFrame([(i, PROSE[i % 6] * (i % 4)) for i in range(60)], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1, tasks=3)
    whole = sorted((r["start"], r["ids"]) for r in token_files.read_ids(spark, path, [(0, 1 << 40)]).collect())
    flat = [i for _, ids in whole for i in ids]
    rows = token_files.read_documents(spark, path).orderBy("start").collect()
    assert len(flat) == sum(r["n_tokens"] for r in rows) and flat.count(1) >= 60
    at = {r["doc_id"]: r for r in rows}
    begin, end = at[7]["start"], at[9]["start"] + at[9]["n_tokens"]
    some = sorted((r["start"], r["ids"]) for r in token_files.read_ids(spark, path, [(begin, end), (3, 5)]).collect())
    assert [i for _, ids in some for i in ids] == flat[3:5] + flat[begin:end]

    class Counting:
        def __init__(self, data):
            import io

            self.f, self.n = io.BytesIO(data), 0

        def seek(self, at):
            self.f.seek(at)

        def read(self, size):
            self.n += size
            return self.f.read(size)

    source = Counting(token_files.build([(i, np.arange(5000, dtype=np.uint32)) for i in range(100)], 13, 0, 0) + b"\n")
    f = token_files.TokenFile(source)
    head = source.n
    assert f.ids(123_000, 123_010).tolist() == [x % 5000 for x in range(123_000, 123_010)] and source.n - head < 8000


def test_flow_over_many_shards_moves_the_least():
    r = random.Random(1)
    supply, capacity = [r.randrange(100) for _ in range(5000)], [r.randrange(50, 100) for _ in range(6000)]
    flow = reshard.min_cost_flow(supply, capacity)
    moved = sum(x for (i, j), x in flow.items() if i != j)
    assert moved == sum(supply) - sum(map(min, supply, capacity))
    out, into = {}, {}
    for (i, j), x in flow.items():
        out[i], into[j] = out.get(i, 0) + x, into.get(j, 0) + x
    assert all(out.get(i, 0) == s for i, s in enumerate(supply)) and all(x <= capacity[j] for j, x in into.items())


def test_null_keys_are_dealt_by_text(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i}") for i in range(900)], "doc_id long, text string")
    placed, _ = reshard.reshard(df, 4, F.lit(0), 1, blocks=64)
    sizes = [r["count"] for r in placed.groupBy("_block").count().collect()]
    assert max(sizes) < 4 * np.median(sizes)
    slots = reshard.with_slots(placed).groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r["s"] == list(range(len(r["s"]))) for r in slots)
