"""Vectors, archives and the pipeline."""

import hashlib
import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge.llm import near_vectors, ngram_join, secrets, warc


def brute_links(rows, least):
    n, up = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[i + 1 :]:
            if la is None or la != lb or not fine(x) or not fine(y) or len(x) != len(y):
                continue
            p, q = np.array(x, float), np.array(y, float)
            if p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= least:
                n[a] += 1
                n[b] += 1
                s, t = sorted((root(a), root(b)))
                up[t] = s
    return {k: (n[k], root(k)) for k in n}


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(0)
    rows = []
    for _ in range(40):
        c = r.normal(size=16)
        label = int(r.integers(0, 3))
        for _ in range(int(r.integers(1, 9))):
            v = c + r.normal(size=16) * 0.12
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    one = rows[0][1]
    for v, label in ((one, rows[0][2]), (one, rows[0][2]), (one, None), (None, 1), ([], 1), ([0.0] * 16, 1), ([None] + one[1:], 1), ([float("nan")] + one[1:], 1), ([float("inf")] + one[1:], 1), ([2 * x for x in one], rows[0][2])):
        rows.append((len(rows), v, label))
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, label int, id int, cell int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in near_vectors.near_duplicates(df, cells=4).collect()}
    assert got == brute_links(rows, 0.93)


def test_each_length_links_within_itself(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0, 0.0], 1), (3, [0.0, 1.0, 0.0], 1), (4, [0.0, 0.0, 1.0], 1), (5, [5.0], 1), (6, [7.0], 1), (7, [-7.0], 1), (8, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in near_vectors.near_duplicates(df).collect()} == brute_links(rows, 0.93)


def test_links_of_a_stated_query_set_at_scale(spark):
    """Recall of op1's own parameters at sf0.1: the rows whose id is divisible by 50, against all rows by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    u = np.array([r["embedding"] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(df).collect()}
    for i, r in enumerate(rows):
        if r["vec_id"] % 50 == 0:
            assert got[r["vec_id"]] == int(((u @ u[i] >= 0.93) & (label == label[i])).sum()) - 1


def test_near_vectors_on_many_equal_and_none(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 1.0], 1) for i in range(300)], "vec_id long, embedding array<float>, label int")
    assert {(x["n_links"], x["component_id"], x["kept"]) for x in near_vectors.near_duplicates(df).where("vec_id > 0").collect()} == {(299, 0, False)}
    assert near_vectors.near_duplicates(df.where("false")).count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, near_vectors.near_duplicates(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_chunks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.ones(8) + r.normal(size=8) * 0.2], 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cells in (1, 4):  # a crowded cell in several parts; several regions
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in near_vectors.near_duplicates(df, cells=cells).collect()}
        assert got == brute_links(rows, 0.93)


def test_recall_of_the_index(spark):
    """At the target recall, on vectors at the edge of the threshold."""
    r = np.random.default_rng(5)
    rows = []
    for _ in range(250):
        c = r.normal(size=64)
        c /= np.linalg.norm(c)
        d = r.normal(size=64)
        d -= (d @ c) * c
        d /= np.linalg.norm(d)
        rows += [(len(rows), c.tolist(), 1), (len(rows) + 1, (0.94 * c + np.sqrt(1 - 0.94**2) * d).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = sum(x["n_links"] for x in near_vectors.near_duplicates(df, cells=8).collect())
    assert links >= 0.99 * sum(n for n, _ in brute_links(rows, 0.93).values())


@pytest.mark.parametrize(("inner", "k"), [(5, 16), (5, 128), (8, 128), (8, 512), (64, 16)])
def test_index_misses_no_link_of_few_dimensions(inner, k):
    """Pairs at cosine 0.935 in inner of 64 stored dimensions, against brute force: one of the two visits the other's home."""
    r = np.random.default_rng(7)
    turn = np.linalg.qr(r.normal(size=(64, 64)))[0][:inner]
    x = r.normal(size=(4000, inner))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = r.normal(size=x.shape)
    d -= (d * x).sum(1, keepdims=True) * x
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    x, y = x @ turn, (0.935 * x + np.sqrt(1 - 0.935**2) * d) @ turn
    index = near_vectors.MultiIndex.fit(x, k, 0.93, inspect.signature(near_vectors.near_duplicates).parameters["recall"].default)
    sides = []
    for v in (x[:300], y[:300]):
        home, who, cell = index.visits(v)
        sides.append((home, set(zip(who.tolist(), cell.tolist()))))
    (hx, vx), (hy, vy) = sides
    assert all((i, int(hy[i])) in vx if hx[i] <= hy[i] else (i, int(hx[i])) in vy for i in range(300))


def test_near_vectors_of_few_dimensions_equal_brute_force(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 4)) @ np.linalg.qr(r.normal(size=(64, 64)))[0][:4]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    for cells in (16, None):
        got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(df, cells=cells).collect()}
        assert [got[i] for i in range(500)] == want.tolist()


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/\r\nx", long), (2, "u", long), (3, None, long), (4, "u", ""), (5, "u", None), (6, "u", "short"), (7, "u", "short"), (8, "u", "x" * 300_000), (9, "u", "x" * 300_000), (None, "u", long)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "page_id long, url string, html string, d int")
    path = f"file://{tmp_path}/warc"
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    by = {g["page_id"]: g for g in got}
    for k, _, html in rows:
        g = by[None if k is None else str(k)]
        data = (html or "").encode()
        assert g["payload_digest"] == "sha256:" + hashlib.sha256(data).hexdigest() and int(g["payload_length"]) == len(data)
        if k in (2, 3, 9):
            assert (g["record_type"], g["refers_to"], g["payload"]) == ("revisit", "1" if k < 9 else "8", None)
        else:
            assert g["record_type"] == "response" and bytes(g["payload"] or b"") == data
    some = warc.read(spark, path).where("record_type = 'revisit' and refers_to = '1'")
    assert {r["page_id"] for r in some.collect()} == {"2", "3"}
    assert "payload" in warc.read(spark, path, payload=False).columns and warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert raw.count(b"WARC-Type: ") == len(rows) and raw.endswith(b"\r\n\r\n")


def test_warc_reader_skips_payloads(tmp_path):
    from pyspark.sql.datasource import EqualTo

    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * 100_000
    rec = b"".join(b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(body), body) for k in (b"response", b"request", b"response"))
    (tmp_path / "a.warc").write_bytes(rec)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    assert list(reader.pushFilters([EqualTo(("record_type",), "request"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    seen = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

    with open(tmp_path / "a.warc", "rb") as f:
        got = list(reader._records(Counting(f)))
    assert len(got) == 1 and len(got[0][1]) == 100_000 and sum(seen) < 150_000


def test_pipeline(spark):
    """Every stage's decisions, against plain Python on the small table."""
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_jaccard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    near = corpus_pipeline.near_copies(spark, docs, sf).collect()
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, (_, c) in want.items() if d == c)
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    clean = corpus_pipeline.clean_of_benchmark(spark, docs, sf)
    bench = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    for r in docs.collect():
        t = " ".join(r["text"].lower().split())
        assert (r["doc_id"] in left) == (not any(b in t for b in bench))
    masked = corpus_pipeline.without_secrets(spark, docs, sf).collect()
    assert len(masked) == docs.count() and {r["doc_id"] for r in masked} == {r["doc_id"] for r in docs.collect()}
    model = secrets.Markov(secrets.labelled() + secrets.found_samples(docs))
    was = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in masked:
        parts, at = [], 0
        for s, e in sorted((s, e) for _, s, e in secrets.spans(was[r["doc_id"]], model)):
            if s >= at:
                parts += [was[r["doc_id"]][at:s], "[secret]"]
            at = max(at, e)
        assert r["text"] == "".join([*parts, was[r["doc_id"]][at:]]) and r["n_chars"] == len(r["text"])
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < docs.count() and "ids" in out.columns
    assert ngram_join.TRIE > 1


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    some = base.limit(20).collect()
    odd = [(None, some[0]["text"], "en", "s", 1), (None, None, None, None, None), (900_001, "", "en", None, 0), (900_002, "123 456", None, "s", 7), (900_003, some[1]["text"], some[1]["lang"], "s", 1), (900_003, some[1]["text"], some[1]["lang"], "s", 1), (900_004, "qxzj vkwq zzxq jjkv wqpx " * 20, None, "s", 1)]
    docs = base.limit(20).unionByName(spark.createDataFrame(odd, base.schema))
    wide = docs.withColumn("doc_id_2", F.lit(1)).withColumn("component_id", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name
        out = stage(spark, wide if name != "encoded" else docs, sf)
        if name != "encoded":
            assert out.columns == wide.columns, name
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        assert set(ids) <= {r["doc_id"] for r in docs.collect()}, name
        if name == "language_id":
            assert not {900_001, 900_002, 900_004} & set(ids) and ids.count(900_003) == 2 and ids.count(None) == 1
        if name == "near_copies":
            assert ids.count(None) == 2 and ids.count(900_003) <= 1
